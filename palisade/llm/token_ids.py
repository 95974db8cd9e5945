"""Token ids in patched frame-of-reference blocks (operator 3).

Contract.  ``write_ids(docs, tokenizer_file, path)`` encodes every whole text, appends ``end_id``
to each, and writes the ids in ascending doc_id order as shards below ``path``; ``read_ids`` reads
shards back to one row per document: ``doc_id``, ``start`` (ids of all documents before it) and
``ids``.  ``digest`` is the same with ``n_tokens`` and ``ids_crc32`` in place of the ids.

Format.  A shard is one binary value, kept as a row ``(part, before, n_docs, n_ids, data)`` of a
Parquet table, so that Spark's committer makes files whole and any store it knows can hold them;
``before`` counts the ids of the part that stand before the shard.  The value itself needs
nothing else and can be written out as a file.  All numbers are
little-endian.  Header: ``PFOR``, version (u32), documents (u32), blocks (u32), ids (u64).  Then the
document table (doc_id i64, ids u32, and 1 byte that is 0 for a null id, each), the block index (start of each
block as u64 from the first block), then the blocks.  A block holds 1024 ids, the last one fewer:
minimum (u32), count (u16), width (u8), exceptions (u16), then the ids less the minimum packed at
``width`` bits, lowest bit first, then the places (u16) and high bits (u32) of the exceptions.  The
width is the one of the percentile whose block is smallest, so ids beyond it become exceptions.

Edge cases: null and empty texts have the end id alone; ties in doc_id are ordered by text, null
first; repeated rows are all written; a null doc_id comes first; extra columns are ignored; an
empty table gives no shards.  A document is never cut: a shard ends after the document with which
it reaches ``SHARD_IDS``.
"""

from __future__ import annotations

import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scratch
from .words import LOWER, chunks, hash_spans, runs, text_buffer

#: The id appended to each document, ids of a block, ids after which a shard ends.
END_ID, BLOCK_IDS, SHARD_IDS = 2, 1024, 1 << 20
#: Shares of a block's ids that may fit the width; the smallest block wins.
PERCENTILES = (0.80, 0.90, 0.95, 0.98, 1.0)
#: Runs, and bytes of runs, that a worker remembers before it starts anew; bits of the table's size.
MEMORY, MEMORY_BYTES, _TABLE = 1_000_000, 1 << 26, 22
#: Bytes of one text that are encoded at a time, to the next blank.
PART = 1 << 21
_SCHEMA = "part int, before long, n_docs int, n_ids long, data binary"
_DOC = np.dtype([("doc", "<i8"), ("n", "<u4"), ("known", "u1")])


# ---------------------------------------------------------------- blocks


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of unsigned 32-bit values."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def pack(x: np.ndarray, width: int) -> bytes:
    """Values of ``width`` bits, lowest bit first."""
    if width == 0:
        return b""
    if width in (8, 16, 32):  # the same bytes
        return x.astype(f"<u{width // 8}").tobytes()
    bits = (x[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if width == 0:
        return np.zeros(n, np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    if width <= 25:  # a value lies within four bytes
        b = np.frombuffer(data + b"\0\0\0\0", np.uint8)
        four = b[:-3].astype(np.uint32) | b[1:-2].astype(np.uint32) << np.uint32(8) | b[2:-1].astype(np.uint32) << np.uint32(16) | b[3:].astype(np.uint32) << np.uint32(24)
        at = np.arange(n) * width
        return four[at >> 3] >> (at & 7).astype(np.uint32) & np.uint32((1 << width) - 1)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(1, dtype=np.uint32)


def encode_block(ids: np.ndarray) -> bytes:
    """One block; see the format."""
    low = ids.min()
    x = ids - low
    length = np.sort(_bits(x))
    n, best = len(ids), None
    for p in PERCENTILES:
        width = int(length[max(0, int(np.ceil(p * n)) - 1)])
        out = n - int(np.searchsorted(length, width, "right"))
        size = -(-n * width // 8) + 6 * out
        if best is None or size < best[0]:
            best = (size, width)
    width = best[1]
    mask = np.uint32((1 << width) - 1)
    at = np.flatnonzero(x > mask)
    high = (x[at].astype(np.uint64) >> np.uint64(width)).astype("<u4")
    return struct.pack("<IHBH", int(low), n, width, len(at)) + pack(x & mask, width) + at.astype("<u2").tobytes() + high.tobytes()


def decode_block(data, at: int = 0) -> np.ndarray:
    low, n, width, out = struct.unpack_from("<IHBH", data, at)
    at += 9
    size = -(-n * width // 8)
    x = unpack(data[at : at + size], width, n)
    at += size
    if out:
        place = np.frombuffer(data, "<u2", out, at)
        x[place] |= (np.frombuffer(data, "<u4", out, at + 2 * out).astype(np.uint64) << np.uint64(width)).astype(np.uint32)
    return x + np.uint32(low)


def encode_shard(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a shard."""
    blocks = [encode_block(ids[i : i + BLOCK_IDS]) for i in range(0, len(ids), BLOCK_IDS)]
    table = np.zeros(len(doc_ids), _DOC)
    table["doc"], table["n"], table["known"] = [d or 0 for d in doc_ids], counts, [d is not None for d in doc_ids]
    index = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u8")
    return b"".join([b"PFOR", struct.pack("<IIIQ", 2, len(doc_ids), len(blocks), len(ids)), table.tobytes(), index.tobytes(), *blocks])


def decode_shard(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, their numbers of ids, and all ids."""
    if data[:4] != b"PFOR":
        raise ValueError("not a shard of token ids")
    _, n_docs, n_blocks, n_ids = struct.unpack_from("<IIIQ", data, 4)
    table = np.frombuffer(data, _DOC, n_docs, 24)
    index = np.frombuffer(data, "<u8", n_blocks, 24 + _DOC.itemsize * n_docs)
    base = 24 + _DOC.itemsize * n_docs + 8 * n_blocks
    ids = np.concatenate([np.zeros(0, np.uint32), *(decode_block(data, base + int(i)) for i in index)])
    if len(ids) != n_ids:
        raise ValueError("a shard of token ids is damaged")
    return [d if k else None for d, k in zip(table["doc"].tolist(), table["known"])], table["n"].astype(np.int64), ids


def read_range(data: bytes, start: int, stop: int) -> np.ndarray:
    """ids[start:stop] of a shard; only the blocks that hold them are decoded."""
    _, n_docs, n_blocks, n_ids = struct.unpack_from("<IIIQ", data, 4)
    start, stop = max(0, start), min(stop, n_ids)
    if start >= stop:
        return np.zeros(0, np.uint32)
    index = np.frombuffer(data, "<u8", n_blocks, 24 + _DOC.itemsize * n_docs)
    base = 24 + _DOC.itemsize * n_docs + 8 * n_blocks
    first = start // BLOCK_IDS
    got = np.concatenate([decode_block(data, base + int(i)) for i in index[first : (stop - 1) // BLOCK_IDS + 1]])
    return got[start - first * BLOCK_IDS : stop - first * BLOCK_IDS]


# ---------------------------------------------------------------- tokens


#: The tokenizer splits texts at blanks, and wherever letters meet other signs.  Of plain Latin
#: signs no one joins its neighbour in normal forms, and without apostrophes there are no
#: contractions; a piece between blanks that holds anything else is left whole.
_BLANK, _PLAIN, _LETTER = (np.zeros(256, bool) for _ in range(3))
_BLANK[[0x09, 0x0A, 0x0D, 0x20]] = True
_PLAIN[0x20:0x7F] = True
_PLAIN[[0x09, 0x0A, 0x0D]] = True
_PLAIN[0x27] = False
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOW_LATIN = np.arange(256, dtype=np.uint8)  # second bytes of U+00C0 to U+00FF
_LOW_LATIN[0x80:0x9F] += 32
_LOW_LATIN[0x97] -= 32


def _runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of texts, and the bytes with plain Latin pieces lower-cased."""
    full = ~_BLANK[raw]
    starts, ends = runs(full, offsets)
    latin = np.zeros(len(raw) + 1, bool)  # second bytes of plain Latin letters
    latin[1:-1] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    odd = ~(_PLAIN[raw] | latin[:-1] | latin[1:])
    odd[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
    count = np.append(0, np.cumsum(odd, dtype=np.int32))
    whole = count[ends] > count[starts]
    first, last = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
    first[starts] = last[ends] = True
    letter = _LETTER[raw]
    cut = np.flatnonzero((letter[1:] != letter[:-1]) & full[1:] & full[:-1]) + 1
    cut = cut[~first[cut]]
    if whole.any():
        cut = cut[~whole[np.searchsorted(starts, cut, "right") - 1]]
    first[cut] = last[cut] = True
    data = LOWER[raw]
    at = np.flatnonzero(latin[:-1])
    data[at] = _LOW_LATIN[data[at]]
    for s, e in zip(starts[whole], ends[whole]):
        data[s:e] = raw[s:e]
    return np.flatnonzero(first), np.flatnonzero(last), data


class Encoder:
    """The library's ids, remembered by run of signs; those of a text are its runs' in order.

    Runs are found by a hash in an open table; their bytes are compared, so that a collision of
    hashes changes nothing.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self._reset()

    def _reset(self):
        self.table, self.known, self.count, self.n_bytes = np.full(1 << _TABLE, -1, np.int32), 0, 0, 0
        self.hash, self.first, self.size, self.at = np.zeros(1 << 14, np.uint64), *(np.zeros(1 << 14, np.int64) for _ in range(3))
        self.flat, self.bytes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 18, np.uint8)

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        slot = (h >> np.uint64(64 - _TABLE)).astype(np.int64)
        out = self.table[slot]
        open_ = np.flatnonzero((out >= 0) & (self.hash[out] != h))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (1 << _TABLE) - 1
            out[open_] = self.table[slot[open_]]
            open_ = open_[(out[open_] >= 0) & (self.hash[out[open_]] != h[open_])]
        return out

    def _add(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Remember runs whose hashes are new and differ."""
        ids, size = self._library([data[s:e].tobytes().decode() for s, e in zip(starts.tolist(), ends.tolist())])
        n, m = self.known, self.known + len(h)
        self.hash, self.first, self.size, self.at = (self._room(x, m) for x in (self.hash, self.first, self.size, self.at))
        self.flat, self.bytes = self._room(self.flat, self.count + len(ids)), self._room(self.bytes, self.n_bytes + int((ends - starts).sum()))
        self.flat[self.count : self.count + len(ids)] = ids
        self.hash[n:m], self.size[n:m] = h, size
        self.first[n:m] = self.count + np.cumsum(size) - size
        length = ends - starts
        self.at[n:m] = self.n_bytes + np.cumsum(length) - length
        total = int(length.sum())
        self.bytes[self.n_bytes : self.n_bytes + total] = data[np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(total)]
        self.known, self.count, self.n_bytes = m, self.count + len(ids), self.n_bytes + total
        number, slot = np.arange(n, m, dtype=np.int32), (h >> np.uint64(64 - _TABLE)).astype(np.int64)
        while len(number):
            free = self.table[slot] < 0
            self.table[slot[free]] = number[free]
            left = self.table[slot] != number
            number, slot = number[left], (slot[left] + 1) & (1 << _TABLE) - 1

    def _segment(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, data = _runs(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        if self.known > MEMORY or self.n_bytes > MEMORY_BYTES:
            self._reset()
        h, length = hash_spans(data, starts, ends), ends - starts
        number = self._find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            _, one = np.unique(h[new], return_index=True)
            one = new[one]
            self._add(h[one], data, starts[one], ends[one])
            number[new] = self._find(h[new])
        size = self.size[number]
        end = np.cumsum(size)
        lo = np.cumsum(length) - length
        place = np.repeat(self.at[number] - lo, length) + np.arange(int(length.sum()))
        if place[-1] < len(self.bytes) and np.array_equal(self.bytes[np.minimum(place, len(self.bytes) - 1)], data[_cover(starts, ends, len(data))]):
            ids = self.flat[np.repeat(self.first[number] - end + size, size) + np.arange(end[-1])]
        else:  # two runs of one hash
            ids, size = self._library([data[s:e].tobytes().decode() for s, e in zip(starts.tolist(), ends.tolist())])
            end = np.cumsum(size)
        upto = np.append(0, end)[np.searchsorted(starts, offsets, "left")]
        return ids, np.diff(upto)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, and how many each has; a very long text goes in parts."""
        raw, offsets = text_buffer(column)
        if len(raw) <= PART or len(offsets) > 2:
            return self._segment(raw, offsets)
        blank = np.flatnonzero(_BLANK[raw])
        out, at = [], 0
        while at < len(raw):
            i = int(np.searchsorted(blank, at + PART))
            to = int(blank[i]) + 1 if i < len(blank) else len(raw)
            out.append(self._segment(raw[at:to], np.array([0, to - at]))[0])
            at = to
        return np.concatenate(out), np.array([sum(map(len, out))], np.int64)


def _cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n bytes lie in a run."""
    edge = np.zeros(n + 1, np.int8)
    edge[starts] = 1
    edge[ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


_encoders: dict[str, Encoder] = {}


def _encoder(file: str) -> Encoder:
    if file not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[file] = Encoder(file)
    return _encoders[file]


def shards(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """The shards of all documents; parts, and shards within a part, follow doc_id."""
    spark = docs.sparkSession

    def run(batches):
        from pyspark import TaskContext

        encoder, part, before = _encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        names, counts, ids, total = [], [], [], 0

        def out():
            data = encode_shard(names, np.concatenate(counts), np.concatenate(ids))
            row = [[part], [before], [len(names)], [total], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["part", "before", "n_docs", "n_ids", "data"])

        for b in chunks(batches):
            x, n = encoder.encode(b.column(1))
            x, n = np.insert(x, np.cumsum(n), np.uint32(end_id)), n + 1
            doc, end, at = b.column(0).to_pylist(), np.cumsum(n), 0
            while at < len(doc):
                lo = int(end[at] - n[at])
                to = min(int(np.searchsorted(end, lo + SHARD_IDS - total)) + 1, len(doc))
                names += doc[at:to]
                counts.append(n[at:to])
                ids.append(x[lo : end[to - 1]])
                total += len(ids[-1])
                if total >= SHARD_IDS:
                    yield out()
                    names, counts, ids, total, before = [], [], [], 0, before + total
                at = to
        if names:
            yield out()

    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the start of the text deals out rows of one id, or of none
    df = df.repartitionByRange(n, "doc_id", F.substring("text", 1, 8)).sortWithinPartitions("doc_id", "text")
    return df.mapInArrow(run, _SCHEMA)


def write_ids(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = END_ID) -> None:
    """Write the shards below path; nothing may be there yet."""
    shards(docs, tokenizer_file, end_id).write.parquet(path)


def _read(stored: DataFrame, digest: bool) -> DataFrame:
    """Documents of stored shards; one number for each partition written goes to the driver."""
    per = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, at = {}, 0
    for r in per:
        before[r.part], at = at, at + r.n
    rows = stored.select("part", "before", "data")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, data = (batch.column(c)[i].as_py() for c in range(3))
                docs, counts, ids = decode_shard(data)
                lo = np.append(0, np.cumsum(counts))
                starts = pa.array(before[part] + start + lo[:-1])
                if digest:
                    raw = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo[:-1], lo[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), starts, pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), starts, pa.ListArray.from_arrays(pa.array(lo, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "start", "ids"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" if digest else "doc_id long, start long, ids array<int>")


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, ids) of the shards below path."""
    return _read(spark.read.schema(_SCHEMA).parquet(path), False)


def digest(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the shards below path."""
    return _read(spark.read.schema(_SCHEMA).parquet(path), True)


def store_and_digest(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    return _read(scratch.keep(shards(docs, tokenizer_file, end_id), "token-ids"), True)
