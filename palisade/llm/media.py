"""Media columns: ISO media containers walked without decoding payloads (operator 1).

``wrap`` stores a text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, as 8-bit
samples of 64 bytes in an ISO base media file (ftyp, moov, mdat).  ``walk`` reads any such file:
it walks nested boxes, decodes the sample tables (stts, stsc, stsz/stz2, stco/co64, stss) and those of
fragments (trex, tfhd, trun) and gives codec, duration and the byte ranges of keyframes of every track;
payload bytes are located, never interpreted.
``media_features`` is the column operator for stored media; ``media_digest`` stores each text of a
table and returns what is read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
media_bytes, media_sha256, feature, codec, duration and n_keyframes.

Edge cases: null and empty texts are 64 bytes 0; any text length is stored whole (64-bit sizes
where 32 bits do not suffice); media that is null, has no track or is damaged (also by counts that
exceed the file, or samples outside it) gives ``None`` features
(``media_features``) instead of an error; equal texts give equal values, so repeated rows do; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import chunks, text_buffer

#: Bytes of a sample, samples of a chunk, samples between keyframes, samples a second.
SAMPLE, PER_CHUNK, KEY_EVERY, TIMESCALE = 64, 256, 16, 125
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def wrap(text: bytes) -> bytes:
    """An ISO media file whose samples are the padded bytes."""
    payload = text + b"\0" * (max(SAMPLE, -(-len(text) // SAMPLE) * SAMPLE) - len(text))
    n = len(payload) // SAMPLE
    n_chunks = -(-n // PER_CHUNK)
    keys = np.arange(1, n + 1, KEY_EVERY)
    entry = box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, 8000 << 16))
    whole, rest = divmod(n, PER_CHUNK)
    runs = [(1, PER_CHUNK, 1)] * bool(whole) + [(whole + 1, rest, 1)] * bool(rest)
    wide = len(payload) >= 1 << 31

    def moov(first: int) -> bytes:
        at = first + np.arange(n_chunks) * (PER_CHUNK * SAMPLE)
        stbl = box(
            b"stbl",
            full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, 0, struct.pack(">III", 1, n, 1)),
            full(b"stss", 0, 0, struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
            full(b"stsc", 0, 0, struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", 0, 0, struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", 0, 0, struct.pack(">I", n_chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"smhd", 0, 0, b"\0" * 4), box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), full(b"hdlr", 0, 0, b"\0" * 4, b"soun", b"\0" * 12, b"samples\0"), minf)
        trak = box(b"trak", full(b"tkhd", 0, 7, struct.pack(">IIIII", 0, 0, 1, 0, n), b"\0" * 16, _MATRIX, b"\0" * 8), mdia)
        return box(b"moov", full(b"mvhd", 0, 0, struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), b"\0" * 10, _MATRIX, b"\0" * 24, struct.pack(">I", 2)), trak)

    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    first = len(head) + len(moov(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return head + moov(first) + box(b"mdat", payload)


# ---------------------------------------------------------------- reading


@dataclass
class Track:
    """What a track's sample tables say."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    number: int = 0
    tables: dict = field(default_factory=dict)
    fragments: list = field(default_factory=list)
    offsets: np.ndarray | None = None
    sizes: np.ndarray | None = None
    keyframes: np.ndarray | None = None


def boxes(data, at: int, end: int):
    """(kind, start, start of body, end) of the boxes between two places; stops at a damaged one."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and at + 16 <= end:
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            return
        yield kind, at, body, at + size
        at += size


def _read(kind: bytes, data, at: int, end: int, track: Track) -> None:
    version = data[at]
    if kind == b"mdhd":
        track.timescale, track.duration = struct.unpack_from(">IQ", data, at + 20) if version else struct.unpack_from(">II", data, at + 12)
    elif kind == b"tkhd":
        track.number = struct.unpack_from(">I", data, at + (20 if version else 12))[0]
    elif kind == b"hdlr":
        track.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
    elif kind == b"stsd":
        track.codec = bytes(data[at + 12 : at + 16]).decode("latin-1").strip()
    elif kind in (b"stsz", b"stz2"):
        same, n = struct.unpack_from(">II", data, at + 4)
        if kind == b"stz2":
            width = same & 0xFF
            raw = np.frombuffer(data, ">u2" if width == 16 else np.uint8, n if width >= 8 else -(-n // 2), at + 12)
            track.tables[b"stsz"] = raw.astype(np.int64) if width >= 8 else np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n].astype(np.int64)
        else:
            if same * n > len(data):
                raise ValueError("more samples than the file holds")
            track.tables[kind] = np.full(n, same, np.int64) if same else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
    elif kind in (b"stts", b"stsc", b"stco", b"co64", b"stss"):
        wide = {b"stts": 2, b"stsc": 3}.get(kind, 1)
        n = struct.unpack_from(">I", data, at + 4)[0]
        track.tables[kind] = np.frombuffer(data, ">u8" if kind == b"co64" else ">u4", n * wide, at + 8).astype(np.int64).reshape(n, wide)


def _places(track: Track) -> None:
    """Offsets and sizes of all samples, and which are keyframes."""
    t = track.tables
    sizes, chunk = t[b"stsz"], t[b"co64"] if b"co64" in t else t[b"stco"]
    runs, chunk = t[b"stsc"], chunk.reshape(-1)
    per = np.zeros(len(chunk), np.int64)
    for i, (first, n, _) in enumerate(runs):
        per[first - 1 : runs[i + 1][0] - 1 if i + 1 < len(runs) else len(chunk)] = n
    per = np.diff(np.minimum(np.append(0, np.cumsum(np.minimum(per, len(sizes)))), len(sizes)))
    start = np.cumsum(np.append(0, per))[:-1]
    owner = np.repeat(np.arange(len(chunk)), per)[: len(sizes)]
    before = np.cumsum(np.append(0, sizes))
    track.offsets = chunk[owner] + before[: len(owner)] - before[start[owner]]
    track.sizes = sizes[: len(owner)]
    track.keyframes = t[b"stss"].reshape(-1) - 1 if b"stss" in t else np.arange(len(track.sizes))
    track.keyframes = track.keyframes[track.keyframes < len(track.sizes)]


def walk(data: bytes) -> list[Track]:
    """The tracks of an ISO media file, with the samples of their tables and then of all fragments."""
    tracks: list[Track] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    stack, fragments = [(0, len(data))], []
    while stack:
        inner = []
        for kind, start, body, stop in boxes(data, *stack.pop()):
            if kind == b"trak":
                tracks.append(Track())
                _descend(data, body, stop, tracks[-1])
            elif kind == b"trex":
                number, _, *rest = struct.unpack_from(">5I", data, body + 4)
                defaults[number] = tuple(rest)
            elif kind == b"moof":
                fragments.append((start, body, stop))
            elif kind in CONTAINERS:
                inner.append((body, stop))
        stack += reversed(inner)
    for place in fragments:
        _fragment(data, *place, {t.number: t for t in tracks}, defaults)
    for t in tracks:
        if {b"stsz", b"stsc"} <= t.tables.keys() and (b"stco" in t.tables or b"co64" in t.tables):
            _places(t)
        for offsets, sizes, keys, ticks in t.fragments:
            n = 0 if t.offsets is None else len(t.offsets)
            old = (np.zeros(0, np.int64),) * 3 if t.offsets is None else (t.offsets, t.sizes, t.keyframes)
            t.offsets, t.sizes, t.keyframes = (np.concatenate(x) for x in zip(old, (offsets, sizes, keys + n)))
        if t.offsets is not None and len(t.offsets) and (t.offsets.min() < 0 or int((t.offsets + t.sizes).max()) > len(data)):
            raise ValueError("samples beyond the file")
    return tracks


def _descend(data, at: int, end: int, track: Track) -> None:
    stack = [(at, end)]
    while stack:
        a, e = stack.pop()
        for kind, _, body, stop in boxes(data, a, e):
            if kind in CONTAINERS:
                stack.append((body, stop))
            else:
                _read(kind, data, body, stop, track)


def _fragment(data, start: int, at: int, end: int, tracks: dict[int, Track], defaults: dict) -> None:
    """Add a movie fragment's samples (tfhd, trun) to their tracks."""
    follows = start
    for kind, _, body, stop in boxes(data, at, end):
        if kind != b"traf":
            continue
        track, base, place = None, follows, None
        ticks = size = flags = 0
        for inner, _, b, _ in boxes(data, body, stop):
            has = struct.unpack_from(">I", data, b)[0] & 0xFFFFFF
            if inner == b"tfhd":
                number = struct.unpack_from(">I", data, b + 4)[0]
                track = tracks.get(number)
                ticks, size, flags = defaults.get(number, (0, 0, 0))
                b += 8
                base = start if has & 0x20000 else follows
                if has & 0x1:
                    base, b = struct.unpack_from(">Q", data, b)[0], b + 8
                b += 4 * bool(has & 0x2)
                if has & 0x8:
                    ticks, b = struct.unpack_from(">I", data, b)[0], b + 4
                if has & 0x10:
                    size, b = struct.unpack_from(">I", data, b)[0], b + 4
                if has & 0x20:
                    flags = struct.unpack_from(">I", data, b)[0]
            elif inner == b"trun" and track is not None:
                n, b, first = struct.unpack_from(">I", data, b + 4)[0], b + 8, None
                if has & 0x1:
                    place, b = base + struct.unpack_from(">i", data, b)[0], b + 4
                place = base if place is None else place
                if has & 0x4:
                    first, b = struct.unpack_from(">I", data, b)[0], b + 4
                columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if has & bit]
                if not columns and n * max(size, 1) > len(data):
                    raise ValueError("more samples than the file holds")
                table = np.frombuffer(data, ">u4", n * len(columns), b).astype(np.int64).reshape(n, len(columns))
                own = lambda bit, else_: table[:, columns.index(bit)] if bit in columns else np.full(n, else_, np.int64)  # noqa: B023, E731
                sizes, marks = own(0x200, size), own(0x400, flags).copy()
                if first is not None and n and 0x400 not in columns:
                    marks[0] = first
                after = place + np.cumsum(sizes)
                track.fragments.append((after - sizes, sizes, np.flatnonzero(marks & 0x10000 == 0), int(own(0x100, ticks).sum())))
                place = int(after[-1]) if n else place
        follows = place if place is not None else follows


def payload(data: bytes, track: Track) -> bytes:
    """The samples of a track, in order."""
    o, s = track.offsets, track.sizes
    if len(o) == 0:
        return b""
    cut = np.flatnonzero(o[1:] != o[:-1] + s[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut, len(o)) - 1
    return b"".join(data[o[a] : o[b] + s[b]] for a, b in zip(first, last))


def keyframe_ranges(track: Track) -> list[tuple[int, int]]:
    """(first byte, byte after the last) of each keyframe sample."""
    at = track.offsets[track.keyframes]
    return list(zip(at.tolist(), (at + track.sizes[track.keyframes]).tolist()))


def _described(t: Track) -> dict:
    delta = t.tables.get(b"stts")
    ticks = int((delta[:, 0] * delta[:, 1]).sum()) if delta is not None and len(delta) else 0
    ticks = ticks + sum(x[3] for x in t.fragments) or t.duration
    return {"codec": t.codec, "handler": t.handler, "duration": ticks / t.timescale if t.timescale else 0.0, "n_samples": len(t.sizes), "keyframes": keyframe_ranges(t)}


def describe(media: bytes | None) -> dict | None:
    """Codec, handler, duration in seconds, samples and keyframe byte ranges of the first track, and of all ``tracks``."""
    try:
        tracks = [_described(t) for t in walk(media) if t.offsets is not None] if media else []
    except (struct.error, ValueError, IndexError, OverflowError, MemoryError):
        return None
    return {**tracks[0], "tracks": tracks} if tracks else None


_TRACK = "codec string, handler string, duration double, n_samples long, keyframes array<struct<start:long,stop:long>>"
MEDIA = f"{_TRACK}, tracks array<struct<{_TRACK.replace(' string', ':string').replace(' double', ':double').replace(' long', ':long').replace(' array', ':array')}>>"


def _row(t: dict) -> dict:
    return {**t, "keyframes": [{"start": a, "stop": b} for a, b in t["keyframes"]]}


def media_features(df: DataFrame, column: str = "media", into: str = "media_features") -> DataFrame:
    """df with a struct column of the features of a binary column of stored media."""
    @F.pandas_udf(MEDIA)
    def read(media: pd.Series) -> pd.DataFrame:
        rows = [describe(m) for m in media]
        rows = [{**_row(r), "tracks": [_row(t) for t in r["tracks"]]} if r else {} for r in rows]
        return pd.DataFrame({k: [r.get(k) for r in rows] for k in ("codec", "handler", "duration", "n_samples", "keyframes", "tracks")})

    return df.withColumn(into, read(F.col(column)))


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration double, n_keyframes long"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as stored media."""

    def run(batches):
        for b in chunks(batches):
            raw, at = text_buffer(b.column(1))
            media = [wrap(raw[at[i] : at[i + 1]].tobytes()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every text as media and digest what the stored bytes say."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, n, media in zip(*(c.to_pylist() for c in b.columns)):
                t = walk(media)[0]
                p, seen = payload(media, t), describe(media)
                spans = np.array(seen["keyframes"], np.int64)
                feature = f"{seen['codec']}/{seen['handler']};samples={seen['n_samples']};seconds={seen['duration']:.3f};keyframes={len(spans)};first={spans[0][0]}-{spans[0][1]};last={spans[-1][0]}-{spans[-1][1]};ranges_crc32={zlib.crc32(spans.astype('<i8').tobytes())}"
                rows.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-SAMPLE:]), len(media), hashlib.sha256(media).hexdigest(), feature, seen["codec"], seen["duration"], len(spans)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=[x.split()[0] for x in _DIGEST.split(", ")])

    return store(docs).mapInArrow(run, _DIGEST)
