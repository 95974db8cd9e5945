"""Quality classifier: random-indexing vectors, a small network, calibrated (operator 8).

Contract.  ``features(docs)`` pools every document with the vectors of its own tokens, made from
every document; ``fit_features(features, labels)`` trains on at most ``bound`` labelled rows outside
the held-out fold; ``score_features(features, model)`` returns ``doc_id``, ``held_out``, ``score``
(0 to 1, higher: better) and ``predicted`` for every row.

Method.  A token is a run of word characters (lower-cased, with its pattern of capitals) or a run
of punctuation marks.  Its hash gives a sparse index vector of +1 and -1; the vector of a token is
the sum of the index vectors found within two places of it in the whole corpus, and each distinct
token (by its 64-bit hash) has a vector and a count of its own.  Groups of documents of bounded size
send the sums and counts of their distinct tokens, cut into ranges of the hash; a range adds up what
all groups sent and answers each with the totals of the tokens it sent (sums beyond a byte scaled to
one, as only their direction counts), so no task holds the whole vocabulary.  The documents are read
twice and must then be the same; if they are not, the task fails.  A document pools the unit vectors of its tokens, weighted down by corpus frequency:
mean, length of the mean, share of distinct tokens, and size.  A two-layer numpy network reads the
pooled vector; a temperature fitted on validation rows calibrates its probabilities.

``index``, ``fit`` and ``score`` are the form for texts outside the indexed table: their vectors fit
on the driver because tokens are folded into ``BUCKETS`` buckets, which distinct tokens share.  The
query does not use it.

Edge cases: null and empty texts pool to a zero vector and are scored; with no labelled rows, or
one class only, the score is the share of good rows (0.5 if none); repeated rows get equal scores;
labels, language, source, doc_id and extra columns are never read as features; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import labels as lab, scratch
from .words import IS_WORD, LOWER, chunks, hash_spans, mix, runs, text_buffer

#: Most labelled rows used, folds and the held-out one.
BOUND, PARTS, HELD = 8000, 3, 1
#: Buckets of tokens, dimensions, nonzero entries of an index vector, places to each side.
BUCKETS, DIM, NONZERO, REACH = 1 << 13, 48, 4, 2
_GROUPS = 64
#: Bytes of text of a group of documents and of the pieces it is read in, ranges of token hashes.
GROUP, PIECE, RANGES = 48 << 20, 1 << 23, 256


@dataclass
class Tokens:
    """Hashes of all tokens; lo has the n + 1 offsets of the rows."""

    hashes: np.ndarray
    lo: np.ndarray


def tokens(column: pa.Array) -> Tokens:
    """Word runs with their pattern of capitals, and punctuation runs."""
    raw, offsets = text_buffer(column)
    is_word = IS_WORD[raw]
    ws, we = runs(is_word, offsets)
    ps, pe = runs(~is_word & (raw > 0x20) & (raw != 0x7F), offsets)
    upper = np.append(0, np.cumsum((raw >= 0x41) & (raw <= 0x5A)))
    n_up, first = upper[we] - upper[ws], (raw[ws] >= 0x41) & (raw[ws] <= 0x5A) if len(ws) else np.zeros(0, bool)
    case = np.where(n_up == 0, 0, np.where((n_up == 1) & first, 1, np.where(n_up * 2 > we - ws, 2, 3)))
    wh = mix(hash_spans(LOWER[raw], ws, we) + case.astype(np.uint64))
    ph = hash_spans(raw, ps, pe)
    start = np.concatenate([ws, ps])
    order = np.argsort(start, kind="stable")
    lo = np.searchsorted(start[order], offsets, "left")
    lo[-1] = len(start)
    return Tokens(np.concatenate([wh, ph])[order], lo)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def accumulate(t: Tokens, table: np.ndarray) -> None:
    """Add the index vectors of the neighbours of every token, and its count, to the table."""
    n = len(t.hashes)
    if not n:
        return
    row = np.repeat(np.arange(len(t.lo) - 1), np.diff(t.lo))
    b = bucket(t.hashes) * (DIM + 1)
    flat = table.reshape(-1)
    flat += np.bincount(b + DIM, minlength=flat.size).astype(table.dtype)
    for j in range(NONZERO):
        x = mix(t.hashes + np.uint64(j + 1))
        place = ((x >> np.uint64(32)) % np.uint64(DIM)).astype(np.int64)
        sign = 1.0 - 2.0 * (x & np.uint64(1)).astype(float)
        for d in range(1, REACH + 1):
            if n > d:
                both = row[d:] == row[:-d]
                flat += np.bincount(b[d:][both] + place[:-d][both], sign[:-d][both], flat.size).astype(table.dtype)
                flat += np.bincount(b[:-d][both] + place[d:][both], sign[d:][both], flat.size).astype(table.dtype)


@dataclass
class Vectors:
    """Unit vectors of the buckets and the weight of each."""

    unit: np.ndarray
    weight: np.ndarray


def vectors(table: np.ndarray) -> Vectors:
    context, count = table[:, :DIM].astype(float), table[:, DIM].astype(float)
    return Vectors(_unit(context), _weight(count, count.sum()))


def _unit(context: np.ndarray) -> np.ndarray:
    return (context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _weight(count: np.ndarray, n: int) -> np.ndarray:
    return (1e-3 / (1e-3 + count / max(n, 1))).astype(np.float32)


def index(docs: DataFrame) -> Vectors:
    """Random-indexing vectors from every document."""

    def local(batches):
        table, any_row = np.zeros((BUCKETS, DIM + 1), np.int64), False
        for b in chunks(batches):
            accumulate(tokens(b.column(0)), table)
            any_row = True
        if any_row:
            parts = np.split(table, _GROUPS)
            yield pa.RecordBatch.from_arrays([pa.array(range(_GROUPS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["part", "data"])

    def total(batches):
        held = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(zlib.decompress(data.as_py()), np.int64)
                held[part] = held[part] + x if part in held else x
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "data"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(local, "part int, data binary")
    table = np.zeros((BUCKETS, DIM + 1), np.int64)
    for r in parts.repartition("part").mapInArrow(total, "part int, data binary").collect():
        table.reshape(_GROUPS, -1)[r.part] = np.frombuffer(r.data, np.int64)
    return vectors(table)


def pooled(t: Tokens, v: Vectors) -> np.ndarray:
    """The pooled features of every row."""
    n = len(t.lo) - 1
    out = np.zeros((n, DIM + 5), np.float32)
    b = bucket(t.hashes)
    for i in range(n):
        own = b[t.lo[i] : t.lo[i + 1]]
        if len(own):
            count = np.bincount(own, minlength=BUCKETS) if len(own) > BUCKETS else None
            kinds, times = (np.flatnonzero(count), count[count > 0]) if count is not None else np.unique(own, return_counts=True)
            out[i] = _pool(v.unit[kinds], v.weight[kinds], times)
    return out


def _pool(unit: np.ndarray, weight: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The features of a text from its distinct tokens and how often each occurs."""
    w, n = weight * times, times.sum()
    mean, plain = (w @ unit) / w.sum(), (times @ unit) / n
    return np.append(mean, (np.linalg.norm(mean), np.linalg.norm(plain), len(times) / n, np.log1p(n), times.max() / n))


# ---- a vector for each distinct token ---------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their bytes of one place together, which packs better."""
    return np.ascontiguousarray(x.reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _from_planes(data: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).reshape(-1).view(kind)


def _zip(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(x)


def _unzip(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _pack(context: np.ndarray, count: np.ndarray) -> bytes:
    """Context sums and counts of tokens; sums of one byte are stored as such."""
    small = np.abs(context).max(axis=1, initial=0) < 128
    wide = context[~small].astype(np.int64)
    head = np.array([len(count), len(wide)], np.int64).tobytes()
    return _zip(b"".join((head, _planes(count.astype(np.int64)), small.tobytes(), context[small].astype(np.int8).tobytes(), _planes(wide))))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _unzip(data)
    n, n_wide = np.frombuffer(raw, np.int64, 2)
    at = 16 + 8 * n
    count, small = _from_planes(raw[16:at], np.int64, n), np.frombuffer(raw, bool, n, at)
    context, at = np.zeros((n, DIM), np.int64), at + n
    context[small] = np.frombuffer(raw, np.int8, (n - n_wide) * DIM, at).reshape(-1, DIM)
    context[~small] = _from_planes(raw[at + (n - n_wide) * DIM :], np.int64, n_wide * DIM).reshape(-1, DIM)
    return context, count


def _scaled(context: np.ndarray) -> np.ndarray:
    """Directions of context sums in numbers of one byte; sums that fit stay as they are."""
    top = np.abs(context).max(axis=1, keepdims=True, initial=0)
    return np.where(top > 127, np.rint(context * (127 / np.maximum(top, 1))), context).astype(np.int64)


def token_sums(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens in order, the context sums and count of each, and every token's number."""
    kinds, local = np.unique(t.hashes, return_inverse=True)
    row = np.repeat(np.arange(len(t.lo) - 1, dtype=np.int32), np.diff(t.lo))
    context = np.zeros((len(kinds), DIM), np.int32)
    flat = context.reshape(-1)
    pairs = [(local[d:][both], local[:-d][both]) for d in range(1, REACH + 1) if len(row) > d for both in [row[d:] == row[:-d]]]
    for j in range(NONZERO):
        x = mix(kinds + np.uint64(j + 1))
        place = ((x >> np.uint64(32)) % np.uint64(DIM)).astype(np.int64)
        sign = 1 - 2 * (x & np.uint64(1)).astype(np.int32)
        for a, b in pairs:
            np.add.at(flat, a * DIM + place[b], sign[b])
            np.add.at(flat, b * DIM + place[a], sign[a])
    return kinds, context, np.bincount(local, minlength=len(kinds)), local


_ROW = "group long, kind int, place int, n long, ids binary, data binary"


def _row_batch(*rows):
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _ROW.split(", ")])


def _group_sums(group: int, pieces):
    """A row (kind 0) for each range of hashes with the sums of the group's tokens."""
    kinds, context, count = np.zeros(0, np.uint64), np.zeros((0, DIM), np.int32), np.zeros(0, np.int64)
    for _, t in pieces:
        new, c, k, _ = token_sums(t)
        every = np.union1d(kinds, new)
        both, many = np.zeros((len(every), DIM), np.int32), np.zeros(len(every), np.int64)
        for h, x, y in ((kinds, context, count), (new, c, k)):
            at = np.searchsorted(every, h)
            both[at] += x
            many[at] += y
        kinds, context, count = every, both, many
    step, total = np.uint64((1 << 64) // RANGES), int(count.sum())
    cut = np.concatenate([[0], np.searchsorted(kinds, np.arange(1, RANGES, dtype=np.uint64) * step), [len(kinds)]])
    # every range hears of every group, so that each knows the number of all tokens
    for i in range(RANGES):
        a, b = cut[i], cut[i + 1]
        yield _row_batch((group, 0, i, total, _zip(_planes(np.diff(kinds[a:b], prepend=np.uint64(0)))), _pack(context[a:b], count[a:b])))


def _group_bags(group: int, pieces):
    """Rows (kind 1) of the group's documents: their tokens' numbers among all of the group, as gaps, and counts."""
    held = []
    for ids, t in pieces:
        kinds, local = np.unique(t.hashes, return_inverse=True)
        n, m = len(t.lo) - 1, max(len(kinds), 1)
        key, times = np.unique(np.repeat(np.arange(n), np.diff(t.lo)) * m + local, return_counts=True)
        row, number = np.divmod(key, m)
        held.append((ids, kinds, np.bincount(row, minlength=n), number.astype(np.uint32), times.astype(np.uint32)))
    every = np.unique(np.concatenate([x[1] for x in held]))
    total = int(sum(x[4].sum(dtype=np.int64) for x in held))
    for i, (ids, kinds, many, number, times) in enumerate(held):
        number = np.searchsorted(every, kinds)[number]
        gap = np.diff(number, prepend=0)
        first = (np.cumsum(many) - many)[many > 0]
        gap[first] = number[first]
        known = np.array([x is not None for x in ids.to_pylist()])
        head = np.array([len(every), total], np.int64).tobytes() + known.tobytes() + _planes(ids.fill_null(0).to_numpy(zero_copy_only=False)) + _planes(many)
        yield _row_batch((group, 1, RANGES + i, len(many), _zip(head), _zip(_planes(gap.astype(np.uint32)) + _planes(times))))


def _by_group(batches, rows):
    """Documents (doc_id, text, part) to rows of groups, each read in pieces."""
    group, size, batches, ended = None, 0, chunks(batches), False

    def piece():
        nonlocal ended, size, group
        ids, t, part = [], [], 0
        while part < PIECE and not ended:
            b = next(batches, None)
            if b is None:
                ended = True
            else:
                group = b.column(2)[0].as_py() << 32 if group is None else group
                ids.append(b.column(0))
                t.append(tokens(b.column(1)))
                part += b.column(1).nbytes
        size += part
        if ids:
            shift = np.append(0, np.cumsum([len(x.hashes) for x in t]))
            lo = np.concatenate([x.lo[:-1] + s for x, s in zip(t, shift)] + [shift[-1:]])
            return pa.concat_arrays(ids), Tokens(np.concatenate([x.hashes for x in t]), lo)

    def pieces(first):
        nonlocal size
        size = 0
        yield first
        while size < GROUP and (x := piece()):
            yield x

    while x := piece():
        yield from rows(group, pieces(x))
        group += 1


def _add_up(batches):
    """Rows sorted by place: each group's sums of a range become the totals."""

    def answers(place, rows):
        hashes = [np.cumsum(_from_planes(x := _unzip(ids), np.uint64, len(x) // 8), dtype=np.uint64) for _, _, ids, _ in rows]
        kinds = np.unique(np.concatenate(hashes))
        context, count, n = np.zeros((len(kinds), DIM), np.int64), np.zeros(len(kinds), np.int64), sum(r[1] for r in rows)
        for h, r in zip(hashes, rows):
            at, (c, k) = np.searchsorted(kinds, h), _unpack(r[3])
            context[at] += c
            count[at] += k
        scaled = _scaled(context)
        for h, r in zip(hashes, rows):
            at = np.searchsorted(kinds, h)
            yield _row_batch((r[0], 0, place, len(h), np.array([r[1], n], np.int64).tobytes(), _pack(scaled[at], count[at])))

    now, rows = None, []
    for b in batches:
        for group, place, n, ids, data in zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4, 5))):
            if rows and place != now:
                yield from answers(now, rows)
                rows = []
            now = place
            rows.append((group, n, ids, data))
    if rows:
        yield from answers(now, rows)


def _pool_groups(batches):
    """Rows sorted by group, kind and place: the totals of a group's tokens, then its bags."""
    now, parts, unit, weight, own_total = None, [], None, None, 0
    for b in batches:
        for i in range(b.num_rows):
            group, kind, _, n, ids, data = (b.column(c)[i].as_py() for c in range(6))
            if group != now:
                now, parts, unit, weight = group, [], None, None
            if not kind:
                context, count = _unpack(data)
                own_total, every_total = np.frombuffer(ids, np.int64, 2).tolist()
                parts.append((_unit(context), _weight(count, every_total)))
                continue
            if unit is None:
                unit, weight = (np.concatenate(x) for x in zip(*parts))
                parts = []
            head, raw = _unzip(ids), _unzip(data)
            if np.frombuffer(head, np.int64, 2).tolist() != [len(unit), own_total]:
                raise RuntimeError("the documents were not the same when read again; write them to a table first")
            head = head[16:]
            known, doc, many = np.frombuffer(head, bool, n), _from_planes(head[n:], np.int64, n), _from_planes(head[9 * n :], np.int64, n)
            m = len(raw) // 8
            gap, times = _from_planes(raw, np.uint32, m), _from_planes(raw[4 * m :], np.uint32, m).astype(np.int64)
            x, end = np.zeros((n, DIM + 5), np.float32), np.cumsum(many)
            for k in np.flatnonzero(many):
                own = slice(end[k] - many[k], end[k])
                number = np.cumsum(gap[own], dtype=np.int64)
                x[k] = _pool(unit[number], weight[number], times[own])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=~known), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the pooled features (float32 bytes) of every row, with a vector for each distinct token."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a task reads a group's worth of text, if that leaves work for every core: fewer groups ask for a token
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many, cores = texts.rdd.getNumPartitions(), texts.sparkSession.sparkContext.defaultParallelism
    texts = texts.coalesce(max(1, min(many, max(-(-size // GROUP), 2 * cores))))
    # the number of the partition, which is the same in both readings
    texts = texts.withColumn("part", F.spark_partition_id())
    sums = texts.mapInArrow(lambda it: _by_group(it, _group_sums), _ROW)
    totals = sums.repartition("place").sortWithinPartitions("place").mapInArrow(_add_up, _ROW)
    # the texts are read a second time, in the same groups; bags meet the totals of their group
    bags = texts.mapInArrow(lambda it: _by_group(it, _group_bags), _ROW)
    return totals.unionByName(bags).repartition("group").sortWithinPartitions("group", "kind", "place").mapInArrow(_pool_groups, "doc_id long, x binary")


@dataclass
class Network:
    """Two layers, standardisation, temperature; share is used when there was nothing to learn."""

    vectors: Vectors | None
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    share: float

    def score(self, t: Tokens) -> np.ndarray:
        return self.of(pooled(t, self.vectors))

    def of(self, x: np.ndarray) -> np.ndarray:
        """The scores of pooled features."""
        if not self.layers:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(_logit((x - self.mean) / self.scale, self.layers) / self.temperature, -30, 30)))


def _logit(x, layers):
    a, b, c, d = layers
    return np.maximum(x @ a + b, 0) @ c + d[0]


def train(x: np.ndarray, y: np.ndarray, v: Vectors | None, hidden: int = 32, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on the logistic loss; the temperature is fitted on every seventh row."""
    y = np.asarray(y, float)
    if min((y == 1).sum(), (y == 0).sum()) < 4:
        return Network(v, np.zeros(x.shape[1]), np.ones(x.shape[1]), [], 1.0, float(y.mean()) if len(y) else 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z, rng = (x - mean) / scale, np.random.default_rng(seed)
    check = np.arange(len(y)) % 7 == 3
    zt, yt = z[~check], y[~check]
    p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, s, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(yt))
        for at in range(0, len(yt), 128):
            r = order[at : at + 128]
            h = np.maximum(zt[r] @ p[0] + p[1], 0)
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - yt[r]) / len(r)
            back = np.outer(e, p[2]) * (h > 0)
            grads = [zt[r].T @ back + 1e-3 * p[0], back.sum(0), h.T @ e + 1e-3 * p[2], np.array([e.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                p[i] = p[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    raw, yc = _logit(z[check], p), y[check]
    heat = np.geomspace(0.3, 5, 60)
    loss = [np.mean(np.logaddexp(0, -(2 * yc - 1) * raw / k)) for k in heat] if len(yc) else [0] * 60
    return Network(v, mean, scale, p, float(heat[int(np.argmin(loss))]) if len(yc) else 1.0, float(y.mean()))


def fit(docs: DataFrame, label_rows: DataFrame, v: Vectors, bound: int = BOUND) -> Network:
    """Pool the sampled texts on the executors and train on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def pool(batches):
        for b in chunks(batches):
            x = pooled(tokens(b.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    rows = lab.sampled_docs(docs, lab.sample(label_rows, "quality", PARTS, HELD, bound), bound)
    got = sorted(rows.mapInArrow(pool, "doc_id long, label int, x binary").collect())
    x = np.array([np.frombuffer(r.x, np.float32) for r in got]).reshape(len(got), DIM + 5)
    return train(x, np.array([r.label for r in got]), v)


def fit_features(feats: DataFrame, label_rows: DataFrame, bound: int = BOUND) -> Network:
    """Train on the driver on the features of the sampled rows; one row serves for an id with several."""
    rows = lab.sample(label_rows, "quality", PARTS, HELD, bound)
    got = feats.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "label").agg(F.max("x").alias("x")).select("doc_id", "label", "x")
    got = sorted(got.limit(bound).collect())
    x = np.array([np.frombuffer(r.x, np.float32) for r in got]).reshape(len(got), DIM + 5)
    return train(x, np.array([r.label for r in got]), None)


def score_features(feats: DataFrame, model: Network) -> DataFrame:
    """See the module's docstring."""
    shared = feats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, DIM + 5)
            s = np.asarray(shared.value.of(x), float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    df = feats.select("doc_id", "x", F.coalesce(lab.fold("doc_id", PARTS) == HELD, F.lit(False)).alias("held_out"))
    return df.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, label_rows: DataFrame) -> DataFrame:
    """Every row of docs, scored with vectors made from docs and a network trained on their labels."""
    feats = scratch.keep(features(docs), "features")
    return score_features(feats, fit_features(feats, label_rows))


def score(docs: DataFrame, model: Network) -> DataFrame:
    """Texts scored with the folded vectors of ``index``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in chunks(batches):
            s = np.asarray(shared.value.score(tokens(b.column(1))), float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(lab.fold("doc_id", PARTS) == HELD, F.lit(False)).alias("held_out"))
    return df.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
