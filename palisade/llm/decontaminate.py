"""Benchmark decontamination by greedy string tiling (operator 6).

Contract.  ``decontaminate(docs, bench)`` returns one row per input row: ``doc_id``,
``contaminated`` (some benchmark item is covered to at least ``coverage``), ``coverage`` (the
largest share of an item's words that tiles cover, 0 if none reaches the limit) and ``item_ids``
(the items covered, ascending).  ``remove_contaminated`` keeps the clean rows with all columns.

Method.  The words of the benchmark become rolling Karp-Rabin hashes of ``k`` words, the seeds.
Documents join the seeds; seeds in a row on one diagonal form matches.  Greedy string tiling then
marks, again and again, the longest match whose words are unmarked in both texts, until none of
``k`` words is left.  An item whose passages stand in another order is therefore still covered.
Items whose matches cannot reach the limit even unmarked are passed over before tiling (an upper
bound, so nothing is lost).

The benchmark is the stated query set: it is read in blocks of at most ``BLOCK_BYTES`` of text (or
one item); one pass over the documents hashes their words once and reads at most ``PASS_BLOCKS``
blocks, and its result is written before the next pass starts, so what is broadcast at a time is
bounded whatever the benchmark's size.  Documents are never shuffled.  The memory of a document and
an item grows with their maximal common runs, not with the pairs of places where a seed stands.

Edge cases: null or empty documents and items match nothing; an item of fewer than ``k`` words counts
where all of it stands in a row (its coverage is then 1), one of fewer than ``SHORTEST`` words matches
nothing, as its word would mark texts that never saw the benchmark; repeated items count by item_id; repeated rows are all returned; equally
long tiles are marked by document position, then item position; extra columns are ignored here and
kept by ``remove_contaminated``; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scratch
from .words import chunks, grams, words

#: Words of a seed and of the shortest tile; least covered share of an item.
SEED_WORDS, COVERAGE = 5, 0.5
#: Words of the shortest item that is looked for.
SHORTEST = 2
#: Bytes of benchmark text that are broadcast as one block, and blocks that one pass over the documents reads.
BLOCK_BYTES, PASS_BLOCKS = 4 << 20, 8
_BITS = 20


class Seeds:
    """The seeds of some items and where they stand."""

    def __init__(self, ids: list[int], texts: list[str | None], k: int):
        w = words(pa.array(texts, pa.large_string()))
        self.ids, self.k, self.hashes = np.array(ids, np.int64), k, w.hashes
        self.lo = w.lo
        g = grams(w.hashes, k)
        item = np.repeat(np.arange(len(ids)), np.diff(w.lo))[: len(g)]
        at = np.flatnonzero(np.arange(len(g)) + k <= w.lo[item + 1]) if len(g) else np.zeros(0, np.int64)
        order = at[np.argsort(g[at], kind="stable")]
        self.item, self.pos = item[order], order - w.lo[item[order]]
        self.seed, self.first = np.unique(g[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.map = np.zeros(1 << _BITS, bool)
        self.map[self.seed >> np.uint64(64 - _BITS)] = True
        size = np.diff(w.lo)
        self.short = {}
        for m in range(SHORTEST, k):
            items = np.flatnonzero(size == m)
            if len(items):
                own = np.array([grams(w.hashes[w.lo[i] : w.lo[i + 1]], m)[0] for i in items], np.uint64)
                order = np.argsort(own, kind="stable")
                self.short[m] = own[order], items[order]


def _ids(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The places of values in a sorted array, -1 for others."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _borders(slot: np.ndarray, beside: np.ndarray, at: np.ndarray, own: np.ndarray, next_to: np.ndarray, n: int) -> np.ndarray:
    """Pairs (position in the document, in the item) with the same seed and other words beside it.

    slot and beside: an item position's seed and the word beside it (n: none); own and next_to are the same
    of the document's positions ``at`` (-1: a word that the item lacks, or none).  Item positions are sorted by
    seed and word, so that those with the document's own word are passed over in one piece: only
    borders of maximal matches are made, never all pairs.
    """
    key = slot * (n + 1) + beside
    order = np.argsort(key, kind="stable")
    key = key[order]
    a, b = np.searchsorted(key, own * (n + 1)), np.searchsorted(key, (own + 1) * (n + 1))
    same = own * (n + 1) + next_to
    c = np.where(next_to < 0, a, np.searchsorted(key, same, "left"))
    d = np.where(next_to < 0, a, np.searchsorted(key, same, "right"))
    left, right = np.concatenate([a, d]), np.concatenate([c, b])
    many = right - left
    j = np.repeat(left - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
    pairs = np.stack([np.repeat(np.concatenate([at, at]), many), order[j]], 1)
    return pairs[np.lexsort((pairs[:, 0], pairs[:, 0] - pairs[:, 1]))]


def matches(doc: np.ndarray, item: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """All maximal common runs of at least k words: (position in doc, in item, words).

    ``at``: the positions of doc where a seed of the item may stand (all, if None).  Seeds are numbered
    by their words, so that no collision of hashes matters.  A run's first and last seed are found apart;
    sorted by diagonal they alternate, so memory grows with the runs, not with the pairs of places.
    """
    if min(len(doc), len(item)) < k:
        return np.zeros((0, 3), np.int64)
    at = np.arange(len(doc) - k + 1) if at is None else at
    known = np.unique(item)
    mine, theirs = _ids(item, known), _ids(doc, known)
    slot, own = mine[: max(0, len(item) - k + 1)], theirs[at]
    for j in range(1, k):
        at, own = at[own >= 0], own[own >= 0]
        seen, slot = np.unique(slot * len(known) + mine[j : j + len(slot)], return_inverse=True)
        if not len(at) or not len(seen):
            return np.zeros((0, 3), np.int64)
        step = theirs[at + j]
        own = np.where(step < 0, -1, _ids(own * len(known) + step, seen))
    at, own = at[own >= 0], own[own >= 0]
    n, none = len(known), np.array([-1])
    first = _borders(slot, np.append(n, mine)[: len(slot)], at, own, np.append(none, theirs)[at], n)
    last = _borders(slot, np.append(mine, n)[k : k + len(slot)], at, own, np.append(theirs, none)[at + k], n)
    return np.column_stack([first, last[:, 0] - first[:, 0] + k])


def _inside(tiles: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tile that holds a position starts and ends; (position + 1, position) if none does."""
    i = np.searchsorted(tiles[:, 0], at, "right") - 1
    held = (i >= 0) & (tiles[i, 1] > at)
    return np.where(held, tiles[i, 0], at + 1), np.where(held, tiles[i, 1], at)


def tile(runs: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from maximal runs (position in doc, in item, words); the tiles.

    Runs are taken by length, longest first, then by position.  Tiles are never shorter than the runs
    still to come, so a run is unmarked if its first and last words are, and what is left of another one is
    a single piece, which waits for its own length.
    """
    order = np.lexsort((runs[:, 1], runs[:, 0], -runs[:, 2]))
    runs, out, marked = runs[order], [], (set(), set())
    waiting = {int(x[0, 2]): [x] for x in np.split(runs, np.flatnonzero(np.diff(runs[:, 2])) + 1) if len(x)}
    lengths = [-n for n in waiting]
    heapq.heapify(lengths)
    while lengths:
        n = -heapq.heappop(lengths)
        level = np.concatenate(waiting.pop(n))
        level = level[np.lexsort((level[:, 1], level[:, 0]))]
        cut = []
        for i, (p, q) in enumerate(level[:, :2].tolist()):
            if p in marked[0] or p + n - 1 in marked[0] or q in marked[1] or q + n - 1 in marked[1]:
                cut.append(i)
                continue
            out.append((p, q, n))
            marked[0].update(range(p, p + n))
            marked[1].update(range(q, q + n))
        if not cut:
            continue
        p, q = level[cut, 0], level[cut, 1]
        done = np.array(out)
        start, end = np.zeros(len(cut), np.int64), np.full(len(cut), n)
        for side, at in ((0, p), (1, q)):
            tiles = done[np.argsort(done[:, side])]
            tiles = np.column_stack([tiles[:, side], tiles[:, side] + tiles[:, 2]])
            start = np.maximum(start, _inside(tiles, at)[1] - at)
            end = np.minimum(end, _inside(tiles, at + n - 1)[0] - at)
        rest = np.column_stack([p + start, q + start, end - start])[end - start >= k]
        rest = rest[np.argsort(rest[:, 2], kind="stable")]
        for x in np.split(rest, np.flatnonzero(np.diff(rest[:, 2])) + 1):
            if len(x):
                if int(x[0, 2]) not in waiting:
                    heapq.heappush(lengths, -int(x[0, 2]))
                waiting.setdefault(int(x[0, 2]), []).append(x)
    return out


def _whole(w, seeds: Seeds, found: dict) -> None:
    """Add the items shorter than a seed that stand whole in rows of a chunk."""
    for m, (own, items) in seeds.short.items():
        g = grams(w.hashes, m)
        lo, hi = np.searchsorted(own, g, "left"), np.searchsorted(own, g, "right")
        done = set()
        for at in np.flatnonzero(hi > lo):
            row = int(np.searchsorted(w.lo, at, "right")) - 1
            if at + m > w.lo[row + 1]:
                continue
            for x in items[lo[at] : hi[at]].tolist():
                if (row, x) not in done and np.array_equal(w.hashes[at : at + m], seeds.hashes[seeds.lo[x] : seeds.lo[x + 1]]):
                    done.add((row, x))
                    found.setdefault(row, []).append((int(seeds.ids[x]), 1.0))


def _covered(w, g: np.ndarray, seeds: Seeds, coverage: float) -> dict[int, list[tuple[int, float]]]:
    """For rows of a chunk: the items covered, with their coverage."""
    k, found = seeds.k, {}
    _whole(w, seeds, found)
    if not len(g) or not len(seeds.seed):
        return found
    at = np.flatnonzero(seeds.map[g >> np.uint64(64 - _BITS)])
    slot = np.minimum(np.searchsorted(seeds.seed, g[at]), len(seeds.seed) - 1)
    same = seeds.seed[slot] == g[at]
    at, slot = at[same], slot[same]
    row = np.searchsorted(w.lo, at, "right") - 1
    inside = at + k <= w.lo[row + 1]
    at, slot, row = at[inside], slot[inside], row[inside]
    cut = np.flatnonzero(np.diff(row)) + 1
    for part in np.split(np.arange(len(at)), cut):
        if not len(part):
            continue
        i = int(row[part[0]])
        for x in _reachable(seeds, np.unique(slot[part]), coverage):
            doc, text = w.hashes[w.lo[i] : w.lo[i + 1]], seeds.hashes[seeds.lo[x] : seeds.lo[x + 1]]
            share = sum(t[2] for t in tile(matches(doc, text, k, at[part] - w.lo[i]), k)) / len(text)
            if share >= coverage:
                found.setdefault(i, []).append((int(seeds.ids[x]), share))
    return found


def _reachable(seeds: Seeds, slots: np.ndarray, coverage: float) -> list[int]:
    """The items whose words the document's distinct seeds cover far enough, before any tile is marked.

    A place of the block is looked at once, however often its seed stands in the document.
    """
    many = seeds.last[slots] - seeds.first[slots]
    j = np.repeat(seeds.first[slots] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
    item, q = seeds.item[j], seeds.pos[j]
    order = np.lexsort((q, item))
    item, q = item[order], q[order]
    start = np.flatnonzero(np.append(True, np.diff(item) != 0))
    new = np.minimum(np.diff(q, append=0), seeds.k)
    new[np.append(start[1:], len(item)) - 1] = seeds.k
    items = item[start]
    size = seeds.lo[items + 1] - seeds.lo[items]
    return items[np.add.reduceat(new, start) >= coverage * size].tolist()


def _passes(bench: DataFrame, k: int):
    """(seeds in blocks of items, whether this pass is the last): a few blocks for each pass over the documents."""
    spark = bench.sparkSession
    bench = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n, made = max(1, -(-size // BLOCK_BYTES)), []
    if n > PASS_BLOCKS:  # sorted by block, so that each block's reading skips the others
        bench = scratch.keep(bench.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).repartitionByRange(n, "block").sortWithinPartitions("block"), "benchmark")
    else:
        bench = bench.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for b in range(n):
        rows = bench.where(F.col("block") == b).orderBy("item_id", "text").collect()
        if rows:
            made.append(spark.sparkContext.broadcast(Seeds([r.item_id for r in rows], [r.text for r in rows], k)))
        if len(made) == PASS_BLOCKS and b < n - 1:
            yield made, False
            for x in made:  # the pass is written by now
                x.unpersist()
            made = []
    if made:
        yield made, True


def _hits(column: pa.Array, blocks, coverage: float) -> dict[int, list[tuple[int, float]]]:
    w, found = words(column), {}
    g = grams(w.hashes, blocks[0].value.k)
    for seeds in blocks:
        for i, own in _covered(w, g, seeds.value, coverage).items():
            found.setdefault(i, []).extend(own)
    return found


def decontaminate(docs: DataFrame, bench: DataFrame, k: int = SEED_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """See the module's docstring."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0.0).alias("coverage"), F.array().cast("array<long>").alias("item_ids"))
    for blocks, last in _passes(bench, k):

        def mark(batches, blocks=blocks):
            for b in chunks(batches):
                most, items = b.column(2).to_pylist(), b.column(3).to_pylist()
                for i, hits in _hits(b.column(1), blocks, coverage).items():
                    most[i] = max(most[i], *(s for _, s in hits))
                    items[i] = sorted({*items[i], *(x for x, _ in hits)})
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(most, pa.float64()), pa.array(items, pa.list_(pa.int64()))], names=["doc_id", "text", "coverage", "item_ids"])

        df = df.mapInArrow(mark, "doc_id long, text string, coverage double, item_ids array<long>")
        df = df if last else scratch.keep(df, "marked")
    return df.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "coverage", "item_ids")


def remove_contaminated(docs: DataFrame, bench: DataFrame, k: int = SEED_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, with all their columns, that no benchmark item contaminates."""
    for blocks, last in _passes(bench, k):

        def clean(batches, blocks=blocks):
            for b in chunks(batches):
                found = _hits(b.column(b.schema.get_field_index("text")), blocks, coverage)
                yield b.filter(pa.array([i not in found for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
        docs = docs if last else scratch.keep(docs, "clean")
    return docs
