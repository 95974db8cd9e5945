"""N-gram Jaccard join by a MinHash LSH forest (operator 2).

Contract.  ``jaccard_join(docs)`` returns one row per input row: ``doc_id``, ``class_id`` (the
least doc_id of its group: rows joined, directly or through others, by a Jaccard similarity of at
least the threshold over word shingles), ``n_links`` (the other rows whose similarity to this row
reaches the threshold) and ``n_copies`` (rows with the same shingle set, itself included).
``keep_one(docs)`` returns the rows of docs, with all columns, that stay when one of each group is
kept.

Method.

1. Every text becomes its set of five-word shingles and a path of ``levels`` MinHash values in each
   of ``trees`` prefix tries.  Rows with one shingle set, known by two 64-bit hashes, are one
   representative with a weight, so a group of exact copies never meets itself.
2. The tries are sorted by their prefixes of the shortest length that may be needed: the one at
   which a pair at the threshold still reaches the target recall (:func:`forest_depth`).  Nodes of
   one representative need no work.  Members are counted in salted parts; large nodes are split
   into pairs of blocks, bounded in rows and bytes.
3. In each block the paths alone tell how long a prefix every pair shares in any trie.  A pair
   belongs to the trie, the first one, in which its matched prefix is longest; only members that
   own a pair whose sizes allow a link go on, with the lengths of their prefixes.
4. Pairs are verified exactly on the full sets, those of the longest prefixes first.  From the
   similarities of the links found so far follows how far the prefix must be shortened so that less
   than ``MISSED`` links are missing (:func:`shortened`); this is repeated until it need not be
   shortened any more.  Only counts for each row, a spanning forest of the links and a histogram of
   similarities leave the task, never the pairs.
5. Groups are the connected components of the spanning forests (large-star / small-star).

Edge cases: null and empty texts (and texts without a word) have no shingles, link to nothing and
are a class of their own; a text of one to four words is one shingle of all its words; repeated
rows are copies of each other and are all returned; rows of one doc_id with different texts are rows
of their own, each with the class of its text (then two groups may bear one number, and ``keep_one``
keeps a row of both); a row without a doc_id is linked like any other and has the class of its text,
null if no row of the group has an id; other columns are ignored, whatever their names; an empty
table gives an empty result.  ``keep_one`` keeps the row of the least doc_id (a null one comes last),
of rows that agree in doc_id and text one, and all rows without words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scratch
from .words import chunks, mix, shingles, words

#: Words per shingle, least similarity, tries, MinHash values of a path, and target recall of a pair.
SHINGLE, THRESHOLD, TREES, LEVELS, RECALL = 5, 0.8, 12, 5, 0.9995
#: Links that may still be missing, by estimate, when the prefix is shortened no more.
MISSED = 0.5
#: Most members of a block, on average, and bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 1 << 24
#: Parts of a trie node when its members are counted.
SALTS = 32
#: Most rows of keys (24 bytes each) that are broadcast.
BROADCAST_IDS = 500_000
_BINS = 100


def forest_depth(threshold: float, recall: float, trees: int, levels: int) -> int:
    """The longest matched prefix at which a pair at the threshold still reaches the recall."""
    for depth in range(levels, 1, -1):
        if found_share(threshold, depth, trees) >= recall:
            return depth
    return 1


def found_share(similarity, depth: int, trees: int):
    """How likely a pair shares a prefix of this length in one of the tries at least."""
    return 1 - (1 - similarity**depth) ** trees


def missing(histogram: dict[int, int], threshold: float, done: int, depth: int, trees: int) -> float:
    """An upper estimate of the links that prefixes of ``depth`` miss, from those found down to ``done``.

    A link found with probability p stands for 1 / p links; three links at the threshold are added,
    as many as may be unseen when none was seen.
    """
    at = [max(threshold, b / _BINS) for b in histogram] + [threshold]
    return sum(n / found_share(s, done, trees) * (1 - found_share(s, depth, trees)) for n, s in zip([*histogram.values(), 3], at))


def shortened(histogram: dict[int, int], threshold: float, done: int, least: int, trees: int) -> int:
    """The longest prefix, ``done`` at most and ``least`` at least, that misses less than MISSED links."""
    for depth in range(done, least, -1):
        if missing(histogram, threshold, done, depth, trees) < MISSED:
            return depth
    return least


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minhash(sh: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values, of 32 bits, of a shingle set."""
    a = _multipliers(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(sh), 8192):
            low = np.minimum(low, (sh[at : at + 8192, None] * a).min(axis=0))
    return (low >> np.uint64(32)).astype(">u4")


def _identity(sh: np.ndarray) -> tuple[int, int]:
    """Two hashes that stand for a shingle set."""
    with np.errstate(over="ignore"):
        return int(np.sum(mix(sh)).astype(np.int64)), int(np.sum(mix(sh ^ np.uint64(0xD1B54A32D192ED03))).astype(np.int64))


def _sign(batches, k, n_hash):
    """doc_id, hash of the text, two 64-bit hashes of the set, its size and its paths."""
    for b in chunks(batches):
        w = words(b.column(1))
        n = b.num_rows
        one, two, size, path = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32), []
        for i in range(n):
            sh = shingles(w, i, k)
            size[i] = len(sh)
            if len(sh):
                one[i], two[i] = _identity(sh)
            path.append(minhash(sh, n_hash).tobytes() if len(sh) else b"")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(one), pa.array(two), pa.array(size), pa.array(path, pa.binary())], names=["doc_id", "th", "h1", "h2", "size", "path"])


_ROW = "tree int, node long, a int, b int, rep long, side int, path binary, weight long, sh binary"


def _sets(batches, k):
    """Texts of representatives (rep, h1, h2, weight, path, text, spots) to one row for each block they
    are in, with the sorted set as little-endian 64-bit values."""
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary())
    rows, size = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _ROW.split(", ")])

    for b in chunks(batches):
        w = words(b.column(5))
        for i, (rep, h1, h2, weight, path, spots) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 6)))):
            sh = shingles(w, i, k)
            if not len(sh) or _identity(sh) != (h1, h2):
                continue  # another text whose hash is the same
            for x in spots:
                rows.append((x["tree"], x["node"], x["a"], x["b"], rep, x["side"], path, weight, sh.tobytes()))
                size += sh.nbytes
                if size > 1 << 23 or len(rows) > 5000:
                    yield out()
                    rows, size = [], 0
    if rows:
        yield out()


def overlap(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of sets, by a product over the values that are shared."""
    n = len(sets)
    if n == 2:
        x = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), x], [x, len(sets[1])]], np.float32)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = count > 1
    use = shared[col]
    col, row = (np.cumsum(shared) - 1)[col[use]], row[use]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    out = np.zeros((n, n), np.float32)
    wide = max(64, (4 << 20) // n)
    for at in range(0, int(shared.sum()), wide):
        i, j = np.searchsorted(col, [at, at + wide])
        m = np.zeros((n, min(wide, int(shared.sum()) - at)), np.float32)
        m[row[i:j], col[i:j] - at] = 1
        out += m @ m.T
    return out


def owned(paths: np.ndarray, tree: int) -> np.ndarray:
    """The length of the longest prefix that each pair shares in any trie, if this trie owns the pair, else 0.

    paths: (rows, tries, levels).  The owner is the first trie in which that longest prefix stands.
    """
    n, trees, levels = paths.shape

    def shared(t):
        out, same = np.zeros((n, n), np.int8), np.ones((n, n), bool)
        for d in range(levels):
            x = paths[:, t, d]
            same &= x[:, None] == x[None, :]
            out += same
        return out

    if n * n * trees * levels <= 1 << 20:
        every = np.logical_and.accumulate(paths[:, None] == paths[None, :], axis=3).sum(3, dtype=np.int8)
        every = np.moveaxis(every, 2, 0)
    else:
        every = map(shared, range(trees))
    before, after, own = np.zeros((n, n), np.int8), np.zeros((n, n), np.int8), None
    for t, x in enumerate(every):
        if t < tree:
            np.maximum(before, x, out=before)
        elif t == tree:
            own = x.copy()
        else:
            np.maximum(after, x, out=after)
    own[(before >= own) | (after > own)] = 0
    np.fill_diagonal(own, 0)
    return own


def _blocks(batches, columns: int):
    """Streams sorted rows (tree, node, a, b, ...) block by block: (key, rows)."""
    key, rows = None, []
    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(columns))):
            if r[:4] != key:
                if rows:
                    yield key, rows
                key, rows = r[:4], []
            rows.append(r[4:])
    if rows:
        yield key, rows


def _pairs(key, rows, size: np.ndarray, threshold: float, trees: int, levels: int) -> np.ndarray:
    """Of a block whose rows start with (rep, side, path): prefix lengths of owned pairs that may be links."""
    tree, _, a, b = key
    paths = np.frombuffer(b"".join(r[2] for r in rows), ">u4").reshape(len(rows), trees, levels)
    own = owned(paths, tree)
    if a != b:
        side = np.array([r[1] for r in rows])
        own[side[:, None] == side[None, :]] = 0
    low = threshold * size - 1e-9
    own[(size[:, None] < low[None, :]) | (size[None, :] < low[:, None])] = 0
    return own


_MEMBER = "tree int, node long, a int, b int, rep long, side int, lengths int"


def _owners(batches, threshold: float, trees: int, levels: int, depth: int):
    """Of blocks of paths: the members that own pairs, with a bit for each length of their prefixes."""
    names, found = [x.split()[0] for x in _MEMBER.split(", ")], []

    def out():
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], names=names)

    for key, rows in _blocks(batches, 8):
        if len(rows) < 2:
            continue
        own = _pairs(key, rows, np.array([r[3] for r in rows], np.int64), threshold, trees, levels)
        bits = np.zeros(len(rows), np.int64)
        for d in range(depth, levels + 1):
            bits |= (own == d).any(1).astype(np.int64) << d
        found += [(*key, rows[i][0], rows[i][1], int(bits[i])) for i in np.flatnonzero(bits)]
        if len(found) > 20_000:
            yield out()
            found = []
    if found:
        yield out()


def _linked(sets: list[np.ndarray], todo: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs to do are links, and all their similarities."""
    size = np.array([len(s) for s in sets], np.int64)
    if np.count_nonzero(todo) <= 6 * len(sets):
        both = np.zeros(todo.shape, np.int64)
        for i, j in np.argwhere(np.triu(todo, 1)):
            x, y = (sets[i], sets[j]) if size[i] < size[j] else (sets[j], sets[i])
            both[i, j] = both[j, i] = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
    else:  # exact in float32 up to 2**24, beyond every size of a set in a block
        both = np.rint(overlap(sets)).astype(np.int64)
    union = size[:, None] + size[None, :] - both
    return todo & (both >= threshold * union - 1e-9), both / union


_LINK = "rep long, links long, root long, bin int, n long"


def _node_links(batches, threshold: float, trees: int, levels: int, top: int, low: int):
    """Of blocks with sets and prefixes of lengths top to low: links of each member and a spanning
    forest; and similarities, by bin."""
    found, bins = [], np.zeros(_BINS + 1, np.int64)

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=[x.split()[0] for x in _LINK.split(", ")])

    for key, rows in _blocks(batches, 9):
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        own = _pairs(key, rows, np.array(list(map(len, sets)), np.int64), threshold, trees, levels)
        link, like = _linked(sets, (own >= low) & (own <= top), threshold)
        if not link.any():
            continue
        bins += np.bincount((like[np.triu(link)] * _BINS).astype(np.int64), minlength=_BINS + 1)
        counts = link.astype(np.int64) @ np.array([r[3] for r in rows], np.int64)
        parent = np.full(len(rows), -1)
        for root in np.flatnonzero(counts).tolist():
            if parent[root] < 0:
                parent[root], front = root, [root]
                while front:
                    reached = np.flatnonzero(link[front].any(axis=0) & (parent < 0))
                    parent[reached] = root
                    front = reached.tolist()
        found += [(rows[i][0], int(counts[i]), rows[parent[i]][0], None, None) for i in np.flatnonzero(counts)]
        if len(found) > 20_000:
            yield out(found)
            found = []
    found += [(None, None, None, b, int(bins[b])) for b in np.flatnonzero(bins).tolist()]
    if found:
        yield out(found)


def components(edges: DataFrame) -> DataFrame:
    """(node, class_id): the least node of each connected component of the edges (u, v).

    Alternates large-star and small-star until nothing changes; each round is checkpointed.
    """
    edges = scratch.checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = (edges.count(), None)

    def with_least(pairs):
        """The pairs with the least neighbour of u; a node with many neighbours is not dealt to one task."""
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return pairs.join(F.broadcast(low) if before[0] <= BROADCAST_IDS else low, "u")

    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = with_least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = scratch.checkpoint(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("class_id")).union(edges.select(F.col("v"), F.col("v"))).distinct()
        before = now


def _small(df: DataFrame) -> DataFrame:
    """A table of keys, broadcast if its counted size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))


def _links(docs: DataFrame, reps: DataFrame, k: int, threshold: float, trees: int, levels: int, depth: int) -> DataFrame:
    """(rep, links, root): what the forest finds among representatives."""
    # prefixes by their hash: of two that agree, the paths tell in the block
    node = [F.xxhash64(F.expr(f"substring(path, {t * levels * 4 + 1}, {depth * 4})")) for t in range(trees)]
    # a node may hold a great part of all rows: it is counted and joined in salted parts
    part = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int").alias("salt")
    member = reps.select("rep", "size", part, F.posexplode(F.array(*node)).alias("tree", "node"))
    parts = member.groupBy("tree", "node", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("sum"))
    full = parts.groupBy("tree", "node").agg(F.sum("n").alias("members"), F.sum("sum").alias("total")).where("members > 1")
    full = full.withColumn("blocks", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("total") * 8 / BLOCK_BYTES)).cast("int"))
    full = parts.select("tree", "node", "salt").join(full.select("tree", "node", "blocks"), ["tree", "node"])
    placed = member.join(full, ["tree", "node", "salt"]).withColumn("side", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks").cast("long")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("tree", "node", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "rep", "side")

    key = ["tree", "node", "a", "b"]
    rows = placed.join(reps.select("rep", "path", "size"), "rep").select(*key, "rep", "side", "path", "size")
    rows = rows.repartition(*key).sortWithinPartitions(*key)
    todo = scratch.keep(rows.mapInArrow(lambda it: _owners(it, threshold, trees, levels, depth), _MEMBER), "owners")

    wanted = todo.select("rep").distinct().join(reps, "rep").select("rep", "h1", "h2", "weight", "path", F.col("th").alias("_th"), F.col("some_id").alias("_id"))
    wanted = scratch.keep(wanted, "wanted")
    few = _small(wanted.select("_th", "_id"))
    texts = _texts(docs)
    texts = texts.join(few, (texts.th == F.col("_th")) & texts.doc_id.eqNullSafe(F.col("_id")), "left_semi")
    texts = texts.groupBy("th", "doc_id").agg(F.first("text").alias("text"))
    texts = texts.join(wanted, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = scratch.keep(texts.select("rep", "h1", "h2", "weight", "path", "text"), "texts")

    found, histogram, top, low = None, {}, levels, levels
    while True:
        bits = sum(1 << x for x in range(low, top + 1))
        spots = todo.where(F.col("lengths").bitwiseAND(bits) != 0).groupBy("rep").agg(F.collect_list(F.struct(*key, "side")).alias("spots"))
        rows = texts.join(spots, "rep").select("rep", "h1", "h2", "weight", "path", "text", "spots").mapInArrow(lambda it: _sets(it, k), _ROW)
        rows = rows.repartition(*key).sortWithinPartitions(*key)
        made = scratch.keep(rows.mapInArrow(lambda it, top=top, low=low: _node_links(it, threshold, trees, levels, top, low), _LINK), f"links-{low}")
        found = made if found is None else found.unionByName(made)
        for r in made.where("bin is not null").groupBy("bin").agg(F.sum("n").alias("n")).collect():
            histogram[r.bin] = histogram.get(r.bin, 0) + r.n
        to = shortened(histogram, threshold, low, depth, trees)
        if to == low:
            break
        top, low = low - 1, to
    return found.where("rep is not null").select("rep", "links", "root")


def _grouped(docs: DataFrame, k: int, threshold: float, trees: int, levels: int, recall: float) -> DataFrame:
    """Every row of docs: doc_id, th, class_id, n_links, n_copies, and group (null without words)."""
    depth = forest_depth(threshold, recall, trees, levels)
    schema = "doc_id long, th long, h1 long, h2 long, size int, path binary"
    signed = scratch.keep(_texts(docs).mapInArrow(lambda it: _sign(it, k, trees * levels), schema), "signatures")
    some = F.min(F.struct("th", "doc_id"))
    reps = signed.where("size > 0").groupBy("h1", "h2").agg(some.alias("some"), F.min("doc_id").alias("least_id"), F.count("*").alias("weight"), F.first("size").alias("size"), F.first("path").alias("path"))
    # the number is fixed by writing the table
    reps = reps.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", F.col("some.th").alias("th"), F.col("some.doc_id").alias("some_id"), "least_id", "weight", "size", "path")
    reps = scratch.keep(reps, "representatives")
    links = _links(docs, reps, k, threshold, trees, levels, depth)

    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    joined = joined.select(F.col("node").alias("rep"), F.col("class_id").alias("group"))
    joined = scratch.keep(joined.join(counts, "rep").join(reps.select("rep", "least_id"), "rep"), "joined")
    least = joined.groupBy("group").agg(F.min("least_id").alias("class_id"))
    known = joined.select("rep", "group", "links").join(least, "group")
    known = reps.select("h1", "h2", "rep", "least_id", "weight").join(known, "rep", "left")
    known = known.select(
        "h1", "h2", F.coalesce("group", "rep").alias("group"), F.when(F.col("group").isNull(), F.col("least_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("weight").alias("n_copies"),
    )
    worded = signed.where("size > 0").select("doc_id", "th", "h1", "h2").join(known, ["h1", "h2"]).drop("h1", "h2")
    zero = F.lit(0).cast("long")
    blank = signed.where("size = 0").select("doc_id", "th", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("class_id"), zero.alias("n_links"), (zero + 1).alias("n_copies"))
    return worded.unionByName(blank)


def jaccard_join(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, levels: int = LEVELS, recall: float = RECALL) -> DataFrame:
    """See the module's docstring."""
    return _grouped(docs, k, threshold, trees, levels, recall).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, levels: int = LEVELS, recall: float = RECALL) -> DataFrame:
    """One row of each group, with all columns of docs; see the module's docstring."""
    rows = _grouped(docs, k, threshold, trees, levels, recall).where("group is not null")
    keys = scratch.keep(rows.groupBy("group", "doc_id", "th").agg(F.count("*").alias("n")), "groups")
    first = keys.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("x"), F.sum("n").alias("rows"))
    first = _small(first.where("rows > 1").drop("rows"))
    stays = F.col("doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("th") == F.col("x.th"))
    marks = keys.join(first, "group").where(~stays | (F.col("n") > 1)).select("doc_id", "th", stays.alias("again"))
    marks = scratch.keep(marks.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "again"), "marks")

    row = docs.select(F.struct(*docs.columns).alias("_row"))
    same = F.col("_row")["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("_row")["text"].cast("string")) == F.col("_th"))
    kept = row.join(_small(marks), same, "left_anti")
    again = marks.where("again")
    if not again.isEmpty():
        kept = kept.unionByName(row.join(_small(again), same).dropDuplicates(["_id", "_th"]).select("_row"))
    return kept.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
