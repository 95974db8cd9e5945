"""Periodic runs of words by an all-lag scan (operator 11).

Contract.  ``find(docs)`` returns for every row ``doc_id``, ``n_runs``, the longest run's ``start``
(word number from 0), ``length``, ``period`` and ``exponent_milli`` (ties: least start, then period;
nulls if there is none), ``runs_sha256`` (of every run's ``start,length,period`` and a line feed, by
start, then period) and ``collapsed_sha256`` (of the words that stay, joined by a blank).  Words are
what stands between ASCII white space.  A run is a maximal stretch of at least ``LEAST`` words and
``EXPONENT`` periods whose smallest period is ``period``; a word goes if a run holds it after that
run's first period.  ``find`` takes a rule that rewrites the words first; :func:`planted` is the
one of the registered query (rows without an id are left as they are).  ``runs_of`` is the same for
one list of words.

Method.  Words become numbers.  For every lag up to n / EXPONENT the numbers are compared with
themselves, shifted by the lag; true stretches are measured by their ends, and those that are long
enough are runs.  Of stretches with one start and one end the least lag is the smallest period (the
others are its multiples).  A lag is compared in full only if it can have a run: a stretch of the
least length that the lag asks for cannot avoid all of the places that stand ``least length -
GRAM + 1`` apart, so hashes of ``GRAM`` words are compared there first, for all lags between a power
of two and the next in one step.  Hashes only rule lags out: the comparison itself is exact.

Scale.  Documents are never grouped.  A document whose lags would take more than ``WORK`` comparisons
is dealt out: its text goes to as many rows as that takes, each with a range of lags, spread over all
tasks; runs (fewer than words) then meet the text again.  All others are done where they are read.

Edge cases: null, empty and blank texts have no words, no runs and the hash of nothing; repeated
rows, also long ones, are each returned; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Words of the shortest run, least number of periods, words that any stretch of equal words has at least.
LEAST, EXPONENT = 12, 2
GRAM = LEAST - LEAST // EXPONENT
#: Comparisons of one row's lags beyond which they are dealt out, and bytes that count as a word there.
WORK, WORD_BYTES = 1 << 28, 4

_RUNS = "array<struct<start:long,length:long,period:long>>"
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def least_stretch(lag: int) -> int:
    """Equal words in a row that a run of this period has at least."""
    return max(LEAST - lag, lag * (EXPONENT - 1))


def numbers(words: list) -> np.ndarray:
    """A number for each word, the same for equal words."""
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def _grams(ids: np.ndarray) -> np.ndarray:
    n = len(ids) - GRAM + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            out = (out + ids[j : j + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def hopeful(ids: np.ndarray, lo: int, hi: int) -> list[int]:
    """The lags of lo <= lag < hi that can have a run; none if no GRAM words in a row occur twice."""
    grams, out = _grams(ids), []
    n, order = len(grams), np.sort(grams)
    if not (order[1:] == order[:-1]).any():
        return out
    padded = np.zeros(2 * n + hi, np.uint64)
    padded[:n] = grams
    while lo < min(hi, n):
        to = min(hi, 2 * lo)
        step = min(least_stretch(q) for q in {lo, to - 1, min(max(lo, GRAM), to - 1)}) - GRAM + 1
        here = grams[: n - lo : step]
        # row i holds the hashes that stand lo to to - 1 words after here[i]
        later = np.ndarray((len(here), to - lo), np.uint64, padded, 8 * lo, (8 * step, 8))
        out += (lo + np.flatnonzero((later == here[:, None]).any(axis=0))).tolist()
        lo = to
    return out


def stretches(ids: np.ndarray, lo: int = 1, hi: int | None = None) -> np.ndarray:
    """(start, length, period) of the stretches of the lags lo <= lag < hi; multiples of a period too."""
    hi = min(len(ids) // EXPONENT + 1, hi or len(ids))
    found = []
    for lag in hopeful(ids, lo, hi) if len(ids) >= LEAST else ():
        same = ids[lag:] == ids[:-lag]
        framed = np.zeros(len(same) + 2, bool)
        framed[1:-1] = same
        ends = np.flatnonzero(framed[1:] != framed[:-1])
        start, size = ends[::2], ends[1::2] - ends[::2]
        start, size = start[long := size >= least_stretch(lag)], size[long]
        if len(start):
            found.append(np.stack([start, size + lag, np.full(len(start), lag)], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def distinct(found: np.ndarray) -> np.ndarray:
    """The runs among stretches: the least period of each start and length, by start, then period."""
    if len(found) < 2:
        return found
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(words: list) -> np.ndarray:
    """All runs (start, length, period) of a list of words."""
    return distinct(stretches(numbers(words)))


def planted(doc_id: int | None, words: list) -> list:
    """The words, of one document in ten made periodic from a place on that its id gives."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return (words[:a] + cycle * -(-(n - a) // p))[:n]


def _digest(doc_id: int | None, words: list, runs: np.ndarray) -> tuple:
    listed = hashlib.sha256("".join("%d,%d,%d\n" % tuple(r) for r in runs.tolist()).encode()).hexdigest()
    kept = words
    if len(runs):
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
    text = hashlib.sha256(b" ".join(kept)).hexdigest()
    most = (None,) * 4
    if len(runs):
        start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        most = start, length, period, 1000 * length // period
    return (doc_id, len(runs), *most, listed, text)


def _rows(batch: pa.RecordBatch, rule: Callable):
    """(row number, doc_id, words) of each row; only one row's words are held at a time."""
    texts = batch.column("text").cast(pa.large_binary())
    for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
        # bytes.split() parts at the six ASCII blanks, which are the ones of the contract
        yield i, doc_id, rule(doc_id, (texts[i].as_py() or b"").split())


def _schema(kinds: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(kinds))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)], schema=schema)


def find(docs: DataFrame, rule: Callable = planted, work: int = WORK) -> DataFrame:
    """The periodic runs of every row; see the module's contract."""
    spark = docs.sparkSession
    result, part_schema = _schema(RESULT), _schema(f"doc_id long, sha string, text string, runs {_RUNS}")
    n = F.octet_length("text") / WORD_BYTES
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("parts", F.coalesce(F.ceil(n * n / EXPONENT / F.lit(work)), F.lit(0)).cast("long"))

    def whole(batches):
        for b in batches:
            yield _batch([_digest(d, w, runs_of(w)) for _, d, w in _rows(b, rule)], result)

    def ranges(batches):
        for b in batches:
            part, parts, sha, text = (b.column(c).to_pylist() for c in ("part", "parts", "sha", "text"))
            out = []
            for i, d, w in _rows(b, rule):
                span = -(-(len(w) // EXPONENT) // parts[i])
                got = stretches(numbers(w), 1 + part[i] * span, 1 + (part[i] + 1) * span)
                out.append((d, sha[i], None if part[i] else text[i], [dict(zip(("start", "length", "period"), r)) for r in got.tolist()]))
            yield _batch(out, part_schema)

    def joined(batches):
        for b in batches:
            runs = b.column("runs").to_pylist()
            own = [[(r["start"], r["length"], r["period"]) for r in x] for x in runs]
            yield _batch([_digest(d, w, distinct(np.array(own[i], np.int64).reshape(-1, 3))) for i, d, w in _rows(b, rule)], result)

    short = rows.where("parts <= 1").select("doc_id", "text").mapInArrow(whole, RESULT)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = rows.where("parts > 1").withColumn("sha", F.sha2("text", 256)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    long = long.repartition(tasks, "doc_id", "sha", "part").mapInArrow(ranges, f"doc_id long, sha string, text string, runs {_RUNS}")
    # repeated rows share their runs and are told by the number of first parts
    long = long.groupBy("doc_id", "sha").agg(F.max("text").alias("text"), F.count("text").alias("copies"), F.flatten(F.collect_set("runs")).alias("runs"))
    long = long.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "text", "runs").mapInArrow(joined, RESULT)
    return short.unionByName(long)
