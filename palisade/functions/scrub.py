"""Line redaction: lines that carry an injected instruction are replaced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.stored import once
from . import lexicon as L, rules as R, text as T

#: The scrubber's own patterns and those shared with the rules, with their anchors; and all as one.
EVERY = [*zip(L.SCRUB_OWN, L.SCRUB_ANCHORS), *((L.PATTERNS[n], L.ANCHORS[n]) for n in L.SCRUB_SHARED)]
MASTER = "|".join(f"(?:{p})" for p, _ in EVERY)


def _hit(view: Column, low: Column | None) -> Column:
    """Whether one of the patterns occurs; with the view in lower case, only those are tried whose
    anchors are there."""
    if low is None:
        return view.rlike(L.java(MASTER))
    return reduce(lambda a, b: a | b, [R.may_hit(anchors, low) & view.rlike(L.java(p)) for p, anchors in EVERY])


def scrub(df: DataFrame, column: str, into: str = "scrub", redaction: str = L.REDACTION, anchored: bool = True) -> DataFrame:
    """df with struct(text, removed_count, chars_removed, redactions, modified).

    The whole text is tried first; only texts with a match are split into lines.  The detection
    view never joins lines, so the first test misses nothing.  anchored: search for plain words before
    patterns, which is faster over whole texts and makes a larger plan.
    """
    df = df.withColumn("_canon", T.strip_invisible(F.coalesce(F.col(column), F.lit(""))))
    df = T.with_view(df, "_canon", "_view", squeeze=False)
    lines = F.split("_canon", "\n")
    views = F.split("_view", "\n")
    if anchored:
        pairs = F.zip_with(lines, views, lambda a, b: F.struct(a.alias("line"), T.close_up(b).alias("view")))
        pairs = F.transform(pairs, lambda x: F.struct(x["line"].alias("line"), T.one_blank(x["view"]).alias("view")))
        pairs = F.transform(pairs, lambda x: F.struct(x["line"].alias("line"), x["view"].alias("view"), F.lower(x["view"]).alias("low")))
        pairs = F.transform(pairs, lambda x: F.struct(x["line"].alias("line"), (x["line"].rlike(r"(?U)\S") & _hit(x["view"], x["low"])).alias("hit")))
        df = T.with_collapsed(df, "_view", "_whole").withColumn("_low", F.lower("_whole"))
    else:
        pairs = F.zip_with(lines, views, lambda a, b: F.struct(a.alias("line"), (a.rlike(r"(?U)\S") & _hit(T.collapse(b), None)).alias("hit")))
        df = df.withColumn("_whole", T.collapse(F.col("_view"))).withColumn("_low", F.lit(""))
    df = df.withColumn("_any", _hit(F.col("_whole"), F.col("_low") if anchored else None)).drop("_whole", "_low")
    df = df.withColumn("_lines", F.when(F.col("_any"), pairs)).drop("_any")
    df = df.withColumn("_gone", F.filter("_lines", lambda x: x["hit"]))
    df = df.withColumns({
        "_text": F.coalesce(F.array_join(F.transform("_lines", lambda x: F.when(x["hit"], F.lit(redaction)).otherwise(x["line"])), "\n"), F.col("_canon")),
        "_n": F.coalesce(F.size("_gone"), F.lit(0)),
        "_chars": F.coalesce(F.aggregate("_gone", F.lit(0), lambda a, x: a + F.length(x["line"])), F.lit(0)),
        "_cut": F.coalesce(F.transform("_gone", lambda x: x["line"]), F.array().cast("array<string>")),
    })
    out = F.struct(F.col("_text").alias("text"), F.greatest("_n", F.lit(0)).alias("removed_count"), F.col("_chars").alias("chars_removed"), F.col("_cut").alias("redactions"), (F.col("_n") > 0).alias("modified"))
    return df.withColumn(into, out).drop("_view", "_canon", "_lines", "_gone", "_text", "_n", "_chars", "_cut")


# ---- reuse of repeated lines ---------------------------------------------------------------------------

#: Distinct lines or texts with a hit up to which they are broadcast (about 16 bytes, and a few for each
#: line that goes); beyond that the lines meet them in a join salted into so many parts.
BROADCAST, SALTS = 1 << 20, 32
#: Distinct lines with a hit whose keys are written into the plan; texts are then read once more and never moved.
IN_PLAN = 1000


def _key(text: Column, into: str) -> dict[str, Column]:
    """128 bits that stand for a text."""
    return {f"{into}1": F.xxhash64(F.lit(1), text), f"{into}2": F.xxhash64(F.lit(2), text)}


def judged(texts: DataFrame, column: str) -> DataFrame:
    """(line, hit) of every distinct line that is not blank.

    Lines are brought together by partial aggregation, so one that a third of all texts repeat is a
    single row of each task; patterns see each distinct line once.
    """
    rows = texts.select(F.explode(F.split(T.strip_invisible(F.coalesce(F.col(column), F.lit(""))), "\n")).alias("line"))
    rows = rows.where(F.col("line").rlike(r"(?U)\S")).groupBy("line").agg(F.lit(1).alias("_one")).drop("_one")
    rows = T.with_view(rows, "line", "_view", guarded=True).withColumn("_low", F.lower("_view"))
    rows = rows.withColumn("hit", _hit(F.col("_view"), F.col("_low")))
    # no shuffle, and no filter on ``hit`` goes below it: there it would make the view for each pattern anew
    return rows.groupBy("line").agg(F.max("hit").alias("hit"))


def _meet(rows: DataFrame, hits: DataFrame, n: int, how: str, salt: Column) -> DataFrame:
    """Rows with keys _l1, _l2 joined with ``n`` distinct hits."""
    if n <= BROADCAST:
        return rows.join(F.broadcast(hits), ["_l1", "_l2"], how)
    # the same line may stand in a third of all rows: its rows are dealt to SALTS parts
    parts = hits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(parts, ["_l1", "_l2", "_salt"], how).drop("_salt")


def _cut_in_place(df: DataFrame, keys: list[tuple[int, int]], into: str, redaction: str) -> DataFrame:
    """Cuts the lines of ``_canon`` whose keys are given; no shuffle."""
    one, two = ([k[i] for k in keys] for i in (0, 1))

    def hit(line):
        k = _key(line, "k")
        return k["k1"].isin(one) & k["k2"].isin(two) if keys else F.lit(False)

    df = df.withColumn("_lines", F.transform(F.split("_canon", "\n"), lambda x: F.struct(x.alias("line"), hit(x).alias("hit"))))
    df = df.withColumns({
        "_gone": F.transform(F.filter("_lines", lambda x: x["hit"]), lambda x: x["line"]),
        "_text": F.array_join(F.transform("_lines", lambda x: F.when(x["hit"], F.lit(redaction)).otherwise(x["line"])), "\n"),
    })
    chars = F.aggregate("_gone", F.lit(0), lambda a, x: a + F.length(x))
    out = F.struct(F.col("_text").alias("text"), F.size("_gone").alias("removed_count"), chars.alias("chars_removed"), F.col("_gone").alias("redactions"), (F.size("_gone") > 0).alias("modified"))
    return df.withColumn(into, out).drop("_canon", "_lines", "_gone", "_text")


def scrub_reused(df: DataFrame, column: str, into: str = "scrub", redaction: str = L.REDACTION) -> DataFrame:
    """What :func:`scrub` gives, with every distinct line judged once.

    Distinct lines are judged first.  If at most IN_PLAN of them have a hit, texts are read once more and cut
    where they lie.  Else texts look up which of their lines have a hit (by 128-bit keys), and those with
    a hit get their lines cut; texts are shuffled only where more than BROADCAST / 8 distinct ones have a hit.
    """
    df = df.withColumn("_canon", T.strip_invisible(F.coalesce(F.col(column), F.lit(""))))
    hits = once(judged(df, "_canon").where("hit").select(*(c.alias(k) for k, c in _key(F.col("line"), "_l").items())))
    n = hits.count()
    if n <= IN_PLAN:
        return _cut_in_place(df, [(r["_l1"], r["_l2"]) for r in hits.collect()], into, redaction)
    keyed = df.withColumns(_key(F.col("_canon"), "_t"))
    rows = keyed.select("_t1", "_t2", F.posexplode(F.split("_canon", "\n")).alias("_no", "_line"))
    rows = rows.select("_t1", "_t2", "_no", *(c.alias(k) for k, c in _key(F.col("_line"), "_l").items()))
    found = _meet(rows, hits, n, "left_semi", F.xxhash64("_t1", "_no"))
    # copies of a text share one row here
    found = once(found.groupBy("_t1", "_t2").agg(F.sort_array(F.collect_set("_no")).alias("_cut")))
    df = keyed.join(F.broadcast(found) if found.count() <= BROADCAST // 8 else found, ["_t1", "_t2"], "left").drop("_t1", "_t2")
    df = df.withColumn("_lines", F.when(F.col("_cut").isNotNull(), F.split("_canon", "\n")))
    lines, cut = F.col("_lines"), F.col("_cut")

    def kept_before(c, i):
        start = F.when(i > 0, F.get(cut, i - 1) + 1).otherwise(0)
        return F.concat(F.slice(lines, start + 1, c - start), F.array(F.lit(redaction)))

    last = F.element_at(cut, -1)
    rest = F.slice(lines, last + 2, F.greatest(F.size(lines) - last - 1, F.lit(0)))
    # both in one projection: a column that is read once would be moved into the lambdas and made for each line
    df = df.withColumns({
        "_gone": F.coalesce(F.transform(cut, lambda c: F.get(lines, c)), F.array().cast("array<string>")),
        "_text": F.when(cut.isNull(), F.col("_canon")).otherwise(F.array_join(F.concat(F.flatten(F.transform(cut, kept_before)), rest), "\n")),
    })
    chars = F.aggregate("_gone", F.lit(0), lambda a, x: a + F.length(x))
    out = F.struct(F.col("_text").alias("text"), F.size("_gone").alias("removed_count"), chars.alias("chars_removed"), F.col("_gone").alias("redactions"), cut.isNotNull().alias("modified"))
    return df.withColumn(into, out).drop("_canon", "_cut", "_lines", "_gone", "_text")


def lines(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, line_no, line, hit): one row for each line; every distinct line is judged once."""
    hits = once(judged(df, column).where("hit").select(*(c.alias(k) for k, c in _key(F.col("line"), "_l").items())))
    rows = df.select(key, F.posexplode(F.split(T.strip_invisible(F.coalesce(F.col(column), F.lit(""))), "\n")).alias("line_no", "line"))
    rows = rows.withColumns(_key(F.col("line"), "_l"))
    rows = _meet(rows, hits.withColumn("_hit", F.lit(True)), hits.count(), "left", F.xxhash64(key, "line_no"))
    return rows.select(key, "line_no", "line", F.coalesce("_hit", F.lit(False)).alias("hit"))
