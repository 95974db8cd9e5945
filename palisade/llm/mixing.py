"""Mixing sources to target weights by hierarchical budgeting (operator 9).

Contract.  ``mix(docs)`` returns for every row ``doc_id``, ``domain``, ``lang``, ``source``,
``n_tokens`` and ``n_copies``: how often the row is taken (0 if not).  ``apply_mix`` returns the
rows of docs themselves, with all columns, each as often as it is taken.

Method.  Sources are leaves of a tree of domains, languages and sources.  The token budget of the
root is ``ratio`` times all tokens.  A node's budget is dealt to its children by weight; a child
whose leaves cannot use its part, even in ``max_epochs`` passes, takes what it can, and the rest is
dealt among its siblings by weight (:func:`_deal`).  Only what all siblings together cannot use is
left to their parent's siblings, because a parent never gets more than its leaves can use.
A leaf reads its documents in an order seeded anew for each epoch: whole epochs first, then the
prefix of the next epoch whose tokens fit the budget.

Tokens are runs without blanks.  Domain, language and source of null are ``''``.  Domains come from
``domain_of`` (by default, a group of sources by checksum).  Weights of nodes that are not named
are 1; a weight of 0 takes nothing from the node.

Scale.  The texts are scanned once, for the tokens of each row.  Leaves are summed by a partial
aggregate; dealing shuffles only the tree's nodes.  Within a leaf the cumulative sum goes by bins of
the order key of about ``BIN_ROWS`` rows: bins before the last one are decided whole, the last one is
cut into ``PARTS`` parts, and only rows of the one part that holds the end of the prefix are sorted.
A leaf with a third of all rows is spread over its bins.  Rows of one doc_id, or of none, have one
key and share a bin.

Edge cases: null and empty texts have no tokens and are taken with their epoch; repeated rows are
rows of their own (equal keys are ordered by token count, and rows that also agree in that are
interchangeable); an empty leaf or table gives nothing; extra columns are ignored by ``mix`` and
kept by ``apply_mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import scratch

#: Budget against all tokens, most epochs of a leaf, seed, rows of a bin, and parts of the last bin.
RATIO, MAX_EPOCHS, SEED, BIN_ROWS, PARTS = 1.0, 4, 17, 4096, 64
#: Weights of domains and languages, in whole numbers; others are 1.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 2}
LANG_WEIGHTS = {"en": 5, "fr": 2, "de": 2, "es": 2}
SOURCE_WEIGHTS: dict[str, int] = {}
_KEYS = 1 << 32


def domain_of(source: Column) -> Column:
    """The default domain: a source's checksum modulo four."""
    return F.concat(F.lit("d"), F.pmod(F.conv(F.substring(F.md5(source.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(4)).cast("string"))


def n_tokens(text: Column) -> Column:
    """Runs without blanks."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(int(w))).otherwise(out)
    return out.cast("double")


def _deal(nodes: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """Deal each parent's ``budget`` to its children; a child gets at most its ``cap``.

    Children are filled in the order of cap per weight: while the level that the rest would reach
    exceeds that ratio, the child is filled to its cap; all others share the rest by weight.  The
    level falls from the first child that is not filled on, so that child's is the greatest.
    """
    w = _weight(name, weights)
    nodes = nodes.withColumn("w", w).withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
    own = Window.partitionBy(*parent)
    before = own.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("left", F.sum("w").over(own) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    nodes = nodes.withColumn("level", F.when(F.col("left") > 0, (F.col("budget") - F.col("capped")) / F.col("left")))
    nodes = nodes.withColumn("share", F.max(F.when((F.col("w") > 0) & (F.col("level") < F.col("ratio")), F.col("level"))).over(own))
    part = F.when(F.col("w") <= 0, F.lit(0.0)).when(F.col("share").isNull() | (F.col("ratio") <= F.col("share")), F.col("cap").cast("double")).otherwise(F.col("share") * F.col("w"))
    return nodes.select(*parent, name, F.greatest(F.lit(0), F.floor(part)).cast("long").alias("budget"))


def leaf_budgets(leaves: DataFrame, ratio: float = RATIO, max_epochs: int = MAX_EPOCHS, domain_weights=None, lang_weights=None, source_weights=None) -> DataFrame:
    """(domain, lang, source, budget) from leaves (domain, lang, source, tokens)."""
    domain_weights, lang_weights, source_weights = (d if x is None else x for x, d in ((domain_weights, DOMAIN_WEIGHTS), (lang_weights, LANG_WEIGHTS), (source_weights, SOURCE_WEIGHTS)))
    # what a leaf can use; below a weight of 0 nothing can be used
    cap = F.when((_weight("domain", domain_weights) > 0) & (_weight("lang", lang_weights) > 0) & (_weight("source", source_weights) > 0), F.col("tokens") * max_epochs).otherwise(F.lit(0)).cast("long")
    leaves = leaves.withColumn("cap", cap)
    # the root's budget is a window over domains, which are few
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("root", F.lit(0))
    domains = domains.withColumn("budget", F.floor(F.sum("tokens").over(Window.partitionBy("root")) * F.lit(ratio)).cast("long")).drop("tokens")
    domains = _deal(domains, ["root"], "domain", domain_weights).drop("root")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain")
    langs = _deal(langs, ["domain"], "lang", lang_weights)
    return _deal(leaves.select("domain", "lang", "source", "cap").join(langs, ["domain", "lang"]), ["domain", "lang"], "source", source_weights)


_LEAF = ["domain", "lang", "source"]


def _leaf(docs: DataFrame, domain) -> list[Column]:
    """The leaf of each row: domain, lang, source."""
    own = F.coalesce(docs["source"].cast("string"), F.lit(""))
    return [domain(own).alias("domain"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"), own.alias("source")]


def _placed(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows (doc_id, leaf, ...) with the leaf's plan, their key in the epoch taken in part, bin and part of the bin."""
    rows = rows.join(plan, _LEAF)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary"))
    rows = rows.withColumn("key", key)
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("bins")
    return rows.withColumn("bin", F.shiftright(place, 32)).withColumn("part", F.shiftright(F.pmod(place, F.lit(_KEYS)) * PARTS, 32))


def _edge(rows: DataFrame, place: str) -> DataFrame:
    """Of each leaf: the first place (bin or part) that does not fit the rest, and the tokens before it."""
    sums = rows.groupBy(*_LEAF, place).agg(F.sum("n_tokens").alias("tokens"), F.max("room").alias("room"))
    upto = Window.partitionBy(*_LEAF).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("end", F.sum("tokens").over(upto)).where("end > room")
    return sums.groupBy(*_LEAF).agg(F.min(F.struct(place, (F.col("end") - F.col("tokens")).alias("before"))).alias("x")).select(*_LEAF, f"x.{place}", "x.before")


def _planned(docs: DataFrame, ratio, max_epochs, seed, weights, domain) -> tuple[DataFrame, DataFrame]:
    """The counted rows, from one scan of the texts, and the leaves: whole epochs, rest, bins, and the
    bin, part and tokens before it where the prefix of the next epoch ends."""
    counted = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *_leaf(docs, domain), n_tokens(docs["text"]).alias("n_tokens"))
    counted = scratch.keep(counted, "counted")
    leaves = scratch.keep(counted.groupBy(*_LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    plan = leaves.join(leaf_budgets(leaves.drop("rows"), ratio, max_epochs, **weights), _LEAF)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = scratch.keep(plan.select(*_LEAF, "epochs", "rest", F.ceil(F.col("rows") / BIN_ROWS).cast("long").alias("bins")), "plan")
    rows = _placed(counted, plan, seed)
    bins = scratch.keep(_edge(rows.withColumn("room", F.col("rest")), "bin"), "bins")
    inside = rows.join(bins.withColumnRenamed("bin", "last"), _LEAF).where("bin = last")
    parts = _edge(inside.withColumn("room", F.col("rest") - F.col("before")), "part")
    ends = bins.join(parts.withColumnRenamed("before", "inner"), _LEAF)
    ends = ends.select(*_LEAF, F.col("bin").alias("last"), F.col("part").alias("last_part"), (F.col("before") + F.col("inner")).alias("before"))
    return counted, scratch.keep(plan.join(ends, _LEAF, "left"), "ends")


def _taken(rows: DataFrame) -> DataFrame:
    """Placed rows with ``n_copies``; only rows of the part that holds the end of a prefix are counted and sorted."""
    at_end = (F.col("bin") == F.col("last")) & (F.col("part") == F.col("last_part"))
    first = F.col("last").isNull() | (F.col("bin") < F.col("last")) | (F.col("bin") == F.col("last")) & (F.col("part") < F.col("last_part"))
    sure = rows.where(~F.coalesce(at_end, F.lit(False))).withColumn("n_copies", F.col("epochs") + first.cast("long"))
    order = Window.partitionBy(*_LEAF).orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where(at_end)
    if "n_tokens" not in rows.columns:
        edge = edge.withColumn("n_tokens", n_tokens(F.col("doc")["text"]))
    edge = edge.withColumn("n_copies", F.col("epochs") + (F.col("before") + F.sum("n_tokens").over(order) <= F.col("rest")).cast("long"))
    return sure.unionByName(edge.select(*sure.columns))


def mix(docs: DataFrame, ratio: float = RATIO, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain=domain_of, **weights) -> DataFrame:
    """See the module's docstring."""
    counted, plan = _planned(docs, ratio, max_epochs, seed, weights, domain)
    return _taken(_placed(counted, plan, seed)).select("doc_id", *_LEAF, "n_tokens", "n_copies")


def apply_mix(docs: DataFrame, ratio: float = RATIO, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain=domain_of, **weights) -> DataFrame:
    """The rows of docs, each as often as it is taken."""
    _, plan = _planned(docs, ratio, max_epochs, seed, weights, domain)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), docs["doc_id"].cast("long").alias("doc_id"), *_leaf(docs, domain))
    taken = _taken(_placed(rows, plan, seed)).where("n_copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def oracle_sql(ratio: float = RATIO, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """The same result in DuckDB SQL, with plain windows over whole leaves."""

    def weight(column, weights):
        return "CAST(CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END AS DOUBLE)" if weights else "CAST(1 AS DOUBLE)"

    def deal(parent, name, weights, source):
        part = f"PARTITION BY {', '.join(parent)}" if parent else ""
        keys = ", ".join([*parent, name])
        return f"""
        SELECT {keys}, CAST(greatest(0, floor(CASE WHEN share IS NULL OR ratio <= share THEN CAST(cap AS DOUBLE) ELSE share * w END)) AS BIGINT) AS budget FROM (
          SELECT *, max(CASE WHEN lvl < ratio THEN lvl END) OVER ({part}) AS share FROM (
            SELECT *, (budget - capped) / lft AS lvl FROM (
              SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
                sum(w) OVER ({part}) - coalesce(sum(w) OVER ({part} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft
              FROM (SELECT *, {weight(name, weights)} AS w, cap / {weight(name, weights)} AS ratio FROM ({source}) a0) a1) a2) a3) a4"""

    return f"""
    WITH d AS (
      SELECT doc_id, 'd' || CAST(CAST('0x' || substr(md5(coalesce(source, '')), 1, 8) AS BIGINT) % 4 AS VARCHAR) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) AS BIGINT) AS n_tokens FROM documents),
    leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {max_epochs} AS BIGINT) AS cap FROM d GROUP BY ALL),
    domains AS ({deal([], "domain", DOMAIN_WEIGHTS, f"SELECT domain, sum(cap) AS cap, (SELECT CAST(floor(sum(tokens) * CAST({ratio} AS DOUBLE)) AS BIGINT) FROM leaves) AS budget FROM leaves GROUP BY domain")}),
    langs AS ({deal(["domain"], "lang", LANG_WEIGHTS, "SELECT l.domain, l.lang, sum(l.cap) AS cap, max(p.budget) AS budget FROM leaves l JOIN domains p USING (domain) GROUP BY l.domain, l.lang")}),
    sources AS ({deal(["domain", "lang"], "source", SOURCE_WEIGHTS, "SELECT l.domain, l.lang, l.source, l.cap, p.budget FROM leaves l JOIN langs p USING (domain, lang)")}),
    plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN CAST(floor(budget / tokens) AS BIGINT) ELSE 0 END AS epochs, budget, tokens FROM leaves JOIN sources USING (domain, lang, source)),
    r AS (SELECT d.*, epochs, budget - epochs * tokens AS rest, md5(concat_ws('|', '{seed}', CAST(epochs AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), '-'))) AS k FROM d JOIN plan USING (domain, lang, source))
    SELECT doc_id, domain, lang, source, n_tokens,
      CAST(epochs + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS BIGINT) AS n_copies
    FROM r"""
