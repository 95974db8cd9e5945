"""Ranks, running sums, percentiles and latest rows without a window over all rows.

A running sum is made of three steps: rows are dealt out by ranges of their order and written once;
the sums of the ranges are added up (a number for each range and key); each range then adds its own rows up
and starts from what lies before it.  A range is a task, so no task has all rows, whatever the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .stored import once

#: Tasks that first look for the latest rows of a key.
SALTS = 32


def _named(columns) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def running_sum(df: DataFrame, order, value: Column, into: str, key=(), parts: int | None = None) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over the rows of the same key up to and with a row, in ``order``.

    order: names of columns, ascending, nulls first; rows that agree in all of them are taken in any
    order, so their sums may change places.  Rows are shuffled twice (by range, then by range number).
    """
    order, key = _named(order), _named(key)
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_value", value).repartitionByRange(parts, *key, *order)
    # written, as ranges are found by sampling and another run could cut them elsewhere
    rows = once(rows.withColumn("_part", F.spark_partition_id()))
    sums = rows.groupBy("_part", *key).agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if key:
        # a key has a sum for each range that it touches
        sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before.partitionBy(*key)), F.lit(0))).drop("_sum")
        sums = sums.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(key)})
        same = [rows["_part"] == sums["_part"], *(rows[k].eqNullSafe(sums[f"_k{i}"]) for i, k in enumerate(key))]
        rows = rows.join(sums, same, "left").drop(sums["_part"]).drop(*(f"_k{i}" for i in range(len(key))))
    else:
        total, known = 0, []
        for r in sums.orderBy("_part").collect():  # a number for each range
            known.append((r["_part"], total))
            total = total + (r["_sum"] or 0)
        kind = dict(sums.dtypes)["_sum"]
        rows = rows.join(F.broadcast(spark.createDataFrame(known, f"_part int, _before {kind}")), "_part", "left")
    own = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.col("_before") + F.sum("_value").over(own)).drop("_part", "_value", "_before")


def row_numbers(df: DataFrame, order, into: str, parts: int | None = None) -> DataFrame:
    """Adds ``into``: the row's place in an order of all rows, from 0."""
    return running_sum(df, order, F.lit(1).cast("long"), into, parts=parts).withColumn(into, F.col(into) - 1)


def latest(df: DataFrame, key, order, n: int, salts: int = SALTS) -> DataFrame:
    """The last ``n`` rows of each key in ``order`` (names, ascending).

    Each of ``salts`` parts of a key keeps its own last n rows; only those meet, so a task has at
    most salts * n rows of a key in the end, however many the key has.
    """
    key, order = _named(key), [F.col(c).desc() for c in _named(order)]
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)))
    some = salted.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "_salt").orderBy(*order))).where(F.col("_n") <= n)
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n", "_salt")


def quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, count, and a column for each share): exact, interpolated between neighbours, over all rows.

    Values are counted first; a running sum by key then says which value stands at which rank.
    Nulls are left out; a key without values has count 0 and nulls.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_m"))
    placed = running_sum(per, value, F.col("_m"), "_hi", key)
    totals = df.groupBy(key).agg(F.count(value).alias("count")).withColumnRenamed(key, "_key")
    rows = placed.join(totals, placed[key].eqNullSafe(totals["_key"]), "right")
    at = lambda rank: (F.col("_hi") - F.col("_m") <= rank) & (rank < F.col("_hi"))
    out = []
    for name, share in shares.items():
        place = (F.col("count") - 1) * F.lit(float(share))
        low = F.floor(place)
        high = F.least(low + 1, F.col("count") - 1)
        a, b = F.max(F.when(at(low), F.col(value))), F.max(F.when(at(high), F.col(value)))
        out.append((a + (b - a) * F.max(place - low)).alias(name))
    return rows.groupBy("_key", "count").agg(*out).withColumnRenamed("_key", key).select(key, "count", *shares)
