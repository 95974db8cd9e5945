"""Running sums, latest rows and percentiles against numpy, with hot keys and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import metrics, ranks

ROWS = [("hot", float(v % 37), i) for i, v in enumerate(np.random.default_rng(3).integers(0, 500, 900).tolist())] + [("cold", 2.5, 900), ("pair", 1.0, 901), ("pair", 4.0, 902), (None, 3.0, 903), ("void", None, 904), (None, None, 905)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k string, v double, i long").repartition(7)


def test_running_sum(rows):
    got = {r.i: r.s for r in ranks.running_sum(rows, "i", F.col("i"), "s", parts=9).collect()}
    total = 0
    for i in range(len(ROWS)):
        total += i
        assert got[i] == total
    by_key, seen = {r.i: r.s for r in ranks.running_sum(rows, "i", F.lit(1), "s", key="k", parts=9).collect()}, {}
    for k, _, i in ROWS:
        seen[k] = seen.get(k, 0) + 1
        assert by_key[i] == seen[k]


def test_no_range_has_all_rows(rows):
    """The plan has no window without a partition and no single partition."""
    plan = ranks.row_numbers(rows, "i", "n", parts=9)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_latest_and_quantiles(rows):
    want = {}
    for k, v, i in ROWS:
        want.setdefault(k, []).append((i, v))
    got = {}
    for r in ranks.latest(rows, "k", ["i"], 5, salts=4).collect():
        got.setdefault(r.k, set()).add(r.i)
    assert got == {k: {i for i, _ in sorted(x)[-5:]} for k, x in want.items()}
    for r in ranks.quantiles(rows, "k", "v", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}).collect():
        values = [v for _, v in want[r.k] if v is not None]
        assert r["count"] == len(values)
        assert [r.a, r.b, r.c, r.d] == (pytest.approx(np.quantile(values, [0, 0.5, 0.95, 1]).tolist()) if values else [None] * 4)


def test_latency_over_all_and_last_rows(rows):
    every = {r.k: r for r in metrics.latency(rows, "k", "v", ["i"], last=None).collect()}
    last = {r.k: r for r in metrics.latency(rows, "k", "v", ["i"], last=10_000).collect()}
    assert set(every) == set(last)
    for k, r in every.items():
        assert [r[c] for c in ("count", "max")] == [last[k][c] for c in ("count", "max")]
        assert [r[c] or 0 for c in ("mean", "p50", "p95", "p99")] == pytest.approx([last[k][c] or 0 for c in ("mean", "p50", "p95", "p99")])


def test_auc_and_zipf(spark):
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 20, 400) / 20, rng.integers(0, 2, 400)
    won = sum((a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]) / ((y == 1).sum() * (y == 0).sum())
    assert metrics.auc(spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "s double, y long"), "s", "y").first().auc == pytest.approx(won)
    draws = metrics.zipf_sample(spark.range(50).withColumnRenamed("id", "doc"), "doc", 4000, 7)
    n = {r.doc: r["count"] for r in draws.groupBy("doc").count().collect()}
    assert sum(n.values()) == 4000 and draws.select("draw").distinct().count() == 4000
    weights = 1 / np.arange(1, 51)
    assert all(abs(n.get(i, 0) / 4000 - w) < 0.03 for i, w in enumerate(weights / weights.sum()))
    assert [r.draw for r in draws.where("doc = 3").orderBy("draw").collect()] == [r.draw for r in metrics.zipf_sample(spark.range(50).withColumnRenamed("id", "doc"), "doc", 4000, 7).where("doc = 3").orderBy("draw").collect()]
