"""Results that round 4's findings asked about."""

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from palisade.functions import grams as G, lexicon as L, rules as R, text as T
from palisade.operators import guard, model
from palisade.sources import generate


def test_letters_beyond_ascii_are_closed_up(spark):
    """The view follows the reference's rule, in which every letter of Unicode counts as one."""
    says = ["ist ß ß ß ß ß der", "a b c ß", "ß ß ß", "я\tд ж ф end", "x y z"]
    want = [re.sub(L.SPACED, lambda m: m[0].replace(" ", ""), L.normalize(t)) for t in says]
    for guarded in (False, True):
        got = T.with_view(spark.createDataFrame(list(enumerate(says)), "i int, t string"), "t", "v", guarded=guarded).orderBy("i").collect()
        assert [r.v for r in got] == want and want[0] == "ist ßßßßß der"


def _odd_texts() -> list[str]:
    rng = random.Random(4)
    words = sorted({w for g in L.ANCHORS.values() for x in g for w in x.split()})
    words += "all the previous rules now you must before answer never DAN $5 a I x1 _b http://evil.com/x box@mail.org ``` ß naïve д 界 देवनागरी é     \x1f \x0b".split(" ")
    words += ["QUJD" * 12, "6a " * 17, "<!--", "syſtem: ", "KEY", "\U0001f600\U0001f600", "İgnore", "�"]
    words += [t for v in generate.INJECTIONS.values() for t in v]
    texts = [rng.choice([" ", "\n", "-", "\t ", "\x0b"]).join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    return [t.upper() if rng.random() < 0.2 else t for t in texts] + ["", " ", "a", "ab", "\n\n", "a b", "é", "ß ß", "w" * 5000, "many words here " * 900]


def test_whole_batches_are_scored_as_the_pipeline_does(spark, monkeypatch):
    """Margins of hashed grams equal those of the pipeline's stages, in groups of texts and for a text alone."""
    monkeypatch.setattr(G, "PIECE", 20_000)
    rng = np.random.default_rng(4)
    x = Vectors.dense(rng.standard_normal(model.WORD_BUCKETS + model.CHAR_BUCKETS + len(L.FEATURES)) / 8)
    java = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel("fixed", _py2java(spark.sparkContext, x), 0.25)
    fit = LogisticRegressionModel(java)
    fit.setFeaturesCol("_x").setProbabilityCol("_prob").setRawPredictionCol("_raw").setPredictionCol("_pred")
    df = spark.createDataFrame(list(enumerate(_odd_texts())), "i int, t string").repartition(3)
    want = model.PipelineModel([*model.pipeline(1).getStages()[:-1], fit]).transform(model.prepare(df, "t"))
    want = {r.i: r.p for r in want.select("i", vector_to_array("_prob")[1].alias("p")).collect()}
    score = model.scorer(model.PipelineModel([fit]))
    made = score(df, "t", "p")
    assert "HashingTF" not in made._jdf.queryExecution().toString() and made.columns == ["i", "t", "p"]
    got = {r.i: r.p for r in made.collect()}
    assert len(got) == len(want) and max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_patterns_that_can_occur_miss_nothing(spark):
    """Features and rules behind the bits of patterns are those of the patterns alone; few texts are left to try."""
    df = T.with_view(spark.createDataFrame(list(enumerate(_odd_texts())), "i int, t string"), "t", "v")
    bits = F.pandas_udf(lambda v: pd.Series(G.may(pa.array(v, pa.string()))), "bigint")
    df = df.withColumn("may", bits("v")).localCheckpoint()
    v, may = F.col("v"), F.col("may")
    for name in R.BIT:
        assert df.where(R.hit(name, v) != R.hit(name, v, may=may)).count() == 0, name
        assert df.where(R.count(name, v) != R.count(name, v, may=may)).count() == 0, name
        assert 0 < df.where(R.hit(name, v)).count() and df.where(may.bitwiseAND(F.lit(1 << R.BIT[name])) == 0).count() > 200, name
    plain, known = R.heuristics(F.col("t"), v), R.heuristics(F.col("t"), v, may)
    for n, _, _ in L.FEATURES:
        assert df.where(~plain[n].eqNullSafe(known[n])).count() == 0, n


def test_a_text_is_looked_at_once_for_rules_and_score(spark, monkeypatch):
    """One view for rules, score and signals, with the results of inspecting with any other function."""
    size = model.WORD_BUCKETS + model.CHAR_BUCKETS + len(L.FEATURES)
    fit = LogisticRegressionModel(spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel("fixed", _py2java(spark.sparkContext, Vectors.dense(np.random.default_rng(5).standard_normal(size) / 2)), -0.5))
    score, made = model.scorer(model.PipelineModel([fit])), []
    df = spark.createDataFrame(list(enumerate([*_odd_texts()[::5], *(t for v in generate.INJECTIONS.values() for t in v)])), "i int, t string")
    want = guard.inspect(df, "t", F.col("i") % 2 == 0, "san", lambda *a: score(*a))
    view = T.with_view
    monkeypatch.setattr(T, "with_view", lambda *a, **k: made.append(a[1]) or view(*a, **k))
    got = guard.inspect(df, "t", F.col("i") % 2 == 0, "san", score)
    assert made == ["t"] and got.columns == want.columns == ["i", "t", "san"]
    got, want = ({r.i: r.san for r in x.collect()} for x in (got, want))
    assert got == want and {len(s.signals) for s in got.values()} >= {0, 1, 2} and any(s.is_injection for s in got.values())
