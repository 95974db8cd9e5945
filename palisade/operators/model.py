"""The learned score: hashed n-grams and heuristics into logistic regression (Spark ML)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import grams as G, lexicon as L, rules as R, text as T
from . import metrics, ranks
from .policy import ModelIntegrityError
from .stored import once

#: Buckets of words and of character runs, the inverse strength of the penalty, iterations.
WORD_BUCKETS, CHAR_BUCKETS, C, ITERATIONS = 1 << 16, 1 << 14, 4.0, 100


def char_runs(text: Column, sizes=(3, 4)) -> Column:
    """Runs of characters within words padded by a blank on each side."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def runs(w, n):
        last = F.length(w) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array(w))

    def all_of(n):
        return F.flatten(F.transform(padded, lambda w: runs(w, n)))

    return F.concat(*(all_of(n) for n in sizes))


def prepare(df: DataFrame, column: str) -> DataFrame:
    """Adds the view, the character runs and the scaled heuristics that the pipeline reads."""
    df = T.with_view(df, column, "_view")
    f = R.heuristics(F.col(column), F.col("_view"))
    return df.withColumns({"_chars": char_runs(F.col("_view")), **{f"_h_{n}": f[n] * scale for n, _, scale in L.FEATURES}})


def pipeline(n_rows: int) -> Pipeline:
    words = RegexTokenizer(inputCol="_view", outputCol="_words", pattern=r"(?U)\w\w+", gaps=False)
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    one = HashingTF(numFeatures=WORD_BUCKETS, inputCol="_grams", outputCol="_tf")
    from pyspark.ml.feature import SQLTransformer

    both = SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _grams FROM __THIS__")
    chars = HashingTF(numFeatures=CHAR_BUCKETS, inputCol="_chars", outputCol="_ctf")
    stages = [words, pairs, both, one, chars, Normalizer(inputCol="_tf", outputCol="_w", p=2), Normalizer(inputCol="_ctf", outputCol="_c", p=2)]
    every = VectorAssembler(inputCols=["_w", "_c", *(f"_h_{n}" for n, _, _ in L.FEATURES)], outputCol="_x", handleInvalid="keep")
    fit = LogisticRegression(featuresCol="_x", labelCol="label", rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_pred", regParam=1 / (C * max(n_rows, 1)), elasticNetParam=0.0, standardization=False, maxIter=ITERATIONS)
    return Pipeline(stages=[*stages, every, fit])


#: Rows of a task of the fit: an iteration over fewer is all overhead.
FIT_ROWS = 20_000


def train(samples: DataFrame, text: str = "text") -> PipelineModel:
    """Fit on rows (text, label).  Features are made once and kept; iterations read them."""
    rows = prepare(samples.select(F.col(text).alias("text"), F.col("label").cast("double").alias("label")), "text")
    n = samples.count()
    *shape, fit = pipeline(n).getStages()
    for stage in shape:
        rows = stage.transform(rows)
    kept = once(rows.select("label", fit.getFeaturesCol()))
    return PipelineModel(stages=[*shape, fit.fit(once(kept.coalesce(1 + n // FIT_ROWS)))])


def train_and_choose(samples: DataFrame, validation: float = 0.2) -> PipelineModel:
    """Fit on four fifths of (id, text, label); the threshold comes from the rest.

    The rest is the last fifth in an order by a hash of the id.  The threshold is the least one whose share of
    false alarms there is within the limit (``metrics.threshold_scan``), and is kept in the model.
    """
    rows = ranks.row_numbers(samples.withColumn("_h", F.xxhash64("id", F.lit(77))), ["_h", "id"], "_place")
    rows = once(rows.select("text", "label", "_place"))
    cut = int(rows.count() * (1 - validation))
    model = train(rows.where(F.col("_place") < cut))
    tried = scorer(model)(rows.where(F.col("_place") >= cut), "text", "p")
    model.stages[-1].setThreshold(metrics.threshold_scan(tried, "p", "label").first().threshold)
    return model


def threshold(model: PipelineModel) -> float:
    return model.stages[-1].getThreshold()


#: Most bytes of texts or features in a batch.
BATCH_BYTES = 8 << 20


def batches_of(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes, unless the session does."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "-1", str((1 << 63) - 1), str((1 << 31) - 1)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scorer:
    """A function (df, column, into) that adds the probability of an injection.

    What the pipeline's stages make of a text is added up here in whole batches (``functions.grams``), and patterns
    are tried only on texts in which they can occur; the probability is the pipeline's.
    """

    def __init__(self, model: PipelineModel):
        fit = model.stages[-1]
        self.weights, self.intercept = fit.coefficients.toArray(), fit.intercept
        self.sent: dict[str, object] = {}

    def __call__(self, df: DataFrame, column: str, into: str) -> DataFrame:
        view = f"_{into}_view"
        kept = df.columns
        return self.look(T.with_view(df, column, view, guarded=True), column, view, into).select(*kept, into)

    def can(self, into: str) -> Column:
        """The bits of patterns that can occur."""
        return F.col(f"_{into}_may")

    def features(self, into: str) -> dict[str, Column]:
        """The heuristics' columns that ``look`` adds."""
        return {n: F.col(f"_{into}_h_{n}") for n, _, _ in L.FEATURES}

    def look(self, df: DataFrame, column: str, view: str, into: str) -> DataFrame:
        """Adds ``into`` and what it is made from: the heuristics and ``_{into}_may``, the bits of patterns that can occur."""
        spark, text, may = df.sparkSession, f"_{into}_text", f"_{into}_may"
        batches_of(spark)
        words, size = WORD_BUCKETS, len(self.weights) - len(L.FEATURES)
        app = spark.sparkContext.applicationId
        if app not in self.sent:
            self.sent[app] = spark.sparkContext.broadcast((self.weights[:words], self.weights[words:size]))
        weights = self.sent[app]

        @F.arrow_udf("margin double, may bigint")
        def read(v: pa.Array, low: pa.Array, tokens: pa.Array) -> pa.Array:
            low = pc.coalesce(low, pc.ascii_lower(v))
            return pa.StructArray.from_arrays([G.margins(low, tokens, *weights.value), pa.array(G.may(v))], ["margin", "may"])

        v, low = F.col(view), F.lower(view)
        beyond = T.beyond_ascii(v)
        own = [F.when(beyond, F.make_valid_utf8(v)).otherwise(v), F.when(beyond, F.regexp_replace(low, r"(?U)\s+", " ")), F.when(beyond, F.array_join(F.regexp_extract_all(low, F.lit(r"(?U)\w\w+"), F.lit(0)), " "))]
        df = df.withColumn(text, read(*own)).withColumn(may, F.col(f"{text}.may"))
        f = R.heuristics(F.col(column), v, F.col(may))
        df = df.withColumns({f"_{into}_h_{n}": c for n, c in f.items()})
        scales = [scale for _, _, scale in L.FEATURES]
        margin = F.col(f"{text}.margin") + F.lit(self.intercept)
        for c, scale, w in zip(self.features(into).values(), scales, self.weights[size:].tolist()):
            margin = margin + c * F.lit(scale) * F.lit(w)
        return df.withColumn(into, F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).drop(text)

    def left(self, into: str) -> list[str]:
        """Columns of ``look`` besides ``into``."""
        return [f"_{into}_may", *(f"_{into}_h_{n}" for n, _, _ in L.FEATURES)]


def scorer(model: PipelineModel) -> Scorer:
    """A function (df, column, into) that adds the probability of an injection."""
    return Scorer(model)


# ---- artefact ----------------------------------------------------------------------------------------


def digest(spark: SparkSession, path: str) -> str:
    """sha256 over the sha256 of every file of a stored model, by relative name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(~F.col("path").rlike(r"(/\.[^/]*|_SUCCESS)$"))
    mark = path.rstrip("/").rsplit("/", 1)[-1]
    rows = files.select(F.substring_index("path", f"/{mark}/", -1).alias("p"), F.sha2("content", 256).alias("h")).orderBy("p")
    import hashlib

    return hashlib.sha256("".join(f"{r.p}:{r.h}\n" for r in rows.collect()).encode()).hexdigest()


def save(spark: SparkSession, model: PipelineModel, path: str) -> str:
    """Store a model and its manifest ``path.sha256``; the digest."""
    model.write().overwrite().save(path)
    d = digest(spark, path)
    spark.createDataFrame([(d,)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".sha256")
    return d


def load(spark: SparkSession, path: str) -> PipelineModel:
    """A stored model; ModelIntegrityError unless the manifest is there and agrees."""
    try:
        want = [r.value.strip() for r in spark.read.text(path.rstrip("/") + ".sha256").collect()]
        have = digest(spark, path)
    except Exception as e:
        raise ModelIntegrityError(f"no model or manifest at {path}") from e
    if want != [have]:
        raise ModelIntegrityError(f"the model at {path} does not match its manifest")
    model = PipelineModel.load(path)
    size = model.stages[-1].numFeatures
    if size != WORD_BUCKETS + CHAR_BUCKETS + len(L.FEATURES):
        raise ModelIntegrityError(f"the model at {path} reads {size} features")
    return model


# ---- one model for a session, kept by what it was trained on ---------------------------------------------

_models: dict[tuple[str, str], PipelineModel] = {}


def sample_key(samples: DataFrame) -> str:
    """What a model depends on: all rows (id, text, label), in any order, and the parameters."""
    import hashlib

    h = F.xxhash64("id", "text", "label")
    r = samples.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit((1 << 31) - 1))).alias("s")).first()
    return hashlib.sha256(repr((r.n, r.x, r.s, WORD_BUCKETS, CHAR_BUCKETS, C, ITERATIONS)).encode()).hexdigest()[:24]


def cached(samples: DataFrame, folder: str | None = None, retrain: bool = True) -> PipelineModel:
    """The model of these samples: of this session, else stored in ``folder``, else trained (and stored).

    A stored model that is missing, altered, of another size or without a manifest is trained anew, or, with
    ``retrain=False``, refused (ModelIntegrityError).
    """
    spark = samples.sparkSession
    key = sample_key(samples)
    known = (spark.sparkContext.applicationId, f"{folder}/{key}")
    if known in _models:
        return _models[known]
    path = folder and f"{folder.rstrip('/')}/{key}"
    try:
        if not path:
            raise ModelIntegrityError("no folder of models is given")
        model = load(spark, path)
    except ModelIntegrityError:
        if path and not retrain:
            raise
        model = train_and_choose(samples)
        if path:
            save(spark, model, path)
    _models[known] = model
    return model


# ---- families that a model never saw ---------------------------------------------------------------------


def fit_sparse(indices: list, values: list, labels, size: int, c: float = C, steps: int = 25):
    """Weights and intercept of L2 logistic regression on sparse rows, by Newton steps with conjugate gradients."""
    import numpy as np

    rows = np.repeat(np.arange(len(indices)), [len(i) for i in indices])
    cols, vals, y = np.concatenate(indices).astype(np.int64), np.concatenate(values), np.asarray(labels, float)
    n, w = len(indices), np.zeros(size + 1)
    penalty = np.append(np.ones(size), 0.0) / c

    def times(v):
        return np.bincount(rows, vals * v[cols], n) + v[size]

    def back(r):
        return np.append(np.bincount(cols, vals * r[rows], size), r.sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-times(w)))
        gradient = back(p - y) + penalty * w
        if np.abs(gradient).max() < 1e-4:
            break
        curve, step = p * (1 - p) + 1e-9, np.zeros(size + 1)
        residual = -gradient
        d, rr = residual.copy(), residual @ residual
        stop = rr * 1e-4
        for _ in range(60):
            hd = back(curve * times(d)) + penalty * d
            a = rr / (d @ hd)
            step, residual = step + a * d, residual - a * hd
            new = residual @ residual
            if new < stop:
                break
            d, rr = residual + new / rr * d, new
        w = w + step
    return w[:size], w[size]


#: Parts in which the least rows of a family are looked for.
FOLD_PARTS = 32


def _least(rows: DataFrame, families: list[str], most: int) -> DataFrame:
    """(fold, cut): the place up to which rows of other families are the ``most`` least by ``_place``.

    Only places are dealt out: the least of each part of a family, then of the family, then of all others.
    """
    def first(df, *by):
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_place"))).where(F.col("_n") <= most).drop("_n")

    places = rows.select("family", "_place").withColumn("_part", F.pmod(F.xxhash64("_place"), F.lit(FOLD_PARTS)))
    places = first(first(places, "family", "_part"), "family")
    dealt = places.withColumn("fold", F.explode(F.array(*map(F.lit, families)))).where("fold != family")
    return first(dealt, "fold").groupBy("fold").agg(F.max("_place").alias("cut"))


def leave_one_family_out(samples: DataFrame, families: list[str], cut: float = 0.30, most: int = 4000) -> DataFrame:
    """(family, n, detection): the share of a family's rows found by a model that never saw the family.

    Each family's model is fitted in a task of its own on at most ``most`` rows (the least by a hash; a bounded
    sample for the classifier), whose features alone are made and dealt out.  All rows of the family itself are
    scored where they are read: features are neither stored nor shuffled, only counts are.
    """
    import numpy as np
    import pandas as pd

    spark = samples.sparkSession
    batches_of(spark)
    rows = samples.select("id", "text", "label", "family").where("family is not null")
    rows = rows.withColumn("_place", F.struct(F.xxhash64("id", F.lit(5)).alias("h"), F.col("id").alias("id"), F.xxhash64("text").alias("t")))
    size = WORD_BUCKETS + CHAR_BUCKETS + len(L.FEATURES)
    *shape, _ = pipeline(1).getStages()

    def featured(df: DataFrame, *kept: str) -> DataFrame:
        df = prepare(df, "text")
        for stage in shape:
            df = stage.transform(df)
        x = F.unwrap_udt("_x")
        dense = F.sequence(F.lit(0), F.size(x["values"]) - 1)
        return df.select(*kept, F.coalesce(x["indices"], dense).alias("at"), x["values"].alias("v"))

    cuts = once(_least(rows, families, most)).agg(F.collect_list(F.struct("fold", "cut")).alias("cuts"))
    mine = F.transform(F.filter("cuts", lambda c: (c["fold"] != F.col("family")) & (F.col("_place") <= c["cut"])), lambda c: c["fold"])
    fit = rows.crossJoin(F.broadcast(cuts)).withColumn("folds", mine).drop("cuts").where(F.size("folds") > 0)
    fit = featured(once(fit), "label", "folds", "_place").withColumn("fold", F.explode("folds")).drop("folds")
    # rows that are the same in all may stand at one place
    place = F.row_number().over(Window.partitionBy("fold").orderBy("_place"))
    fit = fit.withColumn("_n", place).where(F.col("_n") <= most).groupBy("fold")

    def weights(frame: pd.DataFrame) -> pd.DataFrame:
        w, b = fit_sparse(frame["at"].tolist(), frame["v"].tolist(), frame["label"], size)
        used = np.flatnonzero(w)
        return pd.DataFrame({"fold": pd.Series([frame["fold"].iloc[0]], dtype=object), "used": [used], "w": [w[used]], "b": [b]})

    made = fit.applyInPandas(weights, "fold string, used array<long>, w array<double>, b double")
    models = spark.sparkContext.broadcast({r.fold: (np.array(r.used, int), np.array(r.w), r.b) for r in made.collect()})

    def score(batches):
        dense = {}
        for frame in batches:
            for family, own in frame.groupby("family"):
                if family not in dense:
                    used, w, b = models.value.get(family, (np.zeros(0, int), np.zeros(0), -np.inf))
                    dense[family] = np.zeros(size), b
                    dense[family][0][used] = w
                w, b = dense[family]
                z = np.array([v @ w[i] + b for i, v in zip(own["at"], own["v"])], float)
                yield pd.DataFrame({"family": pd.Series([family], dtype=object), "n": [len(own)], "hits": [int((1 / (1 + np.exp(-z)) >= cut).sum())]})

    own = featured(rows.where(F.col("family").isin(families)), "family")
    got = own.mapInPandas(score, "family string, n long, hits long")
    return got.groupBy("family").agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("detection"))
