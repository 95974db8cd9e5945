"""The learned score: kept models, thresholds, unseen families, and scores held against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import metrics, model
from palisade.operators.policy import ModelIntegrityError
from palisade.sources import generate


@pytest.fixture(scope="module")
def small(spark, request):
    """Samples and a model with few iterations."""
    before, model.ITERATIONS = model.ITERATIONS, 12
    request.addfinalizer(lambda: setattr(model, "ITERATIONS", before))
    samples = generate.samples(spark, 300)
    return samples, model.train_and_choose(samples)


def test_scores_equal_plain_logistic(spark, small):
    samples, m = small
    fit = m.stages[-1]
    rows = model.PipelineModel(m.stages[:-1]).transform(model.prepare(samples.select("id", "text").limit(80), "text")).select("id", "_x").collect()
    got = {r.id: r.p for r in model.scorer(m)(samples, "text", "p").collect()}
    w = fit.coefficients.toArray()
    for r in rows:
        assert got[r.id] == pytest.approx(1 / (1 + np.exp(-(r["_x"].toArray() @ w + fit.intercept))), abs=1e-9)


def test_features_by_hand(spark, small):
    """Normalised counts: words and pairs, character runs within padded words, scaled heuristics."""
    _, m = small
    row = model.PipelineModel(m.stages[:-1]).transform(model.prepare(spark.createDataFrame([("Send the note note",)], "text string"), "text")).first()
    assert row["_grams"] == ["send", "the", "note", "note", "send the", "the note", "note note"]
    assert row["_chars"][:6] == [" se", "sen", "end", "nd ", " th", "the"] and len(row["_chars"]) == 4 + 3 + 4 + 4 + 3 + 2 + 3 + 3
    x = row["_x"].toArray()
    assert np.linalg.norm(x[: model.WORD_BUCKETS]) == pytest.approx(1) and np.linalg.norm(x[model.WORD_BUCKETS : -22]) == pytest.approx(1)
    assert x[-22] == pytest.approx(np.log1p(18) * 0.15)


def test_threshold_and_unseen_templates(spark, small):
    _, m = small
    assert 0.2 <= model.threshold(m) <= 0.95
    scored = model.scorer(m)(generate.samples(spark, 200, "test"), "text", "p")
    assert metrics.auc(scored, "p", "label").first().auc > 0.9


def test_numpy_fit_is_the_optimum():
    rng = np.random.default_rng(0)
    x, w = rng.standard_normal((200, 6)), np.array([2.0, -1, 0, 0, 1, 0])
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ w + 0.5)))).astype(int)
    got, b = model.fit_sparse([np.arange(6)] * 200, list(x), y, 6)
    r = 1 / (1 + np.exp(-(x @ got + b))) - y
    assert np.abs(x.T @ r + got / model.C).max() < 1e-3 and abs(r.sum()) < 1e-3


def test_leave_one_family_out(spark):
    rows = generate.samples(spark, 150).select("id", "text", "label", "family")
    got = {r.family: r for r in model.leave_one_family_out(rows, ["jailbreak", "exfil", "secrecy"]).collect()}
    n = {r.family: r["count"] for r in rows.groupBy("family").count().collect()}
    assert set(got) == {"jailbreak", "exfil", "secrecy"} and all(r.n == n[f] and 0 <= r.detection <= 1 for f, r in got.items())
    assert sum(r.detection for r in got.values()) > 1


def test_kept_models(spark, small, tmp_path, monkeypatch):
    """A model is trained once for its samples; a missing, altered or shrunken one is trained anew or refused."""
    samples, m = small
    trained = []
    monkeypatch.setattr(model, "train_and_choose", lambda s: trained.append(1) or m)
    folder = str(tmp_path / "models")
    with pytest.raises(ModelIntegrityError):
        model.cached(samples, folder, retrain=False)
    assert model.cached(samples, folder) is m and model.cached(samples, folder) is m and len(trained) == 1
    path = tmp_path / "models" / model.sample_key(samples)
    assert model.sample_key(samples) == model.sample_key(samples.repartition(3)) != model.sample_key(samples.where("id > 0"))
    model._models.clear()
    assert model.threshold(model.cached(samples, folder, retrain=False)) == model.threshold(m) and len(trained) == 1
    for harm in ("altered", "no manifest"):
        model._models.clear()
        if harm == "altered":
            victim = next(p for p in sorted(path.rglob("part-*")) if "metadata" in str(p) and not p.name.endswith(".crc"))
            victim.write_text(victim.read_text().replace("uid", "uit"))
            (victim.parent / f".{victim.name}.crc").unlink(missing_ok=True)
        else:
            import shutil

            shutil.rmtree(f"{path}.sha256")
        with pytest.raises(ModelIntegrityError):
            model.cached(samples, folder, retrain=False)
        assert model.cached(samples, folder) is m
    assert len(trained) == 3
    monkeypatch.setattr(model, "CHAR_BUCKETS", 1 << 13)
    with pytest.raises(ModelIntegrityError):
        model.load(spark, str(path))
