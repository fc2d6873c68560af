"""Held-out accuracy of the trained classifiers, and their answers without labels."""

import numpy as np

from recfuse.llm import quality_model, toxicity
from recfuse.llm.linear import Rows, logistic, sigmoid

SF_DIR = "/root/testdata/sf0.1"


def held_out_results(spark, query, label):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    frame = query(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    y, p = frame[label] == 1, frame.predicted == 1
    return (y & p).sum() / max(p.sum(), 1), (y & p).sum() / y.sum()


def test_toxicity_on_held_out_rows(spark):
    precision, recall = held_out_results(spark, toxicity.scored, "toxic")
    assert precision > 0.95 and recall > 0.8


def test_quality_on_held_out_rows(spark):
    precision, recall = held_out_results(spark, quality_model.scored, "quality")
    assert precision > 0.95 and recall > 0.95


def test_models_without_labels(spark, small):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.scored(small, none).collect()} == {float(sigmoid(np.array(-100.0)))}
    assert {r["score"] for r in quality_model.scored(small, none).collect()} == {0.5}


def test_non_negative_risk_learns_from_positive_and_unlabelled():
    rng = np.random.default_rng(0)
    clean = [list(rng.integers(0, 500, 20)) for _ in range(900)]
    toxic = [list(rng.integers(0, 500, 20)) + [1000 + int(rng.integers(5))] for _ in range(300)]
    weights, bias = toxicity.fit(toxic[:200], clean[:400] + toxic[200:245], 0.1)
    score = lambda rows: sigmoid(Rows(rows).scores(weights, bias))
    assert (score(toxic[245:]) >= 0.3).mean() > 0.95 and (score(clean[400:]) < 0.3).mean() > 0.95


def test_toxic_words_count_at_any_prior():
    """Toxic words get weights where three tenths are toxic, where they are rare, and where clean texts have them now and then."""
    rng = np.random.default_rng(0)
    noise = lambda: list(rng.choice(500, 20, replace=False))
    clean = [noise() + [1005] * int(rng.random() < 0.02) for _ in range(1400)]
    toxic = [noise() + ([1006] if k % 125 == 0 else [1000 + int(rng.integers(5))]) + [1005] * int(rng.random() < 0.25) for k in range(1600)]
    sample = clean[:700] + toxic[1000:1300]
    weights, bias = toxicity.fit(toxic[:1000], sample, 0.3)
    score = lambda rows: sigmoid(Rows(rows).scores(weights, bias))
    assert all(weights[f] > 0 for f in range(1000, 1007)) and (weights[:500] != 0).mean() < 0.1
    assert (score(toxic[1300:]) >= toxicity.THRESHOLD).mean() > 0.95 and (score(clean[700:]) < toxicity.THRESHOLD).mean() > 0.9


def test_logistic():
    rows = Rows([[1, 2], [1], [3], [3, 4]])
    weights, bias = logistic(rows, np.array([1, 1, 0, 0]))
    assert ((rows.scores(weights, bias) > 0) == [True, True, False, False]).all()
