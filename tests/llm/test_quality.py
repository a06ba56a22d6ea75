"""The quality model against one that makes every pair."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import quality

DATA = "/root/testdata/sf0.001"


def on_every_pair(x, y, ridge=1e-2):
    """(mean, scale, weights, cut) of the preference model, with all pairs of rows made."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = ((x - mean) / scale).clip(-20, 20)
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        s = 1 / (1 + np.exp((d @ w).clip(-500, 500)))
        gradient = ridge * w - (d * s[:, None]).mean(axis=0)
        w = w - np.linalg.solve((d * (s * (1 - s))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), gradient)
    raw = np.sort(z @ w)
    return mean, scale, w, (raw[(y == 0).sum() - 1] + raw[(y == 0).sum()]) / 2


def test_quality_is_fitted_on_every_pair(spark):
    rng = np.random.default_rng(8)
    words = ["plain", "of", "Sense", "some", "7", "42", "$$", "a.", "x", "reading"]
    texts = [(i, "\n".join(" ".join(rng.choice(words[i % 3 :], rng.integers(1, 30))) for _ in range(rng.integers(1, 5)))) for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    marks = [(i, int(rng.random() < (0.9 if i % 3 else 0.5))) for i in range(500)]
    labels = spark.createDataFrame([*marks, *marks[:40], (9000, 0), (9001, 0)], "doc_id int, quality int").repartition(3)
    got = quality.fit(docs, labels, F.col("doc_id") % 4 != 2)
    taught = [(t, y) for (_, t), (i, y) in zip(texts, marks, strict=False) if i % 4 != 2]
    x, y = quality.features([t for t, _ in taught]), np.array([y for _, y in taught])
    mean, scale, w, cut = on_every_pair(x, y)
    assert np.abs(got.mean - mean).max() < 1e-12 and np.abs(got.scale - scale).max() < 1e-12
    assert np.abs(got.weights - w).max() < 1e-6 and got.cut == pytest.approx(cut, abs=1e-5)
    raw = got.raw(x)
    assert (raw < got.cut).sum() == (y == 0).sum() or np.isclose(raw, got.cut, atol=1e-12).any()
    assert got.cut == np.sort(raw)[(y == 0).sum() - 1 :][:2].mean()


def test_scores_are_selected_exactly():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal(3000) * 10, np.zeros(300), [-0.0, 1e-300, -1e300, 5e-324]])
    for rank in (0, 1, 1400, 1600, 1700, len(x) - 1):
        assert quality.ranked_value(lambda count: count(x), rank) == np.sort(x)[rank]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stage_of_the_pipeline_learns_from_every_pair(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    marks = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.doc_id in texts]
    x, y = quality.features([texts[i] for i, _ in marks]), np.array([q for _, q in marks])
    mean, scale, w, cut = on_every_pair(x, y)
    got = quality.score(docs, quality.fit(docs, docs.sparkSession.createDataFrame(marks, "doc_id long, quality int"), F.lit(True)))
    got, raw = {r.doc_id: r.score for r in got.collect()}, ((quality.features(list(texts.values())) - mean) / scale).clip(-20, 20) @ w
    for i, r in zip(texts, raw, strict=True):
        if abs(r - cut) > 1e-5:
            assert got[i] == pytest.approx(1 / (1 + 3 / 7 * np.exp(cut - r)), abs=1e-5)
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, DATA).collect()}
    assert kept >= {i for i, r in zip(texts, raw, strict=True) if r > cut + 1e-5} and not kept & {i for i, r in zip(texts, raw, strict=True) if r < cut - 1e-5}
