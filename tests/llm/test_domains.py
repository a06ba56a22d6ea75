"""The mixing classifier against the minimum of the loss of all labelled rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import mixing

SAY = {"a": "uno due tre quattro cinque", "b": "one two three four five", "c": "eins zwei drei"}


def labelled_rows(spark, n):
    """Rows (doc_id, text, lang) of which the one whose id hashes highest is the only one of lang c."""
    rng = np.random.default_rng(6)
    last = spark.range(n).orderBy(F.xxhash64("id").desc(), F.desc("id")).first().id
    langs = ["c" if i == last else "ab"[int(rng.random() < 0.4)] for i in range(n)]
    words = SAY["a"].split() + SAY["b"].split()
    return [(i, " ".join([*rng.choice(SAY[k].split(), 3), *rng.choice(words, 2)]), k) for i, k in enumerate(langs)]


def gradient(rows, domains, ridge=1e-3):
    """Of the mean loss of ``rows`` at the fitted weights, in one piece."""
    x, _ = mixing.bag([t for _, t, _ in rows])
    hot = np.eye(len(domains.names))[[domains.names.index(k) for _, _, k in rows]]
    x = np.column_stack([x, np.ones(len(x))])
    w = np.vstack([domains.weights, domains.bias])
    z = np.exp(x @ w)
    return x.T @ (z / z.sum(axis=1, keepdims=True) - hot) / len(x) + ridge * w


def test_classifier_is_fitted_on_all_labelled_rows(spark):
    rows = labelled_rows(spark, 6_500)
    others = [(7_000 + i, "sette otto", "b") for i in range(50)] + [(None, "nove", "a"), (3, "una", None)]
    docs = spark.createDataFrame([*rows, *others], "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([*[(i,) for i, _, _ in rows], (1,), (1,), (None,), (90_000,)], "doc_id int").repartition(3)
    got = mixing.fit_domains(docs, labels, "lang")
    assert got.names == ["a", "b", "c"]
    assert np.abs(gradient(rows, got)).max() < 1e-7  # the ridge makes the loss strictly convex: nearer to its minimum than 1e-7 / ridge
    again = mixing.fit_domains(docs, labels, "lang")
    assert (again.weights == got.weights).all() and (again.bias == got.bias).all()


def test_stage_of_the_pipeline_learns_languages_from_all_labelled_rows(spark, tmp_path, monkeypatch):
    rows, fitted = labelled_rows(spark, 6_200), []
    spark.createDataFrame([(i, 1) for i, _, _ in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    fit = mixing.fit_domains
    monkeypatch.setattr(mixing, "fit_domains", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string")
    monkeypatch.setattr(corpus_pipeline, "TARGETS", {"a": 0.5, "b": 0.4, "c": 0.1})
    assert corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == len(rows)
    assert np.abs(gradient(rows, fitted[0])).max() < 1e-7


@pytest.mark.parametrize("kinds", [("string", "string"), ("int", "double"), ("decimal(10,2)", "long")])
def test_keys_of_labels_meet_those_of_documents_whatever_their_types(spark, kinds):
    docs = spark.range(40).select(F.col("id").cast(kinds[0]).alias("doc_id"), F.when(F.col("id") % 2 == 0, "uno due").otherwise("one two").alias("text"), (F.col("id") % 2).alias("lang"))
    labels = spark.range(0, 80, 3).select(F.col("id").cast(kinds[1]).alias("doc_id"))
    assert mixing.labelled_bags(docs, labels, "lang", "doc_id", "text").count() == 14
    bags = mixing.labelled_bags(docs.limit(0), labels, "lang", "doc_id", "text")
    assert bags.count() == 0 and mixing.fit_domains(docs, labels.limit(0), "lang").names == [""]
