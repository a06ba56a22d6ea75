"""Nulls, empty and very long texts, repeated rows, empty tables and clashing names, in the pipeline's stages and operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import queries, quality

DATA = "/root/testdata/sf0.001"
CLASHES = ["score", "at", "h", "_at", "_list", "band", "id", "component", "rate", "times", "copy", "g", "key", "text_", "c0", "n"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated ids and rows, and columns that operators use themselves."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    schema = docs.schema
    long = " ".join(f"long{i % 977} of{i % 13}" for i in range(150_000))
    rows = [(9001, None, "en", "s", 0), (None, "a text without an id that has some words", None, None, None), (9002, "", "de", "s", 0), (9003, " \n\t", "fr", "s", 3)]
    rows += [(9004, long, "en", "s", len(long)), (9005, "the same row twice here", "en", "s", 23), (9005, "the same row twice here", "en", "s", 23), (9005, "another text of that id", "en", "s", 23)]
    types = {f.name: f.dataType.simpleString() for f in schema}
    extra = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(c).cast(types[c]) for c in docs.columns])
    out = docs.unionByName(extra).withColumns({c: F.lit(f"kept {c}") for c in CLASHES})
    path = f"{spark.conf.get('spark.checkpoint.dir')}/odd"
    out.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, odd, name, stage):
    out = stage(spark, odd, DATA)
    if name == "tokenise":
        assert out.columns == ["doc_id", "ids"] and out.count() == odd.count()
        return
    assert out.columns == odd.columns
    rows = out.collect()
    given = {(r.doc_id, r.text) for r in odd.collect()}
    assert all(r[c] == f"kept {c}" for r in rows for c in CLASHES)
    if name != "line_dedup":  # the others leave texts as they are
        assert {(r.doc_id, r.text) for r in rows} <= given
    ids = {r.doc_id for r in rows}
    if name == "near_dedup":
        assert None in ids and {9001, 9002, 9003, 9004, 9005} <= ids and sum(r.doc_id == 9005 for r in rows) == 1
    if name in ("line_dedup", "mixing"):
        assert ids == {i for i, _ in given} and len(rows) >= odd.count()
        assert all(len(r.text or "") == (r.n_chars or 0) for r in rows if name == "line_dedup" and r.text is not None)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_tables(spark, odd, name, stage):
    out = stage(spark, odd.limit(0), DATA)
    assert out.count() == 0 and out.columns == (["doc_id", "ids"] if name == "tokenise" else odd.columns)


def test_pairs_are_fitted_as_by_hand():
    """The fit on sampled pairs against plain gradient descent on every pair."""
    rng = np.random.default_rng(11)
    width = len(quality.NAMES)
    better, worse = rng.standard_normal((60, width)) + 0.6 * rng.standard_normal(width), rng.standard_normal((50, width))
    ranker = quality.fit_pairs(better, worse, 0.3, ridge=0.05)
    both = np.concatenate([better, worse])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    p, q = (better - mean) / scale, (worse - mean) / scale
    d = (p[:, None, :] - q[None, :, :]).reshape(-1, width)
    w = np.zeros(width)
    for _ in range(4000):
        w -= 0.1 * (0.05 * w - (d / (1 + np.exp(d @ w))[:, None]).mean(axis=0))
    assert np.abs(ranker.weights - w).max() < 0.1 * np.abs(w).max()
    assert np.corrcoef(ranker.raw(both), (both - mean) / scale @ w)[0, 1] > 0.995
    # The threshold is the quantile of the scores, each label weighing its share.
    raw, weight = ranker.raw(both), np.concatenate([np.full(60, 0.7 / 60), np.full(50, 0.3 / 50)])
    assert weight[raw < ranker.cut].sum() == pytest.approx(0.3, abs=0.02)


def test_quality_of_long_and_repeated_texts(spark):
    long = "Plain words of a long text that goes on. " * 60_000
    rows = [(i, "Some plain words, and a sentence more. " * (i + 1)) for i in range(8)] + [(10 + i, "$$$ ### 111 " * (i + 2)) for i in range(8)]
    rows += [(50, long), (51, long), (51, long), (52, "$$$"), (52, "$$$")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranker = quality.fit(docs, spark.createDataFrame([(i, int(i < 10)) for i, _ in rows[:16]], "doc_id long, quality int"), F.lit(True))
    got = {}
    for r in quality.score(docs, ranker).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert len(got[51]) == 2 and got[51][0] == got[51][1] == got[50][0] and got[52][0] == got[52][1]
    assert got[0][0] >= quality.THRESHOLD > got[17][0]


def test_null_ids_are_neither_held_out_nor_learnt_from(spark, tmp_path):
    rows = [(i, f"some words of document {i % 5} here") for i in range(30)] + [(None, "unseen words only"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (queries.op3_quality, queries.op4_lm_scoring):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == 32 and sum(r.held_out is None for r in got) == 2 and all(r.held_out is None for r in got if r.doc_id is None)
    assert sorted(r.n_known for r in got if r.doc_id is None) == [1, 2]  # the end; and "words", which others teach
