"""Rates of the mixing fit against a solver."""

import random
import warnings

import numpy as np
import pytest

import corpus_pipeline
from docloom.llm import mixing


def least_residual(p, want):
    """Brute force: the norm of the residual of nonnegative least squares, by exchange of active documents."""
    active, x = [], np.zeros(0)
    for _ in range(500):
        rest = want - p[active].T @ x if active else want
        gain = p @ rest
        best = int(np.argmax(gain))
        if gain[best] <= 1e-12 * np.abs(want).sum() or best in active:
            return np.linalg.norm(rest)
        active, x = [*active, best], np.append(x, 0.0)
        while True:
            s = np.linalg.lstsq(p[active].T, want, rcond=None)[0]
            if (s > 0).all():
                x = s
                break
            a = min(x[i] / (x[i] - s[i]) for i in range(len(s)) if s[i] <= 0)
            x = x + a * (s - x)
            keep = x > 1e-12
            active, x = [i for i, k in zip(active, keep, strict=True) if k], x[keep]
    raise AssertionError("no solution")


def members(spark, n, seed, sharp):
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((n, 3)) * 0.3 + sharp * np.eye(3)[rng.choice(3, n, p=[0.7, 0.2, 0.1])]
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    t = rng.integers(0, 400, n)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p, strict=True)], "tokens long, p array<double>").repartition(5)
    return df, t.astype(float), p


def rates(p, fit, lowest):
    return mixing.replayed(p, fit.moves, lowest)


@pytest.mark.parametrize("shares, lowest", [((0.2, 0.3, 0.5), 0.0), ((0.94, 0.03, 0.03), 0.0), ((0.5, 0.25, 0.25), 1.0)])
def test_targets_in_reach_are_met_in_few_steps(spark, shares, lowest):
    df, t, p = members(spark, 400, 3, 4.5)
    have = t @ p
    targets = np.array(shares) * have.sum()
    if lowest:
        parts = np.zeros((3, 3))
        np.add.at(parts, p.argmax(axis=1), p * t[:, None])
        targets = np.array(shares) * mixing.reachable(parts, np.array(shares))
        assert (targets >= have - 1e-6).all()
    fit = mixing.fit_rates(df, targets, lowest)
    assert fit.met and fit.residual <= mixing.MET and len(fit.moves) <= 20
    r = rates(p, fit, lowest)
    assert (r >= lowest).all() and (t * r) @ p == pytest.approx(targets, abs=2e-6 * targets.sum())
    assert least_residual(p, targets - lowest * have) <= 1e-6 * targets.sum()  # the solver agrees that they are in reach


def test_targets_out_of_reach_are_said_to_be(spark):
    df, t, p = members(spark, 300, 4, 2.0)
    targets = np.array([0.0, 0.0, 1.0]) * t.sum()
    with pytest.warns(UserWarning, match="residual"):
        fit = mixing.fit_rates(df, targets, 0.0)
    r = rates(p, fit, 0.0)
    left = np.abs((t * r) @ p - targets).max() / targets.sum()
    assert not fit.met and fit.residual == pytest.approx(left) and least_residual(p, targets) > 1e-3 * targets.sum()
    assert left < np.abs(t @ p - targets).max() / targets.sum()


def test_mixing_of_the_pipeline_is_at_the_optimum(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = mixing.mix(docs, labels, corpus_pipeline.TARGETS, lowest=1.0, upsample=True).collect()
    assert all(g.met and g.residual <= mixing.MET and g.rate >= 1 for g in got)
    p, t, r = np.array([g.posterior for g in got]), np.array([g.n_tokens for g in got]), np.array([g.rate for g in got])
    names = sorted({r.lang for r in docs.select("lang").distinct().collect() if r.lang})
    total = (t * r) @ p
    assert total / total.sum() == pytest.approx([corpus_pipeline.TARGETS[n] for n in names], abs=1e-5)


def test_mixing_of_long_repeated_and_tied_rows(spark):
    rng = random.Random(1)
    say = {"a": "uno due tre quattro", "b": "one two three four"}
    rows = [(i, " ".join(rng.choices(say[k].split(), k=20)), k) for i, k in enumerate("ab" * 30)]
    rows += [(100, say["a"] * 30_000, "a"), (101, "one", "b"), (101, "one", "b"), (102, "one", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = mixing.mix(docs, docs.select("doc_id"), {"a": 0.5, "b": 0.5}).collect()
    assert len(got) == len(rows) and len({(g.rate, tuple(g.posterior)) for g in got if g.doc_id in (101, 102)}) == 1
    assert mixing.resampled(docs, mixing.mix(docs, docs.select("doc_id"), {"a": 0.5, "b": 0.5}, lowest=1.0, upsample=True)).select("doc_id").distinct().count() == 63
