"""A third of all rows under one key: payloads, band keys, boxes of vectors; both ways of joining give the same rows."""

import numpy as np
import pytest

from docloom.llm import common, embeddings, minhash, warc


@pytest.mark.parametrize("most", [1_000, 4, 0.5])
def test_join_by_frequency(spark, monkeypatch, most):
    monkeypatch.setattr(common, "FREQUENT", most)
    rows = spark.createDataFrame([(i, 0 if i % 3 == 0 else i // 4) for i in range(300)], "i long, k long")
    keyed = common.materialize(rows.groupBy("k").count().filter("count > 1").selectExpr("k", "k * 10 AS v", "count AS n"), "keyed")
    got = sorted((r.i, r.k, r.v) for r in common.join_frequent(rows, keyed, ["k"], "n", 300).collect())
    times = {}
    for r in rows.collect():
        times[r.k] = times.get(r.k, 0) + 1
    assert got == sorted((r.i, r.k, r.k * 10) for r in rows.collect() if times[r.k] > 1)


@pytest.mark.parametrize("most", [1_000, 4, 0.5])
def test_one_payload_of_a_third_of_the_pages(spark, monkeypatch, most):
    monkeypatch.setattr(common, "FREQUENT", most)
    monkeypatch.setattr(warc, "RANGE", 4096)
    hot, big = "<p>" + "same page " * 30, "x" * 30_000  # the latter is longer than a range when compressed or not
    rows = [(i, f"u{i}", hot if i % 3 == 0 else big if i % 50 == 1 else f"<p>{i} " + "own " * (i % 40)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(spark, pages).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h, i)
    want = {i: (len(h), "response" if len(h) < 100 or first[h] == i else "revisit", None if len(h) < 100 or first[h] == i else first[h]) for i, _, h in rows}
    assert got == want


@pytest.mark.parametrize("most", [1_000, 3, 0.5])
def test_one_band_of_a_third_of_the_documents(spark, monkeypatch, most):
    monkeypatch.setattr(common, "FREQUENT", most)
    monkeypatch.setattr(minhash, "TILE", 8)
    monkeypatch.setattr(minhash, "SETS", 4)
    stem = [f"s{k}" for k in range(120)]
    texts = {i: " ".join([*stem, f"t{i}"]) if i % 3 == 0 else " ".join(f"w{i}x{k}" for k in range(30)) for i in range(90)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: 0 if i % 3 == 0 else i for i in texts}


def test_vectors_of_several_widths(spark):
    """Each width is a join of its own, whatever its share."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for width, n in ((3, 40), (2, 5), (1, 3), (17, 12)):
        x = rng.standard_normal((n, width))
        x[1] = x[0] * 3
        base = len(rows)
        rows += [(base + i, v.tolist()) for i, v in enumerate(x)]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = u @ u.T >= 0.95
        np.fill_diagonal(near, False)
        want |= {base + i: int(near[i].sum()) for i in range(n)}
    rows += [(900, [1.0] * 5), (None, [1.0, 2.0]), (901, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicate_vectors(df.repartition(3)).collect()}
    assert {i: got[i][0] for i in want} == want and got[40][0] > 0 and got[900][0] == got[901][0] == 0
    assert got[None] == (0, None, True)


def test_vectors_that_share_an_id(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.01]), (7, [1.0, 0.02]), (9, [0.0, 1.0]), (9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicate_vectors(df).collect()}
    assert got == {(5, 2, 5, True), (7, 2, 5, False), (9, 0, 9, True)}


@pytest.mark.parametrize("slab", [20, 5])
def test_boxes_over_several_coordinates(spark, monkeypatch, slab):
    monkeypatch.setattr(embeddings, "SLAB", slab)
    monkeypatch.setattr(embeddings, "HOMES", 16)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((260, 12))
    x[60:130] = x[rng.integers(0, 60, 70)] + 0.2 * rng.standard_normal((70, 12))
    slabs = embeddings.boxes_for(260, 12)
    assert sum(s > 1 for s in slabs) > 1 and np.prod(slabs) * slab >= 260
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicate_vectors(df.repartition(3)).collect()}
    assert got == {i: int(near[i].sum()) for i in range(260)} and near.sum() > 40


def test_many_ranges_of_ids(spark, monkeypatch):
    """More ranges than a block of bounds, and ids that repeat."""
    from docloom.llm import fingerprint

    monkeypatch.setattr(fingerprint, "RANGE_CHARS", 2)
    monkeypatch.setattr(fingerprint, "BLOCK", 4)
    rows = [(i * 7 % 101 - 20, "text " * (i % 4) + f"é{i}") for i in range(101)] + [(5, "again"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint.edited_likeness(docs.repartition(4)).collect()}
    order = sorted(((i, t) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    import hashlib

    want = set()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want.add((i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    assert got == want
