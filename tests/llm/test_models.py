"""Near duplicates, quality, language model, mixing and the pipeline."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import embeddings, lm, minhash, mixing, quality
from docloom.llm.components import components


def joined(n, links):
    """Brute force: smallest member of each component."""
    at = {i: i for i in n}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(at[a], at[b])
            if at[a] != low or at[b] != low:
                at[a] = at[b] = low
                changed = True
    return at


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, 2000 + k) for k in range(50)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r.id: r.component for r in components(df).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in joined({x for p in links for x in p}, links).items() if k in nodes}
    assert components(df.limit(0)).count() == 0


# MinHash


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def expected_groups(texts, percent=85):
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, joined(sets, links)


def varied(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.random()}"
    return " ".join(words)


def test_minhash_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "SETS", 8)
    rng = random.Random(9)
    base = [f"x{k}" for k in range(150)]
    texts = {i: varied(rng, base, rng.choice([0, 1, 1, 2, 2, 3, 4, 5])) for i in range(90)}  # a hot group on both sides of the threshold
    for i in range(100, 140):
        texts[i] = " ".join(f"{rng.random()}" for _ in range(rng.randint(1, 60)))
    texts |= {200: None, 201: "", 202: "one two", 203: "One  TWO", 204: "one two three", 205: texts[0].upper(), 206: texts[3], 207: "a b " * 50_000, 208: "É é", 209: "é é", 210: " \t\n"}
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, sig string, component long")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs.repartition(4)).collect()}
    sizes, groups = expected_groups(texts)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (sizes[i], groups[i], groups[i] == i) for i in texts}
    assert len({g for i, g in groups.items() if i < 90}) > 1


def test_minhash_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k l"), (7, "g h i j k l"), (7, "g h i j k l")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (7, 1, False), (7, 1, False)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    kept = minhash.without_near_duplicates(docs.withColumn("id", F.lit("c"))).collect()
    assert sorted((r.doc_id or 0, r.id) for r in kept) == [(0, "c"), (1, "c")]


def test_signature_estimates():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    room = np.empty((minhash.PERMS, 256), np.uint32)
    a, b = np.sort(pool[:2000]), np.sort(pool[200:2200])
    fields = minhash.agreement(minhash.packed(minhash.minima(a, room)) ^ minhash.packed(minhash.minima(b, room)))
    assert abs(minhash.estimated_similarity(fields) - 1800 / 2200) < 0.15
    assert minhash.agreement(np.zeros(minhash.LONGS, np.int64)) == minhash.PERMS > minhash.least_agreement(85) > minhash.PERMS // 2


def test_word_hashes_do_not_depend_on_segments():
    text = ("word %d " % 7) * 200_000 + "x" * 1_500_000 + " tail"
    words, starts = minhash.word_hashes(text.encode())
    assert len(words) == 400_002 and len(set(words.tolist())) == 4 and starts[0] == 0
    assert minhash.word_hashes(b"TAIL")[0][0] == words[-1]


# Vectors


@pytest.mark.parametrize("tile, slab", [(8192, 16384), (32, 60)])
def test_vectors_against_brute_force(spark, monkeypatch, tile, slab):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "SLAB", slab)
    monkeypatch.setattr(embeddings, "VISITORS", 64)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 24))
    x[100:180] = x[100] + 0.22 * rng.standard_normal((80, 24))  # cosines on both sides of the threshold
    x[200] = x[201] * 7
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    rows += [(900, None, ""), (901, [0.0] * 24, ""), (902, [float("nan")] * 24, ""), (903, [float("inf")] + [0.0] * 23, ""), (904, [None] + [1.0] * 23, ""), (905, [1.0], ""), (906, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicate_vectors(df.repartition(5)).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    groups = joined(range(300), [tuple(p) for p in np.argwhere(near)])
    assert {i: got[i] for i in range(300)} == {i: (int(near[i].sum()), groups[i], groups[i] == i) for i in range(300)}
    assert all(got[i] == (0, i, True) for i in range(900, 907)) and near.sum() > 100
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


# Quality


def test_quality_held_out_accuracy(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice("the of plain words in a text with some sense to read and more".split()) for _ in range(80)) + ".\n"
    bad = lambda: rng.choice([" ".join(["spam"] * 80), "BUY!! NOW!! " * 30, "a | b | $$$ %%% " * 20])
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("c"))
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in rows] + [(None, 1), (5000, 0), (3, None), (7, 9)], "doc_id long, quality int")
    ranker = quality.fit(docs, labels, F.col("doc_id") < 300)
    got = {r.doc_id: r.score for r in quality.score(docs, ranker).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 4 != 0) for i in range(300, 400)]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 403
    assert quality.score(docs.limit(0), ranker).count() == 0
    none = quality.fit(docs, labels.filter("quality = 1"), F.lit(True))
    assert {r.score for r in quality.score(docs, none).collect()} == {quality.THRESHOLD}


# Language model


def test_lm_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 300)
    monkeypatch.setattr(lm, "BUCKET", 50)
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40]) + (" New York" * (i % 5)) + "\t É") for i in range(100)]
    rows += [(200, None), (201, ""), (202, "a " * 60_000), (202, "b"), (None, "c"), (203, " ")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, batch string")
    teaches = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    got = lm.score_texts(docs.repartition(3), teaches).collect()
    taught = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    sequences = [(i, lm.tokens(t or "") + [b""]) for i, t in rows]
    counts, pairs = {}, {}
    for i, s in sequences:
        if taught(i):
            for a, b in zip([None, *s], s, strict=False):
                counts[b] = counts.get(b, 0) + 1
                pairs[a, b] = pairs.get((a, b), 0) + 1
    total, types = sum(counts.values()), len(counts)
    n1, n2 = (sum(c == k for c in counts.values()) for k in (1, 2))
    d = lm.discount(n1, n2)
    root = lambda w: max(counts.get(w, 0) - d, 0) / total + d * types / total / (types + 1)
    texts = sum(taught(i) for i, _ in sequences)
    history = lambda a: texts if a is None else counts[a]
    least = max(2, math.ceil(lm.FLOOR * total))
    arcs = {p: (c - d) / history(p[0]) for p, c in pairs.items() if c >= least}
    arcs = {p: s for p, s in arcs.items() if s >= lm.GAIN * root(p[1])}
    left, rest = {}, {}
    for (a, b), s in arcs.items():
        left[a], rest[a] = left.get(a, 1) - s, rest.get(a, 1) - root(b)
    expected = {}
    for i, s in sequences:
        score = sum(math.log10(arcs.get((a, b)) or root(b) * left.get(a, 1) / rest.get(a, 1)) for a, b in zip([None, *s], s, strict=False))
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + types + 1)) for w in s)
        expected.setdefault(i, []).append((taught(i), len(s), sum(w in counts for w in s), total, base, score))
    assert len(got) == len(rows) and arcs
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append((r.taught, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    for i, e in expected.items():
        for x, y in zip(sorted(seen[i]), sorted(e), strict=True):
            assert x[:4] == y[:4] and x[4:] == pytest.approx(y[4:], rel=1e-6)
    # The words of each state sum to one, the unknown one included.
    for a in [*list(left)[:5], b"w1"]:
        total_p = sum(arcs.get((a, b)) or root(b) * left.get(a, 1) / rest.get(a, 1) for b in [*counts, b"?"])
        assert total_p == pytest.approx(1, abs=1e-6)


def test_lm_edges(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = lm.score_texts(docs, F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert lm.score_texts(docs.limit(0), F.lit(True)).count() == 0


def test_lm_arcs_grow_with_the_corpus(spark):
    rows = [(1, "x " * 700_000), (2, "left right"), (3, "left right"), (4, "left right")]  # a bigram of 3e-6 of all tokens
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score_texts(docs, F.col("doc_id") < 4).collect()}
    left = 2 - lm.discount(0, 2)  # no word occurs once, two occur twice
    assert got[4] == pytest.approx(math.log10(left / 3) + 2 * math.log10(left / 2))


# Mixing


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    vocabulary = {"en": "the of and that with this".split(), "de": "der die und nicht das zu".split(), "fr": "le la et dans pour que".split()}
    rows = []
    for i in range(300):
        lang = "en" if i % 10 < 6 else "de" if i % 10 < 8 else "fr"
        rows.append((i, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(5, 80))), lang))
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "", "en"), (None, "der die", "de")], "doc_id long, text string, lang string").withColumn("rate", F.lit("c"))
    labelled = docs.filter("doc_id % 2 = 0").select("doc_id")
    got = mixing.mix(docs, labelled, {"en": 0.2, "de": 0.3, "fr": 0.5}).collect()
    p, t, r = np.array([g.posterior for g in got]), np.array([g.n_tokens for g in got]), np.array([g.rate for g in got])
    assert (t * r) @ p / (t * r).sum() == pytest.approx([0.3, 0.2, 0.5], abs=1e-3) and (r >= 0).all() and len(got) == 303
    truth = {i: lang for i, _, lang in rows}
    assert np.mean([truth[g.doc_id] == g.domain for g in got if g.doc_id in truth]) > 0.95
    mixed = mixing.mix(docs, labelled, {"en": 0.2, "de": 0.3, "fr": 0.5}, lowest=1.0, upsample=True)
    again = mixing.resampled(docs, mixed)
    assert again.columns == docs.columns and again.select("doc_id").distinct().count() == 303
    tokens = {"en": 0, "de": 0, "fr": 0}
    for x in again.filter("doc_id < 300").collect():
        tokens[x.lang] += len(x.text.split())
    assert tokens["fr"] / sum(tokens.values()) == pytest.approx(0.5, abs=0.08)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "", None)], "doc_id long, text string, lang string")
    got = mixing.mix(docs, docs.select("doc_id"), {"en": 1.0}).collect()
    assert [g.rate for g in got] == [1.0, 1.0] and got[0].domain == ""
    assert mixing.mix(docs.limit(0), docs.select("doc_id"), {}).count() == 0
    assert mixing.target_totals(["a", "b"], {"a": 1, "c": 5}, 10).tolist() == [10, 0]


# Pipeline


def test_pipeline_on_small_tables(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "tokenise"]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        new = spark.read.parquet(path)
        kept = {r.doc_id for r in new.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.7 * len(ids)
        if name == "near_dedup":
            texts = {r.doc_id: r.text for r in docs.collect()}
            _, groups = expected_groups(texts)
            assert kept == {i for i in texts if groups[i] == i}
        if name == "mixing":
            assert kept == ids and new.count() >= docs.count()
        docs, ids = new, kept
    out = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert out.columns == ["doc_id", "ids"] and out.count() == docs.count()
