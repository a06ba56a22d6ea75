import math

import pytest
from pyspark.sql import functions as F

from docloom.operators import lexical, rerank, vectors
from docloom.sources import documents
from docloom.sources.clients import HashingEmbedder, ModelError, embed_all
from docloom.sources.config import Settings
from docloom.sources.index_store import IndexStore

DOCS = [(0, "alpha beta"), (1, "alpha gamma gamma")]


def top(spark, query, docs=DOCS, k=6):
    q = spark.createDataFrame([(1, query)], "query int, query_text string")
    d = spark.createDataFrame(docs, "doc_id int, text string")
    return [(r.chunk, r.score) for r in lexical.lexical_top(q, d, k, chunk="doc_id").orderBy("rank").collect()]


def test_bm25(spark):
    assert top(spark, "gamma") == [(1, 0.931625), (0, 0.0)]
    assert top(spark, "gamma gamma")[0] == (1, pytest.approx(0.7 * 1.804643 + 0.3, abs=1e-5))
    assert top(spark, "123") == [(0, 0.0), (1, 0.0)]
    assert top(spark, "gamma", []) == []


def test_bonus_is_of_substrings(spark):
    df = spark.createDataFrame([("go back", "he is back")], "q string, t string")
    assert df.select(lexical.keyword_bonus("q", "t")).first()[0] == pytest.approx(0.08)


def test_vector_top_matches_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((300, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = vectors.vector_top(rows.filter("vec_id < 5").withColumnRenamed("vec_id", "query"), rows, 7).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = (u[:5] @ u.T).round(6)
    for q in range(5):
        best = sorted(range(300), key=lambda j: (-score[q, j], j))[:7]
        assert [r.vec_id for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == best


def test_cosine_edges(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [1.0, 1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine("a", "b")).collect()] == [0.0, pytest.approx(2 / math.sqrt(6))]


def test_index_verdicts(spark):
    def error(rows):
        df = spark.createDataFrame(rows, "source string, embedding array<double>")
        return vectors.verdict(vectors.index_report(df)).first().error

    assert error([("a", [1.0]), ("b", [2.0])]) == ""
    assert "empty" in error([]) and "differ" in error([("a", [1.0]), ("b", None)])
    assert "dimension" in error([("a", [1.0]), ("b", [1.0, 2.0])]) and "a vector is empty" == error([("a", []), ("b", [])])


class Scripted:
    def __init__(self, *answers):
        self.answers, self.sizes = list(answers), []

    def embed(self, model, texts):
        self.sizes.append(len(texts))
        answer = self.answers.pop(0) if self.answers else None
        if isinstance(answer, Exception):
            raise answer
        return [[1.0]] * (len(texts) if answer is None else answer)


def test_embedding_batches_shrink_and_retry():
    waits = []
    client = Scripted(ModelError("it should not be larger than 2"), None, ModelError("rate limit"), None)
    assert len(embed_all(client, "m", ["t"] * 5, 4, 4, 1.0, waits.append)) == 5
    assert client.sizes == [4, 2, 2, 2, 1] and waits == [1.0]
    waits = []
    with pytest.raises(ModelError):
        embed_all(Scripted(*[ModelError("timeout")] * 4), "m", ["t"], 4, 4, 1.0, waits.append)
    assert waits == [1.0, 2.0, 4.0]
    with pytest.raises(ModelError):
        embed_all(Scripted(3), "m", ["t"], 4, 4, 1.0, waits.append)
    with pytest.raises(ModelError):
        embed_all(Scripted(ModelError("bad key")), "m", ["t"], 4, 4, 1.0, waits.append)


def test_store(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index")
    rows = spark.createDataFrame([("c", "s", "t", [1.0, 2.0])], "chunk_id string, source string, text string, embedding array<double>")
    assert store.load("f") is None and store.latest() is None
    built = []
    for _ in range(2):
        store.load_or_build("f", lambda: built.append(1) or rows, "m", "b")
    assert built == [1] and store.latest() == "f"
    assert store.load("f", "other") is None and store.load("f", "m", "other") is None
    with pytest.raises(ValueError):
        store.save("g", rows.withColumn("embedding", F.array().cast("array<double>")), "m", "b")
    assert store.load("g") is None


def test_engine(spark, tmp_path):
    from docloom.plans.engine import Engine

    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# Gain\n" + "loop gain of the amplifier is measured here with care. " * 3)
    (folder / "b.html").write_text("<h1>FFT</h1><p>" + "spectrum of the converter and its spurs are shown. " * 3 + "</p>")
    settings = Settings(resource_dir=str(folder), index_dir=f"file://{tmp_path}/index", work_dir=str(tmp_path / "work"))
    engine = Engine(spark, settings)
    assert engine.reindex().first().chunks == 2
    answer = engine.run("loop gain", 2, execute=False)
    assert [e["source"].rsplit("/", 1)[-1] for e in answer["evidence"]][0] == "a.md" and answer["status"] == "generated"
    rows = engine.retrieve(spark.createDataFrame([(1, "spectrum"), (2, "gain")], "query long, query_text string"), 1).hits.collect()
    assert {(r.query, r.source.rsplit("/", 1)[-1]) for r in rows} == {(1, "b.html"), (2, "a.md")}

    asked = engine.run("bandwidth", 1, execute=True)
    assert "'vin'" in (tmp_path / "work" / asked["task_id"] / "main.py").read_text()
    with pytest.raises(ValueError):
        engine.run("sfdr", 1, execute=True)

    class Broken:
        def embed(self, model, texts):
            raise ModelError("bad key")

    failing = Engine(spark, Settings(resource_dir=str(folder), index_dir=f"file://{tmp_path}/none"), Broken)
    out = failing.retrieve(spark.createDataFrame([(1, "loop gain")], "query long, query_text string"), 1)
    assert out.warnings and out.hits.first().source.endswith("a.md")
    reranked = Engine(spark, settings, HashingEmbedder, lambda q, texts, n: '{"results":[{"index":1,"score":0.5}]}')
    assert reranked.retrieve(spark.createDataFrame([(1, "loop gain")], "query long, query_text string"), 1).hits.count() == 1
    with pytest.raises(ValueError):
        engine.run("q", 21)
    assert documents.scan(spark, f"{tmp_path}/nowhere").count() == 0


def test_rerank(spark):
    from docloom.plans.queries import RESPONSES

    items = rerank.parsed_response(spark.createDataFrame(RESPONSES, "query int, body string"))
    candidates = spark.createDataFrame([(q, o) for q in (1, 2) for o in range(3)], "query int, ord long")
    got = {(r.query, r.rank, r.ord) for r in rerank.resolved(items, candidates, 2, 20).collect()}
    assert got == {(1, 1, 1), (1, 2, 1), (2, 1, 1)}


def by_hand(docs, queries):
    """(query, chunk) to [bm25, overlap]; rows that share an id count by length and are summed."""
    tokens = [(c, (t or "").split()) for c, t in docs]
    mean = max(1.0, sum(len(t) for _, t in tokens) / len(tokens))
    tf = {}
    for c, t in tokens:
        for w in t:
            tf[c, len(t), w] = tf.get((c, len(t), w), 0) + 1
    df = {}
    for _, _, w in tf:
        df[w] = df.get(w, 0) + 1
    out = {}
    for q, text in queries:
        asked = text.split()
        for (c, n, w), f in tf.items():
            if w in asked:
                idf = math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1)
                pair = out.setdefault((q, c), [0.0, 0.0])
                pair[0] += asked.count(w) * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))
                pair[1] += 1 / len(set(asked))
    return out


@pytest.mark.parametrize("few", [100, 0])
def test_pairs_leave_tasks_unshuffled(spark, monkeypatch, few):
    import random

    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdef" for b in "vwxyz"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, text(rng.randint(0, 15))) for i in range(120)]
    queries = [(i, text(4)) for i in range(7)] + [(50, "nothing"), (51, "")]
    asked = lexical.query_terms(spark.createDataFrame(queries, "query long, text string"), "query", "text")
    odd = [*docs, *((i % 3, text(6 + i % 2)) for i in range(20)), (None, text(5)), (None, text(5)), (None, text(9))]
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 3)
    monkeypatch.setattr(lexical, "PAIRS", 50)
    monkeypatch.setattr(lexical, "FEW", few)
    for rows in (docs, odd):
        tokens = lexical.tokenized(spark.createDataFrame(rows, "chunk long, text string").repartition(3), "chunk", "text")
        made = lexical.matches(asked, tokens)
        got, want = {(r.query, r.chunk): [r.bm25, r.overlap] for r in made.collect()}, by_hand(rows, queries)
        assert made.count() == len(got) and set(got) == set(want)
        for pair, scores in want.items():
            assert got[pair] == pytest.approx(scores, abs=1e-9)
        best = {}
        for r in lexical.matches(asked, tokens, 4).collect():
            best.setdefault(r.query, []).append((-r.broad, r.chunk))
        for q, _ in queries:
            ranks = sorted((-round(0.7 * b + 0.3 * o, 6), c) for (a, c), (b, o) in want.items() if a == q and c is not None)
            assert sorted(best.get(q, []))[:4] == ranks[:4]
    tokens = lexical.tokenized(spark.createDataFrame(docs, "chunk long, text string"), "chunk", "text")
    assert "Exchange" not in lexical.matches(asked, tokens)._jdf.queryExecution().executedPlan().toString()
    assert lexical.matches(asked.limit(0), tokens).count() == 0
