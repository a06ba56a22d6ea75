"""The ladder of retrieval, batches, scripts, settings and the commit of indexes."""

import json

import pytest

from docloom.operators import lexical, rerank, vectors
from docloom.plans.engine import CodegenError, Engine
from docloom.sources.clients import HashingEmbedder, ModelError
from docloom.sources.config import Settings
from docloom.sources.index_store import IndexStore

TEXTS = {
    "a.md": "# Gain\n" + "loop gain of the amplifier is measured here with care. " * 3,
    "b.md": "# Spectrum\n" + "spectrum of the converter and its spurs are shown here. " * 3,
    "c.txt": "bandwidth of the filter is found by a sweep of the input. " * 3,
}


@pytest.fixture
def settings(tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    for name, text in TEXTS.items():
        (folder / name).write_text(text)
    return Settings(resource_dir=str(folder), index_dir=f"file://{tmp_path}/index", work_dir=str(tmp_path / "work"))


class Broken:
    def embed(self, model, texts):
        raise ModelError("bad key")


class Wrong:
    def embed(self, model, texts):
        raise TypeError("a bug")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query long, query_text string")


def names(hits, query=0):
    return [r.source.rsplit("/", 1)[-1] for r in hits.filter(f"query = {query}").orderBy("rank").collect()]


def by_word(word):
    """A reranker that puts texts with ``word`` first."""

    def call(query, texts, n):
        return json.dumps({"results": [{"index": i, "relevance_score": float(word in t)} for i, t in enumerate(texts)]})

    return call


def test_each_rung(spark, settings):
    queries = asked(spark, "loop gain", "spectrum of spurs")
    full = Engine(spark, settings, reranker=by_word("sweep")).retrieve(queries, 2)
    assert [names(full.hits, q)[0] for q in (0, 1)] == ["c.txt"] * 2 and not full.warnings
    lexical_only = Engine(spark, settings).retrieve(queries, 1)
    assert [names(lexical_only.hits, q) for q in (0, 1)] == [["a.md"], ["b.md"]] and not lexical_only.warnings
    # After a failed embedding the reranker still gets all chunks.
    failed = Engine(spark, Settings(resource_dir=settings.resource_dir, index_dir=settings.index_dir + "2"), Broken, by_word("sweep")).retrieve(queries, 1)
    assert [names(failed.hits, q) for q in (0, 1)] == [["c.txt"]] * 2
    assert len(failed.warnings) == 1 and "bad key" in failed.warnings[0]
    both = Engine(spark, Settings(resource_dir=settings.resource_dir, index_dir=settings.index_dir + "2"), Broken, lambda q, t, n: "{}").retrieve(queries, 1)
    assert [names(both.hits, q) for q in (0, 1)] == [["a.md"], ["b.md"]] and len(both.warnings) == 2


def test_many_chunks_are_proposed_lexically_to_the_reranker(spark, settings, monkeypatch):
    monkeypatch.setattr("docloom.plans.engine.ALL_RERANKED", 2)
    engine = Engine(spark, Settings(resource_dir=settings.resource_dir, index_dir=settings.index_dir + "2"), Broken, by_word("sweep"))
    assert names(engine.retrieve(asked(spark, "gain"), 1).hits) == ["c.txt"]


def test_one_query_falls_back_alone(spark, settings):
    def picky(query, texts, n):
        if "gain" in query:
            raise RuntimeError("not today")
        return by_word("sweep")(query, texts, n)

    out = Engine(spark, settings, reranker=picky).retrieve(asked(spark, "loop gain", "spectrum"), 1)
    assert names(out.hits, 0) == ["a.md"] and names(out.hits, 1) == ["c.txt"]
    assert out.warnings == ["rerank unavailable for 1 of the queries: not today; using lexical rerank fallback"]


def test_other_errors_are_raised(spark, settings):
    with pytest.raises(Exception, match="a bug"):
        Engine(spark, Settings(resource_dir=settings.resource_dir, index_dir=settings.index_dir + "3"), Wrong).retrieve(asked(spark, "x"), 1)


@pytest.mark.parametrize("body", ["no json", "[]", "{}", '{"results":[1]}', '{"results":[{"index":"0","score":1}]}', '{"data":[{"index":0,"score":"1"}]}', '{"results":[{"score":1}]}'])
def test_malformed_reranking_raises(body):
    with pytest.raises(ValueError):
        rerank.strict_items(body, 3)


def test_reranked_items_are_sorted_and_cut():
    body = '{"results":[],"data":[{"document_index":2,"score":0.1},{"index":0,"relevance_score":1},{"index":1,"score":0.1}]}'
    assert rerank.strict_items(body, 2) == [(1, 0, 1.0), (0, 2, 0.1)]


def test_ties_go_by_the_order_of_reading(spark, settings, tmp_path):
    for name in ("z.md", "y.html", "b2.md"):
        (tmp_path / "docs" / name).write_text("same words in every one of these documents, nothing else at all to tell them apart")
    hits = Engine(spark, settings).retrieve(asked(spark, "same words in documents"), 3).hits
    assert names(hits) == ["b2.md", "z.md", "y.html"]
    failed = Engine(spark, Settings(resource_dir=settings.resource_dir, index_dir=settings.index_dir + "2"), Broken)
    assert names(failed.retrieve(asked(spark, "same words in documents"), 3).hits) == ["b2.md", "z.md", "y.html"]


def test_lexical_statistics_are_those_of_each_querys_candidates(spark):
    queries = asked(spark, "gamma", "gamma beta", "123")
    pools = {0: {"p": "alpha beta", "q": "alpha gamma gamma"}, 1: {"p": "gamma", "r": "beta beta beta", "s": "none"}, 2: {"p": "x y"}}
    rows = [(q, c, t) for q, pool in pools.items() for c, t in pool.items()]
    got = lexical.lexical_within(queries, spark.createDataFrame(rows, "query long, chunk string, text string"), 6).collect()
    got = {(r.query, r.chunk): (r.rank, r.score) for r in got}
    for q, pool in pools.items():
        chunks = spark.createDataFrame(list(pool.items()), "chunk string, text string")
        one = lexical.lexical_top(queries.filter(f"query = {q}"), chunks, 6).collect()
        assert {(r.query, r.chunk): (r.rank, r.score) for r in one} == {k: v for k, v in got.items() if k[0] == q}


def test_tops_in_blocks_and_batches(spark, monkeypatch):
    import random

    rng = random.Random(3)
    words = [f"word{'abcdefghij'[i % 10]}{'klmno'[i % 5]}" for i in range(40)]
    docs = [(f"d{i:03}", " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(200)]
    queries = [(i, " ".join(rng.choices(words, k=3))) for i in range(9)]
    chunks, asked_ = spark.createDataFrame(docs, "chunk string, text string").repartition(5), spark.createDataFrame(queries, "query long, query_text string")
    want = {(r.query, r.chunk, r.broad, r.r) for r in lexical.broad_top(asked_, chunks, 30).collect()}
    terms = lexical.query_terms(asked_, "query", "query_text")
    pairs = {(r.query, r.chunk): round(r.broad, 6) for r in lexical.matches(terms, lexical.tokenized(chunks, "chunk", "text")).collect()}
    expected = set()
    for q, _ in queries:
        best = sorted(((-pairs.get((q, c), 0.0), c) for c, _ in docs))[:30]
        expected |= {(q, c, -s or 0.0, i + 1) for i, (s, c) in enumerate(best)}
    assert want == expected
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 2)
    monkeypatch.setattr(lexical, "MATRIX", 1)
    assert {(r.query, r.chunk, r.broad, r.r) for r in lexical.broad_top(asked_, chunks, 30).collect()} == want


def test_vector_ties_and_null_queries(spark):
    rows = spark.createDataFrame([(f"k{i:02}", [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)], "key string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query long, embedding array<double>")
    got = vectors.vector_top(queries, rows.repartition(3), 3, key="key").collect()
    assert sorted((r.query, r.key, r.rank) for r in got) == [(1, "k01", 1), (1, "k03", 2), (1, "k05", 3)]


def test_scripts(spark, settings, tmp_path):
    said = []

    def chat(messages, temperature):
        said.append((messages, temperature))
        return "```python\nprint(1)\n```" if temperature else 'Sure: {"input_node": "n1", "points": 50}'

    engine = Engine(spark, settings, chat=chat)
    out = engine.run("loop gain", 2)
    assert out["generated_code"] == "print(1)" and (tmp_path / "work" / out["task_id"] / "main.py").read_text() == "print(1)"
    code = engine.run("bandwidth of the filter", 1, execute=True)["generated_code"]
    assert "'n1'" in code and "50" in code and "c.txt" in code
    compile(code, "script", "exec")
    assert [t for _, t in said] == [0.1, 0.0] and [m["role"] for m in said[0][0]] == ["system", "user"] and "a.md" in said[0][0][1]["content"]
    with pytest.raises(CodegenError, match="empty"):
        Engine(spark, settings, chat=lambda m: " ``` ``` ").run("loop gain", 1)
    with pytest.raises(CodegenError, match="no chat client"):
        Engine(spark, settings).run("loop gain", 1, strict=True)

    def down(messages):
        raise ModelError("down")

    with pytest.raises(CodegenError, match="down"):
        Engine(spark, settings, chat=down).run("loop gain", 1)
    assert "'vin'" in Engine(spark, settings, chat=down).run("bandwidth", 1, execute=True)["generated_code"]


def test_batches(spark, settings):
    engine = Engine(spark, settings, chat=lambda m: "pass")
    requests = [{"query": "loop gain", "top_k": 1}, {"query": ""}, {"query": "sfdr", "top_k": 1, "execute": True}, {"query": "spectrum", "top_k": 1}, {"query": "x", "top_k": 21}]
    got = engine.run_batch(requests)
    assert [r["status"] for r in got] == ["generated", "failed", "failed", "generated", "failed"]
    assert got[0]["evidence"][0]["source"].endswith("a.md") and got[3]["evidence"][0]["source"].endswith("b.md")
    assert "not supported" in got[2]["error"] and got[0]["task_id"] != got[3]["task_id"]


def test_health_echoes_settings_but_no_keys(spark, tmp_path):
    env = tmp_path / ".env"
    env.write_text("OPENAI_API_KEY=file\nMODEL_NAME='m'\nRAG_SSH_PORT=2200\n")
    s = Settings.load(spark, str(env), {"OPENAI_API_KEY": "environment", "RAG_SSH_USER": "u"})
    assert (s.api_key, s.embedding_key, s.chat_model, s.ssh_port, s.ssh_user) == ("file", "file", "m", 2200, "u")
    assert Settings.load(spark, str(tmp_path / "none"), {}).ssh_port == 22
    row = Engine(spark, Settings(api_key="secret", index_dir=f"file://{tmp_path}/index")).health().first()
    assert row.api_key_set is True and row.rerank_key_set is False and row.latest is None and "secret" not in str(row) and row.execution_mode == "local"


def test_a_new_index_leaves_the_old_one_readable(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index")
    rows = spark.createDataFrame([("c", "s", "t", [1.0, 2.0])], "chunk_id string, source string, text string, embedding array<double>")
    store.save("f", rows, "m", "b")
    old = store.load("f")
    store.save("f", rows.unionAll(rows), "m", "b")
    assert old.count() == 1 and store.load("f").count() == 2 and store.latest() == "f"
    assert store.prune("f") == 1 and store.load("f").count() == 2
    store.save("g", rows.withColumn("more", rows.text), "m", "b")
    assert store.load("g") is None  # other columns than an index has
