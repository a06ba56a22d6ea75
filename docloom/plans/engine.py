"""The engine: index a folder, answer requests with evidence, alone or in batches."""

from __future__ import annotations

import inspect
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import stripped
from docloom.operators import evidence as ev
from docloom.operators import lexical, rerank, taskspec
from docloom.operators.chunking import chunk_sections
from docloom.operators.sections import dispatched_sections
from docloom.operators.vectors import index_report, vector_top
from docloom.sources import documents
from docloom.sources.clients import HashingEmbedder, ModelError, embedded, model_failure
from docloom.sources.config import Settings
from docloom.sources.index_store import IndexStore
from docloom.sources.scratch import materialize


def new_task_id() -> str:
    return "task_" + uuid.uuid4().hex[:10]


def chunk_documents(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(chunk_id, source, idx, text, ord) of decoded documents; ``ord`` sorts chunks in the order of reading."""
    chunks = chunk_sections(dispatched_sections(docs, path, path, text), path).select("chunk_id", "source", "idx", "text")
    return chunks.withColumn("ord", documents.chunk_order("source", "idx"))


class CodegenError(RuntimeError):
    """No script for a request."""


@dataclass
class Answer:
    """What a request got: rows of (query, chunk, source, score, rank, snippet), and warnings."""

    hits: DataFrame
    warnings: list[str] = field(default_factory=list)


#: Chunks that a reranker is given all of when embedding fails; of more, it is given each query's lexical candidates.
ALL_RERANKED = 1_000
#: Characters of a request's log.
LOG = 4_000


@dataclass
class Engine:
    """``embedder`` makes a client with embed(model, texts) inside tasks; ``reranker``, if given, is called inside tasks with
    (query, texts, top_n) and returns the JSON of a rerank response; ``chat`` is called on the driver, once for each
    request, with messages, and with their temperature if it takes two arguments."""

    spark: SparkSession
    settings: Settings
    embedder: Callable[[], object] = HashingEmbedder
    reranker: Callable[[str, list[str], int], str] | None = None
    chat: Callable[..., str] | None = None

    @property
    def store(self) -> IndexStore:
        return IndexStore(self.spark, self.settings.index_dir)

    def chunks(self) -> DataFrame:
        return chunk_documents(documents.read_documents(self.spark, self.settings.resource_dir))

    def index(self, force: bool = False) -> DataFrame:
        """The stored index of the folder's documents, built if there is none for their fingerprint."""
        files = documents.scan(self.spark, self.settings.resource_dir)
        fingerprint = documents.fingerprint(files).first().fingerprint
        s = self.settings

        def build() -> DataFrame:
            chunks = self.chunks().select("chunk_id", "source", "text", "ord")
            return embedded(chunks, self.embedder, s.embedding_model, "text", s.batch_size, s.attempts, s.retry_delay)

        return self.store.load_or_build(fingerprint, build, s.embedding_model, s.embedding_base, force)

    def reindex(self) -> DataFrame:
        """Rebuild the index; one row of counts. Raises if there are no documents, chunks or vectors."""
        if documents.scan(self.spark, self.settings.resource_dir).isEmpty():
            raise ValueError("no documents")
        return index_report(self.index(force=True))

    def health(self) -> DataFrame:
        """One row of all settings, of keys only whether they are set, and the latest index."""
        row = {"status": "ok", **self.settings.echo(), "latest": self.store.latest()}
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in row.items()))

    def _near(self, queries: DataFrame, budget: int) -> DataFrame:
        """(query, ord, rank, chunk, source, text): candidates by vector search."""
        s = self.settings
        index = self.index()
        index = index if "ord" in index.columns else index.withColumn("ord", F.col("chunk_id"))
        asked = embedded(queries, self.embedder, s.embedding_model, "query_text", s.batch_size, s.attempts, s.retry_delay)
        near = vector_top(asked, index, budget, "query", "ord")
        near = materialize(near.join(index.select("ord", F.col("chunk_id").alias("chunk"), "source", "text"), "ord").drop("score"), "near")
        if near.isEmpty():
            raise ModelError("embedding retrieval returned no hits")
        return near

    def _for_reranking(self, queries: DataFrame, near: DataFrame | None, chunks: DataFrame | None, budget: int) -> DataFrame:
        """(query, ord, chunk, source, text): candidates numbered from 0."""
        if near is not None:
            return near.select("query", (F.col("rank") - 1).cast("long").alias("ord"), "chunk", "source", "text")
        texts = chunks.select(F.col("ord").alias("at"), F.col("chunk_id").alias("chunk"), "source", "text")
        if chunks.count() <= ALL_RERANKED:
            every = texts.withColumn("ord", (F.row_number().over(Window.orderBy("at")) - 1).cast("long")).drop("at")
            return queries.select("query").join(F.broadcast(every))
        found = lexical.broad_top(queries, chunks, budget, chunk="ord").select("query", F.col("chunk").alias("at"), (F.col("r") - 1).cast("long").alias("ord"))
        return found.join(texts, "at").drop("at")

    def retrieve(self, queries: DataFrame, top_k: int = 6) -> Answer:
        """The best chunks of each row of ``queries`` (query long, query_text string), in one plan for all.

        Vector search proposes candidates; if it fails, all chunks are candidates. The reranker orders them; where it
        fails or is off, they are ordered lexically, with statistics of each query's candidates. Only failures of models
        fall back, and each is told in the warnings; other errors are raised. Ties go by the order of chunks.
        """
        warnings: list[str] = []
        s = self.settings
        budget = rerank.rerank_budget(top_k, s.rerank_factor)
        near = chunks = None
        try:
            near = self._near(queries, budget)
        except Exception as e:  # a task's error comes wrapped by Spark
            said = model_failure(e)
            if said is None:
                raise
            warnings.append(f"embedding retrieval unavailable: {said}; using lexical fallback")
            chunks = materialize(self.chunks(), "chunks")
        hits, left = [], queries
        if self.reranker is not None and s.rerank_enabled:
            candidates = self._for_reranking(queries, near, chunks, budget)
            items = materialize(rerank.called(candidates, queries, self.reranker, budget), "reranked")
            failed = items.filter("error IS NOT NULL")
            for row in failed.groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error").limit(20).collect():
                warnings.append(f"rerank unavailable for {row.n} of the queries: {row.error}; using lexical rerank fallback")
            good = rerank.resolved(items.filter("error IS NULL").drop("error"), candidates, top_k, budget)
            hits.append(good.select("query", "chunk", "source", "text", "score", "rank"))
            left = queries.join(failed.select("query"), "query", "left_semi")
        if near is not None:
            top = lexical.lexical_within(left, near.select("query", F.col("ord").alias("chunk"), "text"), top_k).withColumnRenamed("chunk", "ord")
            top = top.join(near.select("query", "ord", "chunk", "source", "text"), ["query", "ord"])
        else:
            top = lexical.lexical_top(left, chunks, top_k, chunk="ord").withColumnRenamed("chunk", "ord")
            top = top.join(chunks.select("ord", F.col("chunk_id").alias("chunk"), "source", "text"), "ord")
        hits.append(top.select("query", "chunk", "source", "text", "score", "rank"))
        out = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
        return Answer(ev.evidence(materialize(out, "hits")), warnings)

    def _said(self, system: str, user: str, temperature: float) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        try:
            takes = len(inspect.signature(self.chat).parameters)
        except (TypeError, ValueError):
            takes = 1
        return self.chat(messages, temperature) if takes > 1 else self.chat(messages)

    def _script(self, query: str, circuit: str, kind: str, hits: DataFrame, execute: bool, strict: bool) -> str:
        """The script of a request. Without ``strict`` a missing chat client gives defaults, or an empty script."""
        if self.chat is None and strict:
            raise CodegenError("code generation failed: no chat client")
        if execute and kind != "opamp_bandwidth":
            raise (CodegenError if strict else ValueError)(f"execution is not supported for {kind}")
        plan, metric, method = taskspec.PLANS[kind]
        if execute:
            text = ""
            if self.chat is not None:
                context = ev.prompt_context(hits, snippets=False).first().context
                try:
                    text = self._said(taskspec.PARAMETER_PROMPT, taskspec.parameter_request(query, circuit, context), 0.0)
                except Exception:  # whatever the service does, unread parameters are the defaults
                    text = ""
            said = self.spark.createDataFrame([(text,)], "t string")
            parameters = said.select(*[c.alias(k) for k, c in taskspec.sweep_parameters("t").items()]).first().asDict()
            sources = [r.source for r in hits.filter(F.col("rank") <= ev.PROMPT_ITEMS).orderBy("rank").select("source").collect()]
            return taskspec.sweep_script(parameters, sources)
        if self.chat is None:
            return ""
        context = ev.prompt_context(hits).first().context
        try:
            text = self._said(taskspec.SCRIPT_PROMPT, taskspec.script_request(query, circuit, kind, metric, method, plan, context), 0.1)
        except Exception as e:  # likewise
            raise CodegenError(f"code generation failed: {e}") from e
        code = self.spark.createDataFrame([(text,)], "t string").select(stripped(taskspec.without_fence("t"))).first()[0]
        if not code:
            raise CodegenError("code generation failed: the answer is empty")
        return code

    def _response(self, answer: Answer, number: int, query: str, circuit: str, execute: bool, strict: bool) -> dict:
        own = answer.hits.filter(F.col("query") == number)
        hits = own.orderBy("rank").collect()
        if not hits:
            raise ValueError("no evidence")
        kind = self.spark.createDataFrame([(query,)], "q string").select(taskspec.test_type("q").alias("k")).first().k
        code = self._script(query, circuit, kind, own, execute, strict)
        task = new_task_id()
        folder = os.path.join(self.settings.work_dir, task)
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, "main.py"), "w", encoding="utf-8") as f:
            f.write(code)
        items = [{"source": h.source, "score": h.score, "snippet": h.snippet} for h in hits]
        logs = {"stdout": "", "stderr": "\n".join(answer.warnings)[-LOG:]}
        return {"task_id": task, "status": "generated", "generated_code": code, "metrics": {}, "logs": logs, "evidence": items, "error": None}

    def run(self, query: str, top_k: int = 6, circuit: str = "", execute: bool = False, strict: bool = False) -> dict:
        """One request: evidence, and a script from a chat client's answer, or with ``execute`` from the parameters in it.

        The script is written to the task's folder on the driver; generated code is never run. With ``strict`` a missing
        chat client is an error.
        """
        if not query or not 1 <= top_k <= 20:
            raise ValueError("query is required and top_k must be between 1 and 20")
        asked = self.spark.createDataFrame([(0, query)], "query long, query_text string")
        return self._response(self.retrieve(asked, top_k), 0, query, circuit, execute, strict)

    def run_batch(self, requests: list[dict], strict: bool = True) -> list[dict]:
        """Responses to requests (keys query, top_k, circuit, execute) in their order; evidence comes from one plan for each
        ``top_k``. A request that fails has the status ``failed`` and its error."""
        out: list[dict | None] = [None] * len(requests)

        def failed(error: str) -> dict:
            return {"task_id": None, "status": "failed", "generated_code": "", "metrics": {}, "logs": {"stdout": "", "stderr": error[-LOG:]}, "evidence": [], "error": error}

        by_k: dict[int, list[int]] = {}
        for i, r in enumerate(requests):
            k = r.get("top_k", 6)
            if not r.get("query") or not isinstance(k, int) or not 1 <= k <= 20:
                out[i] = failed("query is required and top_k must be between 1 and 20")
            else:
                by_k.setdefault(k, []).append(i)
        for k, numbers in by_k.items():
            asked = self.spark.createDataFrame([(i, requests[i]["query"]) for i in numbers], "query long, query_text string")
            answer = self.retrieve(asked, k)
            for i in numbers:
                r = requests[i]
                try:
                    out[i] = self._response(answer, i, r["query"], r.get("circuit") or "", bool(r.get("execute")), strict)
                except (CodegenError, ValueError) as e:
                    out[i] = failed(str(e))
        return out
