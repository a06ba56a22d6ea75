"""Reranking: budgets, response parsing and positional resolution."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rerank_budget(top_k: Column | int, factor: int = 4):
    """Candidates that a reranker is given."""
    factor = max(1, factor)
    return max(20, top_k * factor) if isinstance(top_k, int) else F.greatest(F.lit(20), top_k * factor)


def parsed_response(responses: DataFrame, query: str = "query", body: str = "body") -> DataFrame:
    """(query, ord, index, score) of the items of rerank responses.

    Items are under ``results``, else ``data``; the index is ``index`` or ``document_index``, the score
    ``relevance_score`` or ``score``.
    """
    item = "array<struct<index:bigint,document_index:bigint,relevance_score:double,score:double>>"
    got = F.from_json(body, f"struct<results:{item},data:{item}>")
    rows = responses.select(F.col(query).alias("query"), got.alias("r")).select("query", F.posexplode(F.coalesce("r.results", "r.data")).alias("ord", "i"))
    return rows.select("query", "ord", F.coalesce("i.index", "i.document_index").alias("index"), F.coalesce("i.relevance_score", "i.score").alias("score"))


def strict_items(body: str, top_n: int) -> list[tuple[int, int, float]]:
    """(ord, index, score) of a rerank response's first ``top_n`` items by score; ValueError if any item is malformed."""
    data = json.loads(body)
    lists = [data.get(k) for k in ("results", "data")] if isinstance(data, dict) else []
    items = next((x for x in lists if isinstance(x, list) and x), None)
    if items is None:
        raise ValueError("rerank response has no list of items")
    out = []
    for n, item in enumerate(items):
        if not isinstance(item, dict):
            raise ValueError(f"rerank item {n} is not an object")
        index, score = item.get("index", item.get("document_index")), item.get("relevance_score", item.get("score"))
        if not isinstance(index, int):
            raise ValueError(f"rerank item {n} has no integer index")
        if not isinstance(score, (int, float)):
            raise ValueError(f"rerank item {n} has no numeric score")
        out.append((n, index, float(score)))
    return sorted(out, key=lambda x: -x[2])[: max(1, top_n)]


def called(candidates: DataFrame, queries: DataFrame, reranker: Callable[[str, list[str], int], str], budget: int) -> DataFrame:
    """(query, ord, index, score, error): what ``reranker`` says of each query's candidates, called inside tasks.

    ``candidates``: (query, ord, text); ``queries``: (query, query_text). A call that fails, a malformed response and one
    without an index in range give one row with an error. Write the result before it is used twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, text, texts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                texts = [t["text"] for t in texts]
                top_n = min(len(texts), budget)
                try:
                    items = strict_items(reranker(text, texts, top_n), top_n)
                    if not any(0 <= i < len(texts) for _, i, _ in items):
                        raise ValueError("rerank returned no usable entries")
                    out += [(query, *item, None) for item in items]
                except Exception as e:  # whatever the service does is its failure
                    out.append((query, None, None, None, str(e) or type(e).__name__))
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.string()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["query", "ord", "index", "score", "error"])

    texts = candidates.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("texts"))
    rows = queries.select(F.col("query").cast("long").alias("query"), "query_text").join(texts, "query")
    return rows.mapInArrow(run, "query long, ord int, index long, score double, error string")


def resolved(items: DataFrame, candidates: DataFrame, top_k: int, budget: int) -> DataFrame:
    """(query, rank, *candidate columns, score): items in order of score, looked up by position among the candidates.

    ``candidates``: (query, ord, ...). The first min(candidates, budget) items count; of these, indexes out of range are
    dropped and repeated ones kept; then the first ``top_k``.
    """
    counts = candidates.groupBy("query").agg(F.least(F.count(F.lit(1)), F.lit(budget)).alias("top_n"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "ord")
    best = items.withColumn("r", F.row_number().over(w)).join(counts, "query").filter(F.col("r") <= F.greatest(F.lit(1), F.col("top_n")))
    best = best.select("query", "r", "score", F.col("index").alias("ord"))
    rows = best.join(candidates.drop("score"), ["query", "ord"])
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("r"))).filter(F.col("rank") <= top_k)
    return rows.drop("r")
