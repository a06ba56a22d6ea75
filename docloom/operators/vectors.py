"""Exact vector search and checks of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.lexical import ranked
from docloom.operators.running import RunningTop

#: Queries that are held by a task at once.
QUERY_BLOCK = 2048


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def norm(x: str | Column) -> Column:
    return F.sqrt(_sum(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine; the product over the shorter length, norms over all; 0 if a norm is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    n = F.least(F.size(a), F.size(b))
    dot = _sum(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")))
    length = norm(a) * norm(b)
    return F.when(length == 0, 0.0).otherwise(dot / length)


def vector_top(queries: DataFrame, vectors: DataFrame, k: int, query: str = "query", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, score, rank): each query's ``k`` most similar rows of ``vectors``; ties by key.

    Queries (columns ``query`` and ``vector``) come in blocks of QUERY_BLOCK; a task keeps each query's best ``k`` while
    its rows go by, so no pair beyond these leaves it. Scores are rounded to six decimals before ranking. Queries whose
    vector is null have no rows. Keys are integers or strings.
    """
    wanted = queries.filter(F.col(vector).isNotNull()).select(F.col(query).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    out, block = None, []
    kind = "string" if vectors.schema[key].dataType.simpleString() == "string" else "long"
    held_kind = pa.string() if kind == "string" else pa.int64()

    def found(rows: list) -> DataFrame:
        ids = np.array([r.q for r in rows], np.int64)
        width = max(len(r.v) for r in rows)
        table = np.zeros((len(rows), width))
        for to, r in zip(table, rows, strict=True):
            to[: len(r.v)] = r.v
        held = vectors.sparkSession.sparkContext.broadcast((ids, table))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, table = held.value
            lengths, top = np.sqrt((table * table).sum(axis=1)), RunningTop(len(ids), k)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    keys = part.column(0).to_pylist()
                    lists = part.column(1)
                    size = np.diff(lists.offsets.to_numpy())
                    x = np.zeros((len(keys), max(table.shape[1], int(size.max(initial=0)))))
                    x[np.arange(x.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                    norms = np.sqrt((x * x).sum(axis=1))
                    score = x[:, : table.shape[1]] @ table.T
                    length = norms[:, None] * lengths
                    score = np.where(length == 0, 0.0, score / np.where(length == 0, 1.0, length)).round(6)
                    top.add(score, keys)
            q, keys, scores = top.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(q, np.int64)], pa.int64()), pa.array(keys, held_kind), pa.array(scores, pa.float64())], names=["query", "key", "score"])

        rows_ = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast(kind).alias("key"), F.col(vector).cast("array<double>").alias("v"))
        return rows_.mapInArrow(run, f"query long, key {kind}, score double")

    for row in wanted.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            out, block = found(block) if out is None else out.unionAll(found(block)), []
    if block:
        out = found(block) if out is None else out.unionAll(found(block))
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"query long, key {kind}, score double, rank int").withColumnRenamed("key", key)
    return ranked(out, "query", "score", "key", k).withColumnRenamed("key", key)


def index_report(chunks: DataFrame, vector: str = "embedding", source: str = "source") -> DataFrame:
    """One row (docs, chunks, vectors, min_dim, max_dim, non_numeric): what validation of an index looks at."""
    bad = F.exists(vector, lambda v: v.isNull())
    return chunks.agg(
        F.count_distinct(source).alias("docs"),
        F.count(F.lit(1)).alias("chunks"),
        F.count(vector).alias("vectors"),
        F.coalesce(F.min(F.size(vector)), F.lit(0)).cast("long").alias("min_dim"),
        F.coalesce(F.max(F.size(vector)), F.lit(0)).cast("long").alias("max_dim"),
        F.count_if(F.coalesce(bad, F.lit(False))).alias("non_numeric"),
    )


def verdict(report: DataFrame) -> DataFrame:
    """``report`` with the first thing that is wrong, or '' (column ``error``)."""
    error = (
        F.when(F.col("vectors") == 0, "vector index is empty")
        .when(F.col("vectors") != F.col("chunks"), "numbers of vectors and chunks differ")
        .when(F.col("min_dim") <= 0, "a vector is empty")
        .when(F.col("non_numeric") > 0, "a vector has a value that is not a number")
        .when(F.col("min_dim") != F.col("max_dim"), "vectors differ in dimension")
        .otherwise("")
    )
    return report.withColumn("error", error)


def validate(chunks: DataFrame, vector: str = "embedding", source: str = "source") -> None:
    """Raise ValueError with the first thing that is wrong with an index."""
    error = verdict(index_report(chunks, vector, source)).first().error
    if error:
        raise ValueError(error)
