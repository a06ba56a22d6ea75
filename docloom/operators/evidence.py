"""Evidence items and response parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import head

SNIPPET, PROMPT_SNIPPET, PROMPT_ITEMS = 180, 400, 4


def evidence(hits: DataFrame, source: str = "source", score: str = "score", text: str = "text") -> DataFrame:
    """``hits`` with source, score of four decimals, and snippet."""
    return hits.withColumns({"source": F.col(source).cast("string"), "score": F.round(score, 4), "snippet": head(text, SNIPPET)})


def prompt_context(hits: DataFrame, query: str = "query", rank: str = "rank", source: str = "source", text: str = "text", snippets: bool = True) -> DataFrame:
    """(query, context): the first items of each query as lines, with long snippets or as one line each."""
    src = F.col(source).cast("string")
    if snippets:
        line = F.concat(F.lit("- source: "), src, F.lit("\n  snippet: "), head(text, PROMPT_SNIPPET))
    else:
        line = F.concat(F.lit("- "), src, F.lit(": "), head(text, SNIPPET))
    rows = hits.filter(F.col(rank) <= PROMPT_ITEMS).select(F.col(query).alias("query"), F.struct(F.col(rank).alias("r"), line.alias("line")).alias("x"))
    return rows.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.line), "\n").alias("context"))


def responses(hits: DataFrame, status: str = "generated", query: str = "query") -> DataFrame:
    """(query, status, evidence, error): one response per query; evidence in the order of rank, no error as null."""
    item = F.struct("rank", F.struct("source", "score", "snippet").alias("item"))
    rows = hits.groupBy(F.col(query).alias("query")).agg(F.array_sort(F.collect_list(item)).alias("e"))
    return rows.select("query", F.lit(status).alias("status"), F.transform("e", lambda x: x.item).alias("evidence"), F.nullif(F.lit(""), F.lit("")).alias("error"))
