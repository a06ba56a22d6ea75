"""Titled sections of Markdown and plain text, as window expressions over lines.

A heading of level L stays in force until the next heading of a level up to L. So the title at level L is that of the
last heading seen with a level of at most L, if its level is L: a window per level replaces a stack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import normalized_block, once

HEADING = r"(?s)^(#{1,6})\s+(.+?)\s*\z"
LEVELS = range(1, 7)


def text_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sec_ord, title, body): sections with a body, numbered from 0 in their order.

    A text without any body line is one untitled section of itself; an empty text has none. Texts without a heading
    are one section as they are and need no shuffle; only the others' lines are windowed.
    """

    def blocks(rows: DataFrame) -> DataFrame:
        rows = once(rows.select(F.col(key).alias("key"), F.col(text).alias("text")), whole=normalized_block(F.coalesce("text", F.lit(""))))
        return once(rows.drop("text"), headed=F.regexp_like("whole", F.lit(r"(?m)^#{1,6}\s+\S"))).filter("whole != ''")

    plain = blocks(docs).filter("NOT headed").select(F.col("key").alias(key), F.lit(0).alias("sec_ord"), F.lit("").alias("title"), F.col("whole").alias("body"))
    # Texts without a # are left out before anything is computed.
    headed = blocks(docs.filter(F.contains(text, F.lit("#")))).filter("headed").select("key", "whole")
    return plain.unionByName(_headed_sections(headed).withColumnRenamed("key", key))


def _headed_sections(whole: DataFrame) -> DataFrame:
    """Sections of normalised texts (key, whole), by windows over lines."""
    lines = whole.select("key", "whole", F.posexplode(F.split("whole", "\n")).alias("n", "line"))
    lines = lines.withColumn("level", F.length(F.regexp_extract("line", HEADING, 1)))
    lines = lines.withColumn("heading", F.when(F.col("level") > 0, F.struct("level", F.regexp_extract("line", HEADING, 2).alias("title"))))
    seen = Window.partitionBy("key").orderBy("n")
    last = [F.last(F.when(F.col("level") <= level, F.col("heading")), ignorenulls=True).over(seen) for level in LEVELS]
    titles = F.array(*[F.when(h["level"] == level, h["title"]).otherwise("") for level, h in zip(LEVELS, last, strict=True)])
    lines = lines.select(
        "key", "whole", "n", "line", "level",
        F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(seen).alias("section"),
        F.array_join(F.filter(titles, lambda t: F.coalesce(t, F.lit("")) != ""), " > ").alias("title"),
    )
    body = lines.groupBy("key", "section").agg(
        F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("n", "line")))).alias("rows"),
        F.max("title").alias("title"),
        F.max("whole").alias("whole"),
    )
    body = once(body.drop("body"), body=normalized_block(F.array_join(F.transform("rows", lambda r: r.line), "\n"))).drop("rows")
    per_key = Window.partitionBy("key")
    body = body.withColumn("bodies", F.sum((F.col("body") != "").cast("int")).over(per_key)).filter("body != '' OR bodies = 0")
    body = body.withColumn("sec_ord", F.row_number().over(per_key.orderBy("section")) - 1).filter("bodies > 0 OR sec_ord = 0")
    none = F.col("bodies") == 0
    return body.select(
        "key", "sec_ord", F.when(none, "").otherwise(F.col("title")).alias("title"), F.when(none, F.col("whole")).otherwise(F.col("body")).alias("body")
    )


def dispatched_sections(docs: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """Sections by suffix: HTML where markup yields any, the text path on the raw markup otherwise and for other files."""
    from docloom.operators.html import html_sections

    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    marked = docs.filter(suffix.isin("html", "htm"))
    from_html = html_sections(marked, key, text)
    others = docs.filter(~suffix.isin("html", "htm")).select(key, text)
    unread = marked.select(key, text).join(from_html.select(key).distinct(), key, "left_anti")
    return from_html.select(key, "sec_ord", "title", "body").unionByName(text_sections(others.unionByName(unread), key, text))

