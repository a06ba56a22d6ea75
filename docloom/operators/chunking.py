"""Overlapping windows of sections, with stable identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import normalized_block, once, stripped

SIZE, OVERLAP, LEAST_PART, LEAST_CHUNK = 1200, 200, 200, 50
#: Characters that a window advances by at least: behind long titles windows are so short that with the overlap they would
#: advance by next to nothing or never end.
LEAST_STEP = 200


def windows(text: str | Column, size: int | Column = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of the windows of ``size`` characters, each starting ``size - overlap`` (LEAST_STEP at least) after the one before.

    The last window is the first that reaches the end of the text.
    """
    text = F.col(text) if isinstance(text, str) else text
    size = F.lit(size) if isinstance(size, int) else size
    step = F.greatest(size - overlap, F.lit(LEAST_STEP))
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, size))


def chunk_id(path: str | Column, index: str | Column) -> Column:
    """Twelve hexadecimal digits of the md5 of ``path:index``."""
    return F.substring(F.md5(F.concat(F.col(path) if isinstance(path, str) else path, F.lit(":"), F.col(index) if isinstance(index, str) else index)), 1, 12)


def chunk_sections(sections: DataFrame, key: str = "doc_id", source: str | None = None, strip_pieces: bool = True) -> DataFrame:
    """(chunk_id, source, key, idx, text): windows of each section behind its title, numbered within their document.

    Windows that are blank are not numbered; chunks under LEAST_CHUNK characters are dropped after numbering, so numbers
    have gaps. ``source``: column of the document's path, by default the key. ``strip_pieces``: whether a window's white
    space is stripped before the title is put before it, not only at the chunk's ends.
    """
    prefix = F.when(F.col("title") != "", F.concat(F.lit("Section: "), "title", F.lit("\n"))).otherwise("")
    rows = sections.select(F.col(key), F.col(source or key).cast("string").alias("source"), "sec_ord", "title", "body")
    rows = once(rows, body=normalized_block("body"), prefix=prefix).filter("body != ''")
    part = F.greatest(F.lit(LEAST_PART), F.lit(SIZE) - F.length("prefix"))
    rows = rows.select(key, "source", "sec_ord", "prefix", F.posexplode(windows("body", part)).alias("part", "piece"))
    rows = once(rows, text=stripped(F.concat("prefix", stripped("piece") if strip_pieces else F.col("piece")))).select(key, "source", "sec_ord", "part", "text").filter("text != ''")
    order = Window.partitionBy(key).orderBy("sec_ord", "part")
    rows = rows.withColumn("idx", F.row_number().over(order) - 1).filter(F.length("text") >= LEAST_CHUNK)
    return rows.select(chunk_id("source", "idx").alias("chunk_id"), "source", key, "idx", "text")
