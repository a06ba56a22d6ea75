"""Column functions over text: normalisation, tokens, lists and cuts. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Unicode text has it, for Java's regular expressions, whose ``\\s`` is ASCII only.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same characters.
SPACES = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Fixed value: what a token is.
TOKEN = r"[a-zA-Z_]{2,}|[\u4e00-\u9fff]+"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(x: str | Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(_col(x), F.lit(SPACES))


def normalized_block(x: str | Column) -> Column:
    """Line ends as LF, runs of blanks as one, at most one empty line in a row, stripped."""
    lines = F.regexp_replace(_col(x), r"\r\n?", "\n")
    blanks = F.regexp_replace(lines, r"[ \t\f\x0b]{2,}|[\t\f\x0b]", " ")
    return stripped(F.regexp_replace(blanks, r"\n{3,}", "\n\n"))


def normalized_inline(x: str | Column) -> Column:
    """Every run of white space as one space, stripped."""
    return stripped(F.regexp_replace(_col(x), rf"[{SPACE}]+", " "))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once for each row, however often they are used behind this.

    Filters and projections that use them aren't pushed through the generator, which would repeat the expressions.
    """
    made = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_once")
    kept = [f"`{c}`" for c in rows.columns if c not in columns]
    return rows.select(*kept, made).select(*kept, *[F.col("_once")[k].alias(k) for k in columns])


def decoded(content: str | Column) -> Column:
    """Bytes as text: UTF-8, undecodable bytes dropped, line ends as LF; a byte order mark stays."""
    text = F.replace(F.make_valid_utf8(_col(content).cast("string")), F.lit("\ufffd"), F.lit(""))
    return F.regexp_replace(text, r"\r\n?", "\n")


def token_list(x: str | Column) -> Column:
    """Runs of two or more ASCII letters or underscores, and runs of Chinese characters, of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_col(x)), F.lit(TOKEN), F.lit(0))


def csv_list(x: str | Column, default: list[str]) -> Column:
    """Comma-separated items, stripped, blank ones dropped; ``default`` if none are left."""
    items = cleaned(F.split(F.coalesce(_col(x), F.lit("")), ","))
    return F.when(F.size(items) > 0, items).otherwise(F.array(*[F.lit(d) for d in default]).cast("array<string>"))


def cleaned(x: str | Column) -> Column:
    """Items of an array stripped, blank ones dropped."""
    return F.filter(F.transform(_col(x), stripped), lambda v: v != "")


def brief(x: str | Column, length: int = 280) -> Column:
    """The text, cut with an ellipsis beyond ``length`` characters."""
    return F.when(F.length(x) > length, F.concat(F.left(x, F.lit(length)), F.lit("..."))).otherwise(_col(x))


def brief_dump(*columns: str, length: int = 280) -> Column:
    """The columns as a JSON object, cut like ``brief``."""
    return brief(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), length)


def tail(x: str | Column, length: int = 4000) -> Column:
    """The last ``length`` characters."""
    return F.right(x, F.lit(length))


def head(x: str | Column, length: int) -> Column:
    """The first ``length`` characters."""
    return F.substring(_col(x), 1, length)
