"""Documents of a folder, settings files and result folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import decoded, stripped

# Suffixes that are read, in the order of reading.
SUFFIXES = ["md", "markdown", "html", "htm", "txt"]
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length, content) of the documents under ``root``; none if there is no such folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(root)


def chunk_order(path: str, index: str) -> Column:
    """A string that sorts chunks by their document's suffix, its path, and their number."""
    suffix = F.array_position(F.array(*[F.lit(s) for s in SUFFIXES]), F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.concat(suffix.cast("string"), F.lit("\x01"), path, F.lit("\x01"), F.lpad(F.col(index).cast("string"), 10, "0"))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, doc_ord, text, length, modificationTime): decoded documents; doc_ord sorts by suffix, then path."""
    suffix = F.array_position(F.array(*[F.lit(s) for s in SUFFIXES]), F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = scan(spark, root).select("path", F.struct(suffix.alias("suffix"), "path").alias("doc_ord"), decoded("content").alias("text"), "length", "modificationTime")
    return rows


def fingerprint(files: DataFrame) -> DataFrame:
    """(fingerprint): sha256 over path, size and time of modification of all files in the order of paths.

    Files are digested one by one first, so the collected list holds a digest for each file.
    """
    each = files.select("path", F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256).alias("h"))
    together = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x.h), "")
    return each.agg(F.sha2(together, 256).alias("fingerprint"))


def settings_lines(lines: DataFrame, line: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """(key, value, *keep) of KEY=VALUE lines; blank lines, comments and lines without = are skipped.

    Keys and values are stripped; all double, then all single quotes around a value go.
    """
    rows = lines.select(stripped(line).alias("l"), *keep).filter("l != '' AND NOT startswith(l, '#') AND contains(l, '=')")
    parts = F.split("l", "=", 2)
    value = stripped(parts[1])
    for quote in ('"', "'"):
        value = F.regexp_replace(value, f"^{quote}+|{quote}+$", "")
    return rows.select(stripped(parts[0]).alias("key"), value.alias("value"), *keep)


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """A settings file as a dict; later lines win. Read by the file system, as Spark's readers skip names like ``.env``."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    stream = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(there)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    lines = [(n, x) for n, x in enumerate(text.split("\n"))]
    numbered = spark.createDataFrame(lines, "n int, value string")
    rows = settings_lines(numbered, "value", ["n"]).collect()
    return {r.key: r.value for r in sorted(rows, key=lambda r: r.n)}


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """(task, stdout, stderr, result) of the task folders under ``root``; missing logs are empty, missing results null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{stdout.log,stderr.log,result.json}").load(root)
    rows = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("task"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), decoded("content").alias("text"))
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("text")))
    out = rows.groupBy("task").agg(pick("stdout.log").alias("stdout"), pick("stderr.log").alias("stderr"), pick("result.json").alias("result"))
    return out.fillna("", ["stdout", "stderr"])
