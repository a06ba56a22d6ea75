"""Documents as they arrive in a folder, chunked and appended to a table.

Spark's file source finds new files and remembers them in the query's checkpoint. Each micro-batch is written to a folder
named by its number, which a repeated batch overwrites, so every file is in the table once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docloom.functions.text import decoded
from docloom.plans.engine import chunk_documents
from docloom.sources.documents import SCHEMA, SUFFIXES


def arriving(spark: SparkSession, root: str, files: int = 10_000) -> DataFrame:
    """(path, text) of the documents under ``root``, old and new ones; a micro-batch takes ``files`` at most."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(root).select("path", decoded("content").alias("text"))


def append_chunks(docs: DataFrame, table: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] = chunk_documents, **trigger) -> StreamingQuery:
    """Start a query that writes ``make`` of each micro-batch of ``docs`` to ``table``; read it with ``chunks_in``.

    ``trigger``: as of ``DataStreamWriter.trigger``; by default what has arrived is worked off and the query ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def chunks_in(spark: SparkSession, table: str) -> DataFrame:
    """The chunks that have been appended, with their batch."""
    return spark.read.option("basePath", table).parquet(table)
