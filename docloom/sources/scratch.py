"""Tables that are written to the shared folder to be read several times.

Inside ``scratch_scope`` they are deleted at the scope's end, but for those that a kept DataFrame reads.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The paths of each open scope, by thread.
_scopes = threading.local()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; a temporary one only in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_dir(spark)}/docloom-{uuid.uuid4().hex}-{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, computed once.

    The shuffle files of the write are removed once it has ended, as nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Yields ``keep``; tables written inside are deleted at the end unless a kept DataFrame reads them.

    Kept tables belong to the scope around, if there is one. Nothing else that was made inside may be used afterwards.
    """
    _scopes.open = getattr(_scopes, "open", [])
    _scopes.open.append([])
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(file.rsplit("/", 1)[0].rsplit("/", 1)[-1] for file in df.inputFiles())
        return df

    try:
        yield keep
    finally:
        paths = _scopes.open.pop()
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            if path.rsplit("/", 1)[-1] in kept:
                if _scopes.open:
                    _scopes.open[-1].append(path)
            else:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(conf).delete(target, True)
