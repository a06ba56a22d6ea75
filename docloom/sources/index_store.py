"""A store of indexes: Parquet tables by fingerprint, one row of metadata each, and a pointer to the latest.

Each save writes the table and its metadata to a new folder; then the fingerprint's pointer, CURRENT, and the store's,
LATEST, are renamed into place. So a reader sees the old index or the new one, and one that is being read stays; ``prune``
removes folders that no pointer names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.vectors import index_report, validate, verdict

#: Columns of an index; there may also be ``ord``, the order of chunks.
FIELDS = ["chunk_id", "source", "text", "embedding"]


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _pointer(self, path: str) -> str | None:
        if not self._exists(path):
            return None
        row = self.spark.read.text(path).first()
        return row.value.strip() if row else None

    def _point(self, path: str, value: str) -> None:
        """Write a pointer beside its place and rename it over the old one."""
        jvm = self.spark.sparkContext._jvm
        fs, target = self._fs(path)
        _, new = self._fs(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(value.encode()))
        out.close()
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(files.makeQualified(new), files.makeQualified(target), over)

    def path(self, fingerprint: str) -> str | None:
        """The folder of the fingerprint's index, or None."""
        version = self._pointer(f"{self.root}/{fingerprint}/CURRENT")
        return version and f"{self.root}/{fingerprint}/{version}"

    def save(self, fingerprint: str, chunks: DataFrame, model: str, base: str) -> str:
        """Write chunks with their vectors, validate what was written, then commit metadata and pointers."""
        version = uuid.uuid4().hex
        path = f"{self.root}/{fingerprint}/{version}"
        chunks.write.parquet(f"{path}/chunks")
        written = self.spark.read.parquet(f"{path}/chunks")
        validate(written)
        self.metadata(written, fingerprint, model, base).coalesce(1).write.json(f"{path}/metadata")
        self._point(f"{self.root}/{fingerprint}/CURRENT", version)
        self._point(f"{self.root}/LATEST", fingerprint)
        return path

    def prune(self, fingerprint: str) -> int:
        """Remove the folders of a fingerprint that aren't current; how many there were. For when nothing reads them."""
        current = self._pointer(f"{self.root}/{fingerprint}/CURRENT")
        fs, folder = self._fs(f"{self.root}/{fingerprint}")
        old = [f.getPath() for f in fs.listStatus(folder) if f.isDirectory() and f.getPath().getName() != current] if fs.exists(folder) else []
        for path in old:
            fs.delete(path, True)
        return len(old)

    @staticmethod
    def metadata(chunks: DataFrame, fingerprint: str, model: str, base: str) -> DataFrame:
        """One row: fingerprint, chunk_count, vector_dim, embedding_model, embedding_api_base, created_at."""
        return chunks.agg(F.count(F.lit(1)).alias("chunk_count"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("vector_dim")).select(
            F.lit(fingerprint).alias("fingerprint"), "chunk_count", "vector_dim", F.lit(model).alias("embedding_model"),
            F.lit(base).alias("embedding_api_base"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
        )

    def load(self, fingerprint: str, model: str | None = None, base: str | None = None) -> DataFrame | None:
        """The index's chunks; None if there is none, it is invalid, or it is of another model or service."""
        path = self.path(fingerprint)
        if path is None or not self._exists(f"{path}/metadata"):
            return None
        meta = self.spark.read.json(f"{path}/metadata").first()
        if meta is None or (model is not None and meta.embedding_model != model) or (base is not None and meta.embedding_api_base != base):
            return None
        chunks = self.spark.read.parquet(f"{path}/chunks")
        if set(chunks.columns) - {"ord"} != set(FIELDS) or verdict(index_report(chunks)).first().error:
            return None
        return chunks

    def latest(self) -> str | None:
        return self._pointer(f"{self.root}/LATEST")

    def load_or_build(self, fingerprint: str, build: Callable[[], DataFrame], model: str, base: str, force: bool = False) -> DataFrame:
        """The stored index, or the one that ``build`` makes, written and read again."""
        found = None if force else self.load(fingerprint, model, base)
        if found is None:
            self.save(fingerprint, build(), model, base)
            found = self.spark.read.parquet(f"{self.path(fingerprint)}/chunks")
        return found
