"""Engine settings, read per session from a settings file and a mapping (by default the environment)."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

from docloom.sources.documents import read_settings


@dataclass(frozen=True)
class Settings:
    """Folders, models, reranking and how scripts would be run. Keys fall back as described at ``from_mapping``."""

    resource_dir: str = "Resource"
    work_dir: str = "./workdir"
    index_dir: str = "./workdir/vector_index"
    api_base: str = ""
    api_key: str = ""
    chat_model: str = ""
    embedding_base: str = ""
    embedding_key: str = ""
    embedding_model: str = ""
    batch_size: int = 10
    attempts: int = 4
    retry_delay: float = 1.0
    rerank_enabled: bool = True
    rerank_model: str = ""
    rerank_base: str = ""
    rerank_key: str = ""
    rerank_factor: int = 4
    vision_model: str = ""
    execution_mode: str = "local"
    local_bashrc: str = "~/.bashrc"
    remote_bashrc: str = "~/.bashrc"
    required_commands: str = "python"
    required_modules: str = ""
    ssh_host: str = "127.0.0.1"
    ssh_user: str = ""
    ssh_port: int = 22
    ssh_key_path: str = ""
    remote_work_dir: str = ""

    @classmethod
    def from_mapping(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Embedding keys fall back to the general key; reranking's base and key to those of embedding."""
        env = os.environ if env is None else env
        get = lambda key, default="": env.get(key, default)
        key = get("OPENAI_API_KEY")
        base, embedding_key = get("EMBEDDING_API_BASE"), get("EMBEDDING_API_KEY") or key
        return cls(
            get("RAG_RESOURCE_DIR", "Resource"), get("RAG_WORK_DIR", "./workdir"), get("RAG_VECTOR_INDEX_DIR", "./workdir/vector_index"),
            get("OPENAI_API_BASE"), key, get("MODEL_NAME"), base, embedding_key, get("EMBEDDING_MODEL_TEXT"),
            int(get("EMBEDDING_BATCH_SIZE", "10")), int(get("EMBEDDING_RETRY_COUNT", "4")), float(get("EMBEDDING_RETRY_DELAY_SEC", "1.0")),
            get("RERANK_ENABLED", "true").strip().lower() in ("1", "true", "yes", "on"), get("RERANK_MODEL_TEXT"),
            get("RERANK_API_BASE") or base, get("RERANK_API_KEY") or embedding_key, int(get("RERANK_TOPN_FACTOR", "4")),
            get("EMBEDDING_MODEL_VISION"), get("RAG_EXECUTION_MODE", "local"), get("RAG_LOCAL_BASHRC", "~/.bashrc"), get("RAG_REMOTE_BASHRC", "~/.bashrc"),
            get("RAG_TED_REQUIRED_COMMANDS", "python"), get("RAG_TED_REQUIRED_PY_MODULES"), get("RAG_SSH_HOST", "127.0.0.1"), get("RAG_SSH_USER"),
            int(get("RAG_SSH_PORT", "22")), get("RAG_SSH_KEY_PATH"), get("RAG_REMOTE_WORK_DIR"),
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str = ".env", env: Mapping[str, str] | None = None) -> Settings:
        """``from_mapping`` with the lines of a settings file over ``env``; no file, no change."""
        env = dict(os.environ if env is None else env)
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if ":" in path else f"file://{os.path.abspath(path)}")
        if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
            env |= read_settings(spark, there.toString())
        return cls.from_mapping(env)

    def echo(self) -> dict[str, str | bool]:
        """All settings, of keys only whether they are set."""
        secret = lambda k: k.endswith("_key")
        return {f"{k}_set" if secret(k) else k: bool(v) if secret(k) or isinstance(v, bool) else str(v) for k, v in vars(self).items()}
