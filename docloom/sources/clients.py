"""Model clients: a JSON connector, batched embedding with retries, and an offline embedder.

Clients are made inside tasks, one for each partition, from a factory that is sent to them.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.taskspec import RETRYABLE

#: Characters of a chunk that are embedded; seconds for a call.
EMBEDDED, TIMEOUT = 3000, 120


class ModelError(RuntimeError):
    """A failed call of a model."""


def model_failure(error: BaseException) -> str | None:
    """What a model's failure says, raised here or inside a task; None for any other error."""
    if isinstance(error, ModelError):
        return str(error)
    said = re.findall(r"ModelError: (.*)", str(error))
    return said[-1] if said else None


def brief(value: object, length: int = 280) -> str:
    """A value as JSON, cut with an ellipsis beyond ``length`` characters."""
    text = json.dumps(value, ensure_ascii=False, default=str)
    return text if len(text) <= length else text[:length] + "..."


class JsonClient:
    """GET and POST of JSON with a bearer token; embeddings, chat, rerank and model lists of an OpenAI-like service."""

    def __init__(self, base: str, key: str, opener: Callable = urllib.request.urlopen):
        self.base, self.key, self.opener = base.rstrip("/"), key, opener

    def call(self, path: str, body: dict | None = None) -> dict:
        request = urllib.request.Request(self.base + path, headers={"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
        if body is not None:
            request.data = json.dumps(body, ensure_ascii=False).encode()
        try:
            with self.opener(request, timeout=TIMEOUT) as answer:
                return json.loads(answer.read().decode("utf-8"))
        except urllib.error.HTTPError as e:
            raise ModelError(f"API HTTPError {e.code}: {e.read().decode('utf-8', 'ignore')}") from e
        except urllib.error.URLError as e:
            raise ModelError(f"API URLError: {e.reason}") from e
        except TimeoutError as e:
            raise ModelError("API timed out") from e
        except ValueError as e:
            raise ModelError(f"API answer is not JSON: {e}") from e

    def models(self) -> dict:
        return self.call("/models")

    def embed(self, model: str, texts: list[str]) -> list[list[float]]:
        items = self.call("/embeddings", {"model": model, "input": texts}).get("data")
        if not isinstance(items, list):
            raise ModelError(f"embedding response has no list of data: {brief(items)}")
        out = []
        for item in items:
            vector = item.get("embedding") if isinstance(item, dict) else None
            if not isinstance(vector, list) or not vector or not all(isinstance(v, (int, float)) for v in vector):
                raise ModelError(f"embedding response has an invalid vector: {brief(vector)}")
            out.append([float(v) for v in vector])
        return out

    def chat(self, model: str, messages: list[dict], temperature: float = 0.1) -> str:
        body = {"model": model, "messages": messages, "temperature": temperature, "stream": False}
        return self.call("/chat/completions", body)["choices"][0]["message"]["content"]

    def rerank_body(self, model: str, query: str, documents: list[str], top_n: int) -> str:
        """The response's JSON, for ``rerank.parsed_response``."""
        return json.dumps(self.call("/rerank", {"model": model, "query": query, "documents": documents, "top_n": top_n}))


class HashingEmbedder:
    """Deterministic offline embedder: counts of hashed words, as a unit vector."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, model: str, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.width)
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                v[h % self.width] += 1 if h >> 31 else -1
            v[0] += 0 if v.any() else 1
            out.append((v / np.sqrt((v * v).sum())).tolist())
        return out


class CountingEmbedder:
    """Deterministic embedder for checks: a text's numbers of characters, of spaces and of the letter e, in batches that a
    service of ``limit`` texts accepts."""

    def __init__(self, limit: int = 7):
        self.limit = limit

    def embed(self, model: str, texts: list[str]) -> list[list[float]]:
        if len(texts) > self.limit:
            raise ModelError(f"batch size is invalid, it should not be larger than {self.limit}")
        return [[float(len(t)), float(t.count(" ")), float(t.count("e"))] for t in texts]


def embed_all(client, model: str, texts: list[str], size: int = 10, attempts: int = 4, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Vectors of ``texts``, in batches that shrink for good when the service names a limit.

    Passing errors are retried with doubling pauses; shrinking takes an attempt but no pause; a wrong number of vectors
    is not retried.
    """
    out: list[list[float]] = []
    size, attempts, delay = max(1, size), max(1, attempts), max(0.1, delay)
    while len(out) < len(texts):
        for attempt in range(1, attempts + 1):
            batch = texts[len(out) : len(out) + size]
            try:
                got = client.embed(model, batch)
                break
            except Exception as e:
                message = str(e)
                limit = re.search(r"not be larger than\s+(\d+)", message, re.IGNORECASE)
                if attempt == attempts:
                    raise
                if limit and 0 < int(limit[1]) < len(batch):
                    size = int(limit[1])
                elif any(m in message.lower() for m in RETRYABLE):
                    sleep(delay * 2 ** (attempt - 1))
                else:
                    raise
        if len(got) != len(batch):
            raise ModelError(f"{len(got)} vectors for {len(batch)} texts")
        out += got
    return out


def embedded(chunks: DataFrame, factory: Callable[[], object], model: str, text: str = "text", size: int = 10, attempts: int = 4, delay: float = 1.0) -> DataFrame:
    """``chunks`` with a column ``embedding`` of each text's first EMBEDDED characters. Write the result before reuse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = factory()
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()]
            vectors = pa.array(embed_all(client, model, texts, size, attempts, delay), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=[*batch.schema.names[:-1], "embedding"])

    rows = chunks.select("*", F.substring(text, 1, EMBEDDED).alias("_head"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return rows.mapInArrow(run, f"{fields}, embedding array<double>")
