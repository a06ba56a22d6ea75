"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file gives the vocabulary; its bytes are written in the library's byte-to-character alphabet, and every pair
of tokens whose concatenation is a token is a merge, in the order of that token's rank. Decoding goes back through the
byte table, so ids whose bytes end inside a character come out as the bytes they stand for.

Defined cases: a null text is empty and has no ids; an empty table gives an empty table; null ids of rows are kept;
texts are never cut.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import text_of

#: White space, letters and numbers of Latin-1, as Unicode has them.
_SPACE, _LETTER, _NUMBER = r"\t-\r \x85\xa0", "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: A worker keeps the ids of so many different matches at most, then starts anew; results don't depend on it.
KNOWN = 100_000
#: Texts longer than this are encoded in spans that end between two matches of the pattern.
SPAN = 1 << 16


def byte_characters() -> dict[int, str]:
    """The byte-to-character table of byte-level BPE: printable bytes stand for themselves, others from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in kept}
    for i, b in enumerate(x for x in range(256) if x not in table):
        table[b] = chr(0x100 + i)
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBpe:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        self.chars = byte_characters()
        spelled = lambda t: "".join(self.chars[b] for b in t)
        pairs = sorted(
            (rank, i, token) for token, rank in ranks.items() for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        )
        merges = [(spelled(token[:i]), spelled(token[i:])) for _, i, token in pairs]
        model = models.BPE({spelled(t): r for t, r in ranks.items()}, merges, cache_capacity=10_000, ignore_merges=True)
        mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model = model
        self.spelling = {b: c for b, c in self.chars.items() if chr(b) != c}
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), mapped])
        self.pattern = regex.compile(pattern)
        # Over Latin-1 the property classes are short lists, which the standard module matches several times faster.
        self.latin = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_LETTER}{_NUMBER}]").replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", f"[{_NUMBER}]").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))
        self.known: dict[str, bytes] = {}
        self.names = [str(i) for i in range(max(ranks.values()) + 1)]
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = t

    def spans(self, text: str) -> list[str]:
        """``text`` in pieces of about SPAN characters, cut only where the pattern's matches end."""
        if len(text) <= SPAN:
            return [text]
        out, start = [], 0
        for m in self.pattern.finditer(text):
            if m.end() - start >= SPAN and m.end() < len(text) and not text[m.end()].isspace() and not text[m.end() - 1].isspace():
                out.append(text[start : m.end()])
                start = m.end()
        return [*out, text[start:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list = [b""] * len(texts)
        other: list[tuple[int, str]] = []
        matches: list[tuple[int, list[str]]] = []
        known = self.known
        for k, t in enumerate(texts):
            try:
                t.isascii() or t.encode("latin-1")
            except UnicodeEncodeError:
                other += [(k, span) for span in self.spans(t)]
            else:
                matches.append((k, self.latin.findall(t)))
        new = list(set(chain.from_iterable(m for _, m in matches)).difference(known))
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = list(set(chain.from_iterable(m for _, m in matches)))
        tokenize, spelling = self.model.tokenize, self.spelling
        for w in new:
            known[w] = array("i", [t.id for t in tokenize(w.encode().decode("latin-1").translate(spelling))]).tobytes()
        for k, m in matches:
            out[k] = b"".join(map(known.__getitem__, m))
        for (k, _), e in zip(other, self.tokenizer.encode_batch_fast([s for _, s in other], add_special_tokens=False), strict=True):
            out[k] += array("i", e.ids).tobytes()
        return [np.frombuffer(x, np.int32) for x in out]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Character offsets (start, end) of each id's bytes; parts of one character share its offsets."""
        place, out = [], []
        for i, ch in enumerate(text):
            place += [i] * len(ch.encode("utf-8"))
        at = 0
        for i in self.encode([text])[0].tolist():
            n = len(self.bytes_of[i])
            out.append((place[at], place[at + n - 1] + 1))
            at += n
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ``ids`` stand for."""
        table = self.bytes_of
        return b"".join(map(table.__getitem__, ids))


_MADE: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The encoder for a rank file, made once in each Python worker."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _MADE[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): token ids of every text, encoded in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array(bpe.encode(part.column(1).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])
        bpe.known.clear()  # workers are used again for other stages

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def digest_documents(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): every text encoded and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                count, ids_sha, text_sha = [], [], []
                for ids in map(np.ndarray.tolist, bpe.encode(part.column(1).to_pylist())):
                    count.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        bpe.known.clear()

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
