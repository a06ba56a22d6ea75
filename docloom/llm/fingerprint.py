"""Canonical exact digests: equal fingerprints if and only if canonical texts are equal byte for byte.

The canonical text is NFKC-normalised, case-folded, normalised again, with runs of white space as one space and none at
the ends; its fingerprint is the 128-bit xxh3 digest of its UTF-8 bytes. Inside buckets of equal digests the bytes are
compared: texts that differ get the digest with ``-1``, ``-2`` and so on behind it, in the order of their bytes.
An exact digest has a likeness of 1 to an equal one and 0 to any other.

Only buckets of two or more need the comparison. Which digests these may be is told by a slot map of fixed size, so the
canonical texts of other rows are not shuffled; equal texts are combined before the shuffle, so a bucket with a third of
all rows sends one row for each task.

Defined cases: null and empty texts are the empty string, whose digest is like any other's; rows with a null id come
first in order; rows that share an id are ordered by text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import SLOTS, bisected, materialize, repeated_slots, runs, set_bits, text_of

#: Rows that are worked on together.
SLICE = 512
#: Mean characters of a range of ids, and ranges at most: beyond, ranges are longer; they are sorted with spilling and streamed.
RANGE_CHARS, RANGES = 8_000_000, 65_536
#: Sampled ids for each range, and bounds that are looked up together.
SAMPLED, BLOCK = 32, 256


def canonical(text: str) -> bytes:
    """The canonical form's UTF-8 bytes."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return " ".join(text.split()).encode("utf-8", "surrogatepass")
    return " ".join(text.lower().split()).encode()


def digest(canon: bytes) -> bytes:
    return xxhash.xxh3_128_digest(canon)


def slots_of(digests: list[bytes]) -> np.ndarray:
    """Slot of each digest in a slot map."""
    return (np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)[:, 0] % np.uint64(SLOTS)).astype(np.int64)


def digest_slots(docs: DataFrame, text: str = "text") -> DataFrame:
    """(slot) of each row's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                found = [digest(canonical(t)) for t in batch.column(0).slice(at, SLICE).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(slots_of(found))], names=["slot"])

    return docs.select(text_of(text).alias("text")).mapInArrow(run, "slot long")


def named(rows: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """``rows`` with final fingerprints in the digest columns; columns: (digest, canonical bytes) names.

    The bytes are null where the slot map rules an equal digest out. Digests whose bytes differ are found by comparing
    the least and the greatest bytes of each bucket, combined before the shuffle; in practice there are none, and the
    rows are returned as they are.
    """
    texts = None
    for d, c in columns:
        part = rows.filter(F.col(c).isNotNull()).select(F.col(d).alias("_d"), F.col(c).alias("_c"))
        texts = part if texts is None else texts.unionAll(part)
    unequal = texts.groupBy("_d").agg(F.min("_c").alias("x"), F.max("_c").alias("y")).filter("x != y").select("_d")
    unequal = materialize(unequal, "unequal")
    if unequal.isEmpty():
        return rows
    few = texts.join(unequal, "_d").distinct()
    few = materialize(few.withColumn("_n", F.row_number().over(Window.partitionBy("_d").orderBy("_c")) - 1), "numbered")
    for d, c in columns:
        rows = rows.join(few, (F.col(d) == F.col("_d")) & (F.col(c) == F.col("_c")), "left")
        rows = rows.withColumn(d, F.when(F.col("_n") > 0, F.concat(d, F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col(d))).drop("_d", "_c", "_n")
    return rows


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated_slots(digest_slots(docs, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                canon = [canonical(t) for t in part.column(1).to_pylist()]
                found = [digest(c) for c in canon]
                keep = set_bits(shared.value, slots_of(found))
                canon = [c if k else None for c, k in zip(canon, keep, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([d.hex() for d in found], pa.string()), pa.array(canon, pa.binary())],
                    names=["key", "fingerprint", "canon"],
                )

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    rows = materialize(rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fingerprint string, canon binary"), "canon")
    return named(rows, [("fingerprint", "canon")]).select(F.col("key").alias(key), "fingerprint")


def in_ranges(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(part, id, text, guest): rows dealt by ranges of ids, sorted in each, followed by the next range's first row.

    Range bounds are quantiles of sampled ids, about RANGE_CHARS characters apart. A row finds its range among blocks of
    bounds, then in its block. A range's successor is the least row of
    the next range that has one; the last range is followed by the first row of all. So each row's successor in the
    order of (id, text) is the row below it, and no task holds more than its range.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("text"))
    least = -(2**63)
    rows = rows.select(F.coalesce("id", F.lit(least)).alias("at"), "id", "text")
    total = rows.agg(F.sum(F.length("text").cast("long")).alias("c"), F.count(F.lit(1)).alias("n")).first()
    ranges = max(1, min(total.n, RANGES, round((total.c or 0) / RANGE_CHARS)))
    bounds = []
    if ranges > 1:
        some = np.sort(rows.select("at").sample(min(1.0, SAMPLED * ranges / total.n), 1).toArrow().column(0).to_numpy())
        bounds = sorted({int(some[i * len(some) // ranges]) for i in range(1, ranges)}) if len(some) else []
    blocks = [(a, bounds[a * BLOCK : (a + 1) * BLOCK]) for a in range(len(bounds) // BLOCK + 1)]
    blocks = F.broadcast(docs.sparkSession.createDataFrame(blocks, "block int, bounds array<long>"))
    rows = rows.withColumn("block", bisected("at", bounds[BLOCK - 1 :: BLOCK])).join(blocks, "block")
    within = F.size(F.filter("bounds", lambda b: b < F.col("at")))
    rows = rows.select((F.col("block") * BLOCK + within).cast("int").alias("part"), "id", "at", "text")
    firsts = rows.groupBy("part").agg(F.min("at").alias("at")).collect()  # a row for each range
    firsts = sorted((r.part, r.at) for r in firsts)
    if not firsts:
        return rows.select("part", "id", "text", F.lit(0).alias("guest"))
    before = [(at, firsts[i - 1][0]) for i, (_, at) in enumerate(firsts)]
    before = F.broadcast(docs.sparkSession.createDataFrame(before, "at long, target int"))  # likewise
    # Of rows with the same least id the one with the least text.
    lead = rows.join(before, "at").groupBy("at", "id", "target").agg(F.min("text").alias("text"))
    lead = lead.select(F.col("target").alias("part"), "id", "text", F.lit(1).alias("guest"))
    both = rows.select("part", "id", "text", F.lit(0).alias("guest")).unionAll(lead)
    return both.repartition(max(len(firsts), 1), "part").sortWithinPartitions("part", "guest", F.col("id").asc_nulls_first(), "text")


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness.

    The edited text has its last half replaced by as many first characters of the next row's text.
    (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    """
    shared = docs.sparkSession.sparkContext.broadcast(repeated_slots(digest_slots(docs, text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(last, following):
            """Output of row ``last`` = (id, text, canonical), given the next row's text and canonical."""
            i, t, c = last
            nt, nc = following
            half = len(t) // 2
            e = t[: len(t) - half] + nt[:half]
            ec = canonical(e)
            return i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), c, ec, float(c == ec), float(c == nc)

        def out(rows):
            ids, n, sha, c, ec, ne, nn = zip(*rows, strict=True)
            both = [[digest(x) for x in cs] for cs in (c, ec)]
            kept = [[x if k else None for x, k in zip(cs, set_bits(shared.value, slots_of(ds)), strict=True)] for cs, ds in zip((c, ec), both, strict=True)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                    pa.array([d.hex() for d in both[0]], pa.string()), pa.array([d.hex() for d in both[1]], pa.string()),
                    pa.array(ne, pa.float64()), pa.array(nn, pa.float64()), pa.array(kept[0], pa.binary()), pa.array(kept[1], pa.binary()),
                ],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "canon", "edited_canon"],
            )

        part, last, rows = None, None, []
        for (p,), batch in runs(batches, 1):
            if p != part:
                part, last = p, None
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                for i, t, guest in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True):
                    c = canonical(t)
                    if last is not None:
                        rows.append(made(last, (t, c)))
                    last = None if guest else (i, t, c)
                if len(rows) >= SLICE:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    rows = in_ranges(docs, key, text).mapInArrow(
        run,
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, canon binary, edited_canon binary",
    )
    rows = materialize(rows, "fingerprints")
    # Both columns together: an edited text equal to a document's canonical text shares its bucket. Bytes are kept where
    # documents' digests repeat: edited texts' digests that only one document or other edited texts have aren't compared.
    rows = named(rows, [("fingerprint", "canon"), ("edited_fingerprint", "edited_canon")])
    return rows.select(F.col("id").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
