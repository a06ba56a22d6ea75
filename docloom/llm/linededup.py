"""Line dedup by content-defined passages.

A passage is told by its own lines only, so one that starts elsewhere in another text is the same passage:
- chunks: a text's lines are hashed, and a rolling hash over the last WINDOW line hashes ends a chunk of two lines or
  more where it is divisible by DIVISOR;
- lines of over WORDS words;
- windows: from each line that isn't blank the fewest lines on, and the fewest lines back, that have over WORDS words.
Two texts that share a run of lines with over WORDS words share windows that cover all of the run but blank lines at its
ends, wherever it starts. A passage that occurs again anywhere in the corpus is removed everywhere but in the row with
the smallest id, where its first occurrence stays. So each line stays somewhere: nothing earlier has it where it is first.

Passages are told by 64-bit hashes first, and compared by their bytes before anything is removed:
1. Passages whose hash may repeat (told by a slot map of fixed size) are written as hash and place, and grouped by hash
   with map-side combination.
2. Texts are joined with their passages of repeated hashes and written. Each task gathers the bytes of the hashes it meets,
   and hashes that stand for different bytes are found by one aggregation.
3. Passages of such hashes, which are few or none, are grouped again by their bytes.
The passages that occur most are joined by broadcast, others by shuffle; both ways join the same columns.

Defined cases: null texts stay null and count as empty; passages of white space only are never removed; of rows that share
the smallest id all keep the passage's first occurrence; lines that repeat with a period of WORDS words or less are cut
to the first period; null ids sort before others; a text of which everything is removed becomes empty; texts are never
cut; extra columns are passed through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SLOTS, join_frequent, plain, repeated_slots, set_bits, text_of
from docloom.sources.scratch import materialize, scratch_scope

WINDOW, DIVISOR = 2, 3
#: Words that a passage of any lines is to exceed.
WORDS = 50
#: Bytes of passages that a task gathers at once.
GATHERED = 32 << 20
SLICE = 256
_TURN = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_ALL = 2**64 - 1


def _boundaries(lines: list[bytes]) -> Iterator[tuple[int, int]]:
    """(first line, end) of each chunk of two lines or more."""
    start, last = 0, 0
    digest = xxhash.xxh3_64_intdigest
    for i, line in enumerate(lines):
        h = digest(line)
        rolled = (h * _TURN[0] + last * _TURN[1]) & _ALL
        last = h
        if i > start and (rolled >> 32) % DIVISOR == 0 or i + 1 == len(lines):
            if i > start:
                yield start, i + 1
            start = i + 1


def _windows(lines: list[bytes]) -> Iterator[tuple[int, int]]:
    """(first line, end) of each window and each line of over WORDS words."""
    full = [(i, n) for i, line in enumerate(lines) if (n := len(line.split()))]  # lines that aren't blank
    low, total = 0, 0
    for high, (i, n) in enumerate(full):
        total += n
        if n > WORDS:
            yield i, i + 1
        # Every start whose fewest lines end here; the last of them is the start of the fewest lines back.
        while total - full[low][1] > WORDS:
            yield full[low][0], i + 1
            total -= full[low][1]
            low += 1
        if total > WORDS and low < high:
            yield full[low][0], i + 1


def chunks(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of each passage that isn't blank. Passages may overlap."""
    whole = text.encode("utf-8", "surrogatepass")
    lines = whole.split(b"\n")
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line) + 1)
    for start, end in {**dict.fromkeys(_boundaries(lines)), **dict.fromkeys(_windows(lines))}:
        passage = whole[at[start] : at[end] - 1]
        if passage and not passage.isspace():
            yield start, end - start, passage


def _digests(passages: list[tuple[int, int, bytes]], digest: Callable[[bytes], int]) -> np.ndarray:
    return np.fromiter((digest(c) for _, _, c in passages), np.uint64, len(passages))


def chunk_slots(docs: DataFrame, text: str, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> DataFrame:
    """(slot) of every passage's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                found = [_digests(list(chunks(t)), digest) for t in batch.column(0).slice(at, SLICE).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(found) % np.uint64(SLOTS)).astype(np.int64))], names=["slot"])

    return docs.select(text_of(text).alias("text")).mapInArrow(run, "slot long")


def decided(found: DataFrame, by: list[str]) -> DataFrame:
    """``found`` (at, h, first, n, *by) where ``by`` occurs more than once, each place once, with ``gone``: whether it is
    not the first occurrence in the row with the smallest id."""
    classes = found.groupBy(*by).agg(F.min("at").alias("owner"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    classes = materialize(classes, "classes")
    columns = ["at", "h", "first", "n", *by]
    rows = join_frequent(found, classes, by, "times", found.count()).select(*columns, "owner")
    # Rows that share id and text have the same places.
    rows = rows.groupBy("at", "h", *by, "owner").agg(F.array_sort(F.collect_set(F.struct("first", "n"))).alias("places"))
    rows = rows.select("at", "h", *by, "owner", F.posexplode("places").alias("k", "r"))
    return rows.select("at", "h", "r.first", "r.n", *by, ((F.col("k") > 0) | (F.col("at") != F.col("owner"))).alias("gone"))


def spelled(joined: DataFrame, text: str, only: DataFrame | None = None) -> DataFrame:
    """(at, h, first, n, d, c) of the places listed in ``joined`` (_at, _h, _list, text), c: bytes. Without ``only`` each
    task gives different bytes of a hash once, as long as it holds them; with it (column d), all places of its hashes."""
    wanted = None if only is None else {r.d for r in only.collect()}  # hashes that collide

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, held = {}, 0
        for batch in batches:
            out = []
            for at, h, places, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                lines = t.encode("utf-8", "surrogatepass").split(b"\n")
                for r in places:
                    if wanted is not None and r["d"] not in wanted:
                        continue
                    c = b"\n".join(lines[r["first"] : r["first"] + r["n"]])
                    if wanted is None:
                        if met.get(r["d"]) == c:
                            continue
                        met[r["d"]] = c
                        held += len(c)
                    out.append((at, h, r["first"], r["n"], r["d"], c))
                    if held > GATHERED:
                        met, held = {}, 0
            if out:
                kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["at", "h", "first", "n", "d", "c"])

    rows = joined.filter("_list IS NOT NULL").select("_at", "_h", "_list", text_of(text).alias("t"))
    return rows.mapInArrow(run, "at long, h long, first int, n int, d long, c binary")


_PLACE = "struct<first int, n int, d long, gone boolean>"


def listed(marked: DataFrame) -> DataFrame:
    """(_at, _h, _list, _gone) of each text: its sorted places, and the lines that go as ranges that don't touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column(2).to_pylist():
                ranges = []
                for r in places:
                    end = r["first"] + r["n"]
                    if not r["gone"]:
                        continue
                    if ranges and r["first"] <= ranges[-1][0] + ranges[-1][1]:
                        ranges[-1] = ranges[-1][0], max(ranges[-1][1], end - ranges[-1][0])
                    else:
                        ranges.append((r["first"], r["n"]))
                out.append([{"first": s, "n": n} for s, n in ranges])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=["_at", "_h", "_list", "_gone"])

    places = F.array_sort(F.collect_list(F.struct("first", "n", "d", "gone"))).alias("_list")
    rows = marked.groupBy(F.col("at").alias("_at"), F.col("h").alias("_h")).agg(places)
    return rows.mapInArrow(run, f"_at long, _h long, _list array<{_PLACE}>, _gone array<struct<first int, n int>>")


def without_repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> DataFrame:
    """The rows of ``docs`` with repeated passages removed from ``text``, and n_lines, n_removed_lines.

    ``digest``: a hash of bytes in 64 bits; any gives the same result, as bytes are compared.
    """
    given = docs.columns
    docs, (key, text) = plain(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(repeated_slots(chunk_slots(docs, text, digest)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                found = []
                for i, h, t in zip(*(piece.column(k).to_pylist() for k in range(3)), strict=True):
                    passages = list(chunks(t))
                    if passages:
                        d = _digests(passages, digest)
                        keep = np.flatnonzero(set_bits(shared.value, (d % np.uint64(SLOTS)).astype(np.int64)))
                        found += [(i, h, *passages[k][:2], x) for k, x in zip(keep.tolist(), d[keep].view(np.int64).tolist(), strict=True)]
                if found:
                    kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["at", "h", "first", "n", "d"])

    at, h = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), F.xxhash64(text)
    names = docs.columns
    with scratch_scope(docs.sparkSession) as keep:
        rows = docs.select(at.alias("at"), h.alias("h"), text_of(text).alias("text"))
        found = materialize(rows.mapInArrow(run, "at long, h long, first int, n int, d long"), "chunks")
        texts = docs.select(*names, at.alias("_at"), h.alias("_h"))
        joined = materialize(texts.join(listed(decided(found, ["d"])), ["_at", "_h"], "left"), "joined")
        clash = spelled(joined, text).groupBy("d").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a != b").select("d")
        clash = materialize(clash, "clash")
        if not clash.isEmpty():
            exact = decided(materialize(spelled(joined, text, clash), "spelled"), ["d", "c"]).select("at", "h", "first", "n", "d", "gone")
            kept = joined.select(F.col("_at").alias("at"), F.col("_h").alias("h"), F.explode("_list").alias("r")).select("at", "h", "r.*").distinct()
            marked = kept.join(F.broadcast(clash), "d", "left_anti").select("at", "h", "first", "n", "d", "gone").unionByName(exact)
            joined = materialize(joined.drop("_list", "_gone").join(listed(marked), ["_at", "_h"], "left"), "joined")
        keep(joined)

    lines = F.split(F.col(text), "\n")
    ends = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda r: r.first + r.n))
    starts = F.concat(F.transform("_gone", lambda r: r.first), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(ends, starts, lambda e, s: F.slice(lines, e + 1, s - e)))
    removed = F.aggregate("_gone", F.lit(0), lambda x, r: x + r.n)
    some = F.size("_gone") > 0
    out = [F.when(some, F.array_join(kept, "\n")).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in names]
    counts = {"n_lines": F.coalesce(F.size(lines), F.lit(0)), "n_removed_lines": F.coalesce(removed, F.lit(0))}
    counts = {k: v.cast("long") for k, v in counts.items() if k not in given}
    return joined.select(*out, *counts.values()).toDF(*given, *counts)
