"""MinHash near-duplicates with b-bit signatures, confirmed on full shingle sets.

1. Each text becomes its set of distinct five-word shingles (64-bit hashes) and 192 minima. 32 bands of six minima
   give candidate keys; of each minimum only BITS low bits (after a bijective mix) are kept, packed into a signature.
2. Equal sets are one class, represented by its smallest id, so copies never meet in pairs.
3. The members of a band key are compared by signature: pairs whose collision-corrected estimate lies within six
   standard errors of the threshold or above are candidates, and a spanning forest of them joins sets to clusters.
   Clusters hold every candidate pair, and little else, as sets that aren't similar aren't joined.
4. Each cluster's sets are compared with its first one on the full sets, which joins most clusters whole. The sets of
   others are sent to tiles, where every pair of a tile's homes and visitors that isn't already connected there is
   confirmed: a visitor's shingles are looked up among those of all homes, which gives the intersections with all of
   them at once. Tasks return spanning forests of the links; no pairs are emitted.

A pair at the threshold of 0.85 shares no band with probability (1 - 0.85**6)**32 = 3e-7; nothing else is probabilistic
but 64-bit hashing. There is no cap on a key's members or on partners.

Defined cases: null and empty texts have an empty set and link with nothing; one to four words are one shingle; texts
are never cut; rows sharing an id count as one node; rows with a null id link with nothing and are kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SLOTS, id_slot, join_frequent, materialize, plain, repeated_slots, set_bits, slot_map, text_of, tile_visits, tiled
from docloom.llm.components import components
from docloom.sources.scratch import scratch_scope

WORDS, BANDS, ROWS, BITS = 5, 32, 6, 4
PERMS = BANDS * ROWS
LONGS = PERMS * BITS // 64
#: Rows of texts that are hashed together, signatures and full sets of a tile, and full sets that meet a cluster's first one.
SLICE, TILE, SETS, STAR = 256, 2048, 512, 128

_U = np.uint64
_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_MULTIPLY = (_RNG.integers(0, 2**31, (PERMS, 1)) * 2 + 1).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, (PERMS, 1), dtype=np.uint64).astype(np.uint32)
_WORD = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) | _U(1)
_BAND = _RNG.integers(1, 2**63, ROWS, dtype=np.uint64) | _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of ``data``, letters A-Z as lower case. Works on about a MiB at a time."""
    x = np.frombuffer(data, np.uint8)
    space = _SPACE[x]
    hashes, starts, at = [], [], 0
    while at < len(x):
        end = min(len(x), at + (1 << 20))
        if end < len(x) and not space[end - 1]:  # cut after white space; a longer word is taken whole
            cut = np.flatnonzero(space[at:end])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:
                cut = np.flatnonzero(space[end:])
                end = end + int(cut[0]) + 1 if len(cut) else len(x)
        part, blank = x[at:end], space[at:end]
        edge = np.diff(np.concatenate(([1], blank.view(np.int8), [1])))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _powers(end - at + 1)
        total = np.zeros(end - at + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: end - at], out=total[1:])
        hashes.append(mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    words, starts = word_hashes(b" ".join(data) + b" ")
    cut = np.searchsorted(starts, ends, "left") if len(ends) else []
    out, first = [], 0
    n = max(0, len(words) - WORDS + 1)
    all_shingles = np.zeros(n, np.uint64)
    for k in range(WORDS):
        all_shingles += words[k : k + n] * _WORD[k]
    all_shingles = mixed(all_shingles)
    for last in map(int, cut):
        if last - first >= WORDS:
            s = np.sort(all_shingles[first : last - WORDS + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif last > first:
            out.append(mixed((words[first:last] * _WORD[: last - first]).sum(keepdims=True) + _U(last - first)))
        else:
            out.append(np.zeros(0, np.uint64))
        first = last
    return out


def minima(shingles: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The PERMS minima of a set; ``room``: (PERMS, any width) scratch."""
    h = (shingles >> _U(32)).astype(np.uint32)
    best = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    width = room.shape[1]
    for at in range(0, len(h), width):
        part = h[at : at + width]
        to = room[:, : len(part)]
        np.multiply(_MULTIPLY, part, out=to)
        to += _ADD
        np.minimum(best, to.min(axis=1), out=best)
    return best


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of the minima."""
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    return mixed((rows * _BAND).sum(axis=1) + np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """BITS low bits of each mixed minimum, as LONGS longs."""
    bits = ((low * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint8)
    return (bits[0::2] | (bits[1::2] << 4)).view(np.int64)


def agreement(xor: np.ndarray) -> np.ndarray:
    """Fields that agree, from the XOR of signatures over the last axis."""
    x = xor.view(np.uint64)
    x = x | (x >> _U(1))
    x = x | (x >> _U(2))
    return PERMS - np.bitwise_count(x & _U(0x1111111111111111)).sum(axis=-1).astype(np.int64)


def least_agreement(percent: int) -> int:
    """Agreeing fields below which a pair at the threshold is over six standard errors away.

    A field agrees with probability s + (1 - s) / 2**BITS at similarity s: the estimate is corrected for collisions.
    """
    chance = 1 / 2**BITS
    p = chance + (1 - chance) * percent / 100
    return math.floor(PERMS * p - 6 * math.sqrt(PERMS * p * (1 - p)))


def estimated_similarity(fields: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity from the number of agreeing fields."""
    chance = 1 / 2**BITS
    return (fields / PERMS - chance) / (1 - chance)


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_shingles, d1, d2, sig, bands) for each row; d1, d2: 128-bit digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.empty((PERMS, 1024), np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n, digests, sig, bands = [], [], [], []
                for s in shingle_sets(part.column(1).to_pylist()):
                    low = minima(s, room)
                    n.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sig.append(packed(low))
                    bands.append(band_keys(low))
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                step = lambda k: pa.array(np.arange(len(n) + 1) * k, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]),
                        pa.ListArray.from_arrays(step(LONGS), pa.array(np.concatenate(sig))),
                        pa.ListArray.from_arrays(step(BANDS), pa.array(np.concatenate(bands))),
                    ],
                    names=["id", "n_shingles", "d1", "d2", "sig", "bands"],
                )

    rows = docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, d1 long, d2 long, sig array<long>, bands array<long>")


def forest(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking i to j (positions): each takes the least label that is linked to it, until nothing changes."""
    labels = labels.copy()
    while True:
        low = np.minimum(labels[i], labels[j])
        before = labels.copy()
        np.minimum.at(labels, i, low)
        np.minimum.at(labels, j, low)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def _banded(classes: DataFrame) -> DataFrame:
    """(band, id, sig) of the band keys that two classes or more have.

    A slot map of 8 MiB holds most other keys back while there are few of them; the rest are counted as keys alone. Both
    counts combine in the tasks, so a frequent key is a row of each, and signatures go only where keys repeat.
    """
    keys = classes.select(F.explode("bands").alias("band")).select(F.pmod("band", F.lit(SLOTS)).alias("slot"))
    shared = classes.sparkSession.sparkContext.broadcast(repeated_slots(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column(1).flatten().to_numpy()
            kept = np.flatnonzero(set_bits(shared.value, bands % SLOTS))
            yield pa.RecordBatch.from_arrays([pa.array(bands[kept]), batch.column(0).take(pa.array(kept // BANDS))], names=["band", "id"])

    kept = materialize(classes.select(F.col("rep").alias("id"), "bands").mapInArrow(run, "band long, id long"), "banded")
    repeated = materialize(kept.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    members = join_frequent(kept, repeated, ["band"], "n", kept.count())
    return members.join(classes.select(F.col("rep").alias("id"), "sig"), "id").select("band", "id", "sig")


def _clusters(members: DataFrame, least: int) -> DataFrame:
    """(id, component): candidates of band keys, ``members`` (band, id, sig), joined."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, made = None, None
        for homes, part in tile_visits(batches, 3):
            if kept is not homes:
                kept = homes
                hid = np.concatenate([h.column(4).to_numpy() for h in homes])
                hsig = np.concatenate([h.column(5).flatten().to_numpy() for h in homes]).reshape(-1, LONGS)
            ids, sig = part.column(4).to_numpy(), part.column(5).flatten().to_numpy().reshape(-1, LONGS)
            n = len(hid)
            for at in range(0, len(ids), 256):
                v, vsig = ids[at : at + 256], sig[at : at + 256]
                i, j = [], []
                for k in range(0, n, 256):  # bounded blocks of signatures
                    near = agreement(hsig[k : k + 256, None, :] ^ vsig[None, :, :]) >= least
                    near &= hid[k : k + 256, None] != v[None, :]
                    x, y = np.nonzero(near)
                    i.append(x + k)
                    j.append(y + n)
                i, j = np.concatenate(i), np.concatenate(j)
                if not len(i):
                    continue
                both = np.concatenate([hid, v])
                labels = forest(np.arange(len(both)), i, j)
                made = np.flatnonzero((labels != np.arange(len(both))) & (both[labels] != both))
                if len(made):
                    yield pa.RecordBatch.from_arrays([pa.array(both[made]), pa.array(both[labels[made]])], names=["a", "b"])

    rows = tiled(members, ["band"], "id", TILE)
    return components(materialize(rows.mapInArrow(compare, "a long, b long"), "candidates"))


def _links(docs: DataFrame, key: str, text: str, clusters: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the pairs within clusters with 100 * intersection >= percent * union.

    Full sets are recomputed from the texts of the rows whose ids may be in a cluster, told by a slot map of 8 MiB.
    """
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(slot_map(clusters.select((id_slot("id") + 1).alias("s")).distinct(), "s"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = set_bits(wanted.value, batch.column(1).to_numpy())
            batch = batch.filter(pa.array(keep))
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = [s.tobytes() for s in shingle_sets(part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), text_of(text).alias("text"))
    sets = rows.select("id", id_slot("id").alias("slot"), "text").mapInArrow(full, "id long, shingles binary")
    # Rows that repeat an id and its set are combined before the shuffle.
    sets = sets.groupBy("id", F.xxhash64("shingles").alias("h")).agg(F.any_value("shingles").alias("shingles"))
    sets = materialize(sets.join(clusters, "id").select("component", "id", "shingles"), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for homes, part in tile_visits(batches, 3):
            if kept is not homes:
                kept = homes
                hid = np.concatenate([h.column(4).to_numpy() for h in homes])
                hsets = [np.frombuffer(x, np.uint64) for h in homes for x in h.column(5).to_pylist()]
                sizes = np.array([len(s) for s in hsets])
                flat, owner = np.concatenate(hsets), np.repeat(np.arange(len(hsets)), sizes)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                label = np.arange(len(hid))
            for v, x in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint64)
                lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
                n = hi - lo
                place = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
                shared = np.bincount(owner[place], minlength=len(hid))
                linked = 100 * shared >= percent * (sizes + len(x) - shared)
                linked &= hid != v
                roots = np.unique(label[linked])
                if len(roots):
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(roots), pa.int64()), pa.array(hid[roots])], names=["a", "b"])
                    # What this visitor has connected needs no further links but to it.
                    label[np.isin(label, roots)] = roots[0]

    # First all sets of a cluster against the one with the smallest id, which bears the cluster's number.
    first = F.col("id") == F.col("component")
    stars = tiled(sets.filter(~first), ["component"], "id", STAR, sets.filter(first).withColumn("role", F.lit(1)))
    stars = materialize(stars.mapInArrow(compare, "a long, b long"), "stars")
    # Then the others of clusters of three sets or more with each other and with those that this has joined.
    linked = stars.select(F.col("b").alias("id"), F.lit(True).alias("linked")).distinct()
    groups = sets.select("component", "id").distinct().join(linked, "id", "left")
    groups = materialize(groups.withColumn("linked", F.coalesce("linked", first)), "groups")
    split = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_if("linked").alias("linked")).filter("n > linked AND n > 2")
    split = materialize(split.select("component", "n"), "split")
    left = join_frequent(sets, split, ["component"], "n", split.agg(F.sum("n")).first()[0] or 0).select("component", "id", "shingles")
    left = materialize(left.join(groups.select("id", "linked"), "id").select("component", "id", "shingles", "linked"), "left")
    rows = tiled(left, ["component"], "id", SETS, joined="linked")
    return stars.unionAll(materialize(rows.mapInArrow(compare, "a long, b long"), "links"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row; links are pairs with 100 * |A & B| >= percent * |A | B|."""
    all_rows = materialize(signatures(docs, key, text), "signatures")
    live = all_rows.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = live.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))
    classes = materialize(classes, "classes")
    with scratch_scope(docs.sparkSession) as keep:
        clusters = _clusters(materialize(_banded(classes), "members"), least_agreement(percent))
        joined = keep(components(_links(docs, key, text, clusters, percent)))

    known = classes.select("d1", "d2", "rep").join(joined, F.col("rep") == F.col("id"), "left")
    known = known.select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = all_rows.select("id", "n_shingles", "d1", "d2").join(
        known, (F.col("n_shingles") > 0) & all_rows.id.isNotNull() & (all_rows.d1 == known.d1) & (all_rows.d2 == known.d2), "left"
    )
    out = out.select(F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that stand for their group: those with its smallest id; of several such rows any one.

    Rows with a null id are kept.
    """
    with scratch_scope(docs.sparkSession) as keep:
        found = near_duplicates(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "id", "text", percent)
        kept = keep(materialize(found.filter("kept AND id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")), "kept"))
    rows, (id_,) = plain(docs, key)
    once = rows.join(kept.filter("n = 1").select("id"), F.col(id_) == F.col("id"), "left_semi")
    out = once.unionAll(rows.filter(F.col(id_).isNull()))
    if not kept.filter("n > 1").isEmpty():
        # Rows that share an id: combined before the shuffle, so that an id with many rows sends one for each task.
        many = rows.join(kept.filter("n > 1").select("id"), F.col(id_) == F.col("id"), "left_semi")
        many = many.groupBy(F.col(id_).alias("id")).agg(F.any_value(F.struct(*rows.columns)).alias("row"))
        out = out.unionAll(many.select("row.*"))
    return out.toDF(*docs.columns)
