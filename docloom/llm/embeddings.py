"""Near-duplicate vectors by a subspace pigeonhole join.

For unit vectors, cosine >= c is squared distance <= 2 - 2c. Vectors are rotated by a fixed random orthogonal matrix and
split into BLOCKS blocks of equal width; a pair within the whole budget is within a block's proportional share of it in
at least one block. Each block is joined by range over several of its coordinates: these are cut at quantiles, which gives
boxes of about SLAB vectors. A vector is at home in its box and visits the boxes of lower numbers
whose squared distance from it, summed over the block's cut coordinates, is within the share, so each pair of vectors
meets once. Inside a box, block distances within the share select candidates, and the union of candidates over blocks
is verified exactly, by cosine in double precision of the vectors as given. A pair is counted in the first block that
finds it, so no pair is emitted: tasks return each vector's number of links and a spanning forest of the links they saw.

Boxes with many homes are tiled, so the vectors of a hot box are spread and a task holds one tile's homes, of ROOM
coordinates at most, and streams visitors. The more boxes there are, the more coordinates are cut and the smaller the share of
them that a vector visits; distances are computed as matrix products. Vectors of each width are a join of their own.
Quantiles are those of at most about SAMPLE vectors; they steer the boxes' sizes, not the result.

Defined cases: vectors that are null, empty, zero or with null or non-finite components link with nothing, and neither do
vectors of different widths; equal vectors link; rows sharing an id count as one node each (their links add up); rows with
a null id link with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialize, runs, tiled
from docloom.llm.components import components
from docloom.sources.scratch import scratch_scope

#: Blocks; members of a box as a goal, homes of a tile, and the coordinates that either has at most; homes and visitors
#: compared at once.
BLOCKS, SLAB, TILE, ROOM, HOMES, VISITORS = 4, 65_536, 65_536, 1 << 22, 8_192, 1_024
#: Vectors of a width that quantiles are taken from, about.
SAMPLE = 8_192
#: Added to a block's share for rounding: candidates are verified exactly.
SLACK = 1e-6


@lru_cache(maxsize=8)
def rotation(width: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(0xC0FFEE).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def cuts(width: int) -> list[int]:
    """The first coordinate of each block, and the end."""
    blocks = min(BLOCKS, width)
    return [round(width * k / blocks) for k in range(blocks + 1)]


def shares(width: int, cosine: float) -> list[float]:
    """Each block's part of the budget of squared distance."""
    at = cuts(width)
    return [(2 - 2 * cosine) * (b - a) / width + SLACK for a, b in zip(at, at[1:], strict=False)]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def boxes_for(total: int, width: int) -> list[int]:
    """Into how many slabs each coordinate of a block is cut, so that boxes have about SLAB vectors."""
    slabs = [1] * min(b - a for a, b in zip(cuts(width), cuts(width)[1:], strict=False))
    many = 1
    while many * max(1, min(SLAB, ROOM // width)) < total:
        k = slabs.index(min(slabs))
        many = many // slabs[k] * (slabs[k] + 1)
        slabs[k] += 1
    return slabs


def bounds_of(rows: DataFrame, totals: dict[int, int]) -> dict[int, list[list[np.ndarray]]]:
    """For each width, block and cut coordinate: the slabs' bounds."""
    out = {}
    for width, total in totals.items():
        slabs = [s for s in boxes_for(total, width) if s > 1]
        out[width] = [[] for _ in cuts(width)[1:]]
        if slabs:
            some = F.pmod(F.xxhash64("id", "v"), F.lit(total)) < SAMPLE
            v = rows.filter((F.col("w") == width) & some).select("v").limit(2 * SAMPLE).toArrow()
            if v.num_rows:
                r = units(_matrix(v.column("v").combine_chunks(), width)) @ rotation(width)
                steps = [np.arange(1, s) / s for s in slabs]
                out[width] = [[np.quantile(r[:, a + j], q) for j, q in enumerate(steps)] for a in cuts(width)[:-1]]
    return out


def home(r: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """The number of each row's box; ``r``: coordinates of the block."""
    out = np.zeros(len(r), np.int64)
    for j, b in enumerate(bounds):
        out = out * (len(b) + 1) + np.searchsorted(b, r[:, j], "right")
    return out


def visited(r: np.ndarray, bounds: list[np.ndarray], share: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, box) of the boxes whose squared distance from a row is at most ``share``."""
    row, box, far = np.arange(len(r)), np.zeros(len(r), np.int64), np.zeros(len(r))
    for j, b in enumerate(bounds):
        low, high = np.append(-np.inf, b), np.append(b, np.inf)
        x = r[row, j][:, None]
        d = far[:, None] + np.maximum(np.maximum(low - x, x - high), 0) ** 2
        at, slab = np.nonzero(d <= share)
        row, box, far = row[at], box[at] * len(low) + slab, d[at, slab]
    return row, box


def linked(vectors: DataFrame, key: str, vector: str, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(counts, forest): (id, n) partial numbers of links, and links (a, b) that connect what is linked."""
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.filter(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("w", F.size("v"))
    totals = {r.w: r["count"] for r in rows.groupBy("w").count().filter("count > 1").collect()}  # a row for each width
    spark = vectors.sparkSession
    if not totals:
        return spark.createDataFrame([], "id long, n long"), spark.createDataFrame([], "a long, b long")
    bounds = bounds_of(rows, totals)

    def of_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
        """(width, rows, rotated units) of rows whose width has others."""
        for batch in batches:
            w = batch.column(0).to_numpy()
            for width in np.unique(w).tolist():
                part = batch.filter(pa.array(w == width))
                for at in range(0, part.num_rows if width in totals else 0, 1024):
                    piece = part.slice(at, 1024)
                    yield width, piece, units(_matrix(piece.column(2), width)) @ rotation(width)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, part, r in of_width(batches):
            at = cuts(width)
            homes = np.stack([home(r[:, a:b], bounds[width][k]) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * homes.shape[1], pa.int32()), pa.array(homes.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], names=["w", "id", "v", "homes"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Visitors of boxes of lower numbers than their own."""
        for width, part, r in of_width(batches):
            at, own = cuts(width), part.column(3).flatten().to_numpy().reshape(len(r), -1)
            for k, share in enumerate(shares(width, cosine)):
                step = max(8, min(1024, (1 << 22) // int(np.prod([len(b) + 1.0 for b in bounds[width][k]]))))
                for first in range(0, len(r), step):  # rows whose boxes are listed at once
                    row, box = visited(r[first : first + step, at[k] : at[k + 1]], bounds[width][k], share)
                    row += first
                    lower = box < own[row, k]
                    row, box = row[lower], box[lower]
                    for s in range(0, len(row), 8192):
                        some, to = pa.array(row[s : s + 8192]), box[s : s + 8192]
                        block, role = np.full(len(to), width * BLOCKS + k), np.full(len(to), 2, np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(block), pa.array(to), pa.array(role), part.column(1).take(some), part.column(2).take(some)], names=["block", "box", "role", "id", "v"]
                        )

    kept = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    placed = materialize(rows.select("w", "id", F.col("v").cast(kept).alias("v")).mapInArrow(place, f"w int, id long, v {kept}, homes array<long>"), "placed")
    members = placed.select("w", F.posexplode("homes").alias("k", "box"), "id", "v")
    members = members.select((F.col("w").cast("long") * BLOCKS + F.col("k")).alias("block"), "box", "id", "v")
    visitors = placed.mapInArrow(visit, f"block long, box long, role int, id long, v {kept}")
    room = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(ROOM) / F.floor(F.col("block") / BLOCKS))))
    rows = tiled(members, ["block", "box"], "id", room, visitors, among=True)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, u = [], None
        counts: dict[int, int] = {}
        parent: dict[int, int] = {}

        def flush():
            for pairs, kind in ((counts, 0), (parent, 1)):
                if pairs:
                    n = len(pairs)
                    a, b = np.fromiter(pairs.keys(), np.int64, n), np.fromiter(pairs.values(), np.int64, n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])
                    pairs.clear()

        def count(nodes: np.ndarray) -> None:
            for x, n in zip(*(v.tolist() for v in np.unique(nodes, return_counts=True)), strict=True):
                counts[x] = counts.get(x, 0) + n

        def meet(other_ids: np.ndarray, other: np.ndarray, other_r: np.ndarray, themselves: bool):
            """Links of the homes with others, or among themselves."""
            limit = share[block] + 1e-5  # for single precision
            orr = np.concatenate([other_r[:, s], np.ones((len(other_r), 1)), (other_r[:, s] ** 2).sum(axis=1)[:, None] - limit], axis=1)
            orr = np.ascontiguousarray(orr.T, np.float32)
            for v, h in ((v, h) for v in range(0, len(other_ids), VISITORS) for h in range(0, min(len(ids), v + VISITORS) if themselves else len(ids), HOMES)):
                hid, hu, hrot = ids[h : h + HOMES], u[h : h + HOMES], r[h : h + HOMES]
                oid, ou, orot = other_ids[v : v + VISITORS], other[v : v + VISITORS], other_r[v : v + VISITORS]
                found = np.flatnonzero((hr[h : h + HOMES] @ orr[:, v : v + VISITORS]).ravel() <= 0)
                i, j = np.divmod(found, len(oid))
                new = hid[i] != oid[j]
                if themselves:
                    new &= i + h < j + v
                i, j = i[new], j[new]
                for piece in range(0, len(i), 1 << 16):
                    a, b = i[piece : piece + (1 << 16)], j[piece : piece + (1 << 16)]
                    d = hrot[a] - orot[b]
                    d *= d
                    close = d[:, s].sum(axis=1) <= share[block]
                    for k in range(block):  # an earlier block has this pair
                        close &= d[:, at[k] : at[k + 1]].sum(axis=1) > share[k]
                    a, b = a[close], b[close]
                    real = np.einsum("ij,ij->i", hu[a], ou[b]) >= cosine
                    a, b = a[real], b[real]
                    if not len(a):
                        continue
                    count(hid[a])
                    count(oid[b])
                    # Each home and each visitor takes the smallest id linked to it; homes keep theirs over batches.
                    low = np.full(len(hid), 2**63 - 1, np.int64)
                    np.minimum.at(low, a, np.minimum(oid[b], hid[a]))
                    while True:
                        seen = np.full(len(oid), 2**63 - 1, np.int64)
                        np.minimum.at(seen, b, low[a])
                        before = low[a]
                        np.minimum.at(low, a, seen[b])
                        if (low[a] == before).all():
                            break
                    x, y = np.unique(a), np.unique(b)
                    for node, to in [*zip(hid[x].tolist(), low[x].tolist(), strict=True), *zip(oid[y].tolist(), seen[y].tolist(), strict=True)]:
                        if node != to:
                            old = parent.get(node)
                            if old is not None and old != to:  # both stay connected to the node
                                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([node]), pa.array([old])], names=["kind", "a", "b"])
                            parent[node] = to
                if len(parent) + len(counts) > 2_000_000:
                    yield from flush()

        def tiles():
            """(group, role, rows), and a last one of each tile without rows."""
            now = None
            for (number, box, tile, _, role), part in runs(batches, 5):
                if (number, box, tile) != now:
                    if now is not None:
                        yield now, 9, None
                    now = number, box, tile
                yield now, role, part
            if now is not None:
                yield now, 9, None

        for (number, *_), role, part in tiles():
            if not role:
                width, block = divmod(number, BLOCKS)
                homes.append((part.column(5).to_numpy(), _matrix(part.column(6), width)))
                continue
            if homes:  # all of them are here
                at, share, turn = cuts(width), shares(width, cosine), rotation(width)
                s = slice(at[block], at[block + 1])
                ids = np.concatenate([x[0] for x in homes])
                u = units(np.concatenate([x[1] for x in homes]))
                homes, r = [], u @ turn
                # |x|**2 + |y|**2 - 2xy - share as one product: the columns behind the coordinates add the squares.
                hr = np.concatenate([-2 * r[:, s], (r[:, s] ** 2).sum(axis=1)[:, None], np.ones((len(r), 1))], axis=1).astype(np.float32)
                yield from meet(ids, u, r, True)
            if role < 9 and u is not None:
                other = units(_matrix(part.column(6), width))
                yield from meet(part.column(5).to_numpy(), other, other @ turn, False)
            if role == 9:
                u = None
                yield from flush()

    found = materialize(rows.mapInArrow(compare, "kind int, a long, b long"), "links")
    return found.filter("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("n")), found.filter("kind = 1").select("a", "b")


def near_duplicate_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(key, n_links, component_id, kept) for each row: links are pairs with a cosine of at least ``cosine``."""
    with scratch_scope(vectors.sparkSession) as keep:
        counts, forest = linked(vectors, key, vector, cosine)
        keep(counts)
        joined = keep(components(forest))
    counts = counts.groupBy("id").agg(F.sum("n").alias("n"))
    ids = vectors.select(F.col(key).cast("long").alias(key))
    out = ids.join(counts, F.col(key) == F.col("id"), "left").drop("id").join(joined, F.col(key) == F.col("id"), "left")
    out = out.select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", key).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
