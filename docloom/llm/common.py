"""Pieces shared by the training-data operators: fixed-size slot maps, joins of frequent keys, tiles, ids."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.sources.scratch import materialize

#: Slots of a slot map: 2**26 bits are 8 MiB, whatever the input's size.
SLOTS = 1 << 26
#: Keys that are frequent at most.
FREQUENT = 1_000


def text_of(column: str | Column) -> Column:
    """The column as a string, null as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def plain(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns c0, c1, ... so that no name clashes with an operator's own, and the new names of ``names``."""
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*at.values()), [at[n] for n in names]


def repeated_slots(slots: DataFrame, column: str = "slot") -> bytes:
    """Bit map of the slots that two rows or more have; ``column`` holds longs in [0, SLOTS).

    Slots are counted with map-side combination, then packed on the executors into bitmaps of 4 KiB;
    the driver gets at most SLOTS / 8 bytes (8 MiB), a bound that doesn't depend on the data.
    A key that repeats always has its bit set; other bits only let more rows through.
    """
    repeated = slots.groupBy(column).count().filter("count > 1").select((F.col(column) + 1).alias("s"))
    return slot_map(repeated, "s")


def slot_map(slots_plus_one: DataFrame, column: str) -> bytes:
    """Bit map with a bit set for each value (less one) in ``column``."""
    packed = slots_plus_one.groupBy(F.bitmap_bucket_number(column).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits")
    )
    out = np.zeros(SLOTS // 8, np.uint8)
    for b, bits in packed.toLocalIterator():
        piece = np.frombuffer(bytes(bits), np.uint8)
        out[(b - 1) * 4096 : (b - 1) * 4096 + len(piece)] |= piece
    return out.tobytes()


def id_slot(column: str | Column) -> Column:
    """Slot of an id, for slot maps over ids."""
    return F.pmod(F.xxhash64(column), F.lit(SLOTS))


def set_bits(bits: bytes, slots: np.ndarray) -> np.ndarray:
    """Whether each slot's bit is set."""
    table = np.frombuffer(bits, np.uint8)
    slots = np.asarray(slots, np.int64)
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def texts_in(batch, column: str) -> Iterable[str]:
    """Python strings of an Arrow column, null as empty."""
    for x in batch.column(column):
        v = x.as_py()
        yield "" if v is None else v


def bisected(column: str | Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` lie below the column, as nested comparisons of logarithmic depth."""
    value = F.col(column) if isinstance(column, str) else column

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > F.lit(bounds[mid]), pick(mid + 1, hi)).otherwise(pick(lo, mid))

    return pick(0, len(bounds))


def join_frequent(rows: DataFrame, keyed: DataFrame, on: list[str], times: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed``, a written table with a row for each key and ``times``, its number of rows out of ``total``.

    Keys with a FREQUENT-th of the rows or more, of which there are at most FREQUENT, are joined by broadcast, so no task
    gets all rows of one; others are joined by shuffle.
    """
    often = F.col(times) >= total / FREQUENT
    few = F.broadcast(keyed.filter(often).drop(times))
    others = rows.join(few.select(*on), on, "left_anti").join(keyed.filter(~often).drop(times), on)
    return rows.join(few, on).unionByName(others)


def runs(batches, keys: int):
    """(key values, rows) for each run of equal values in the first ``keys`` integer columns; a run may come in parts."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(n - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        for s, e in zip(cuts, cuts[1:], strict=False):
            yield tuple(int(c[s]) for c in cols), batch.slice(s, e - s)


def tiled(members: DataFrame, group: list[str], member: str, size: int | Column, visitors: DataFrame | None = None, among: bool = False, joined: str | None = None) -> DataFrame:
    """Rows for comparing the members of each group without all pairs as rows and without an unbounded task.

    ``members`` is read several times, so it should be a written table.

    Members are dealt by their hash to ``ceil(members / size)`` tiles of their group. Without ``visitors``, there is a
    task for each pair of tiles: it gets the members of the first as homes (``role`` 0) and those of the second as
    visitors (``role`` 1), about ``2 * size`` rows; a tile's own members are compared in a task without visitors. Members
    whose column ``joined`` is true have tiles of their own behind the others', and don't meet each other. With
    ``visitors``, whose ``role`` is 1 or more, these come to every tile of their group, where they are streamed; with
    ``among``, homes visit the tiles before their own too (``role`` 1). ``size`` may differ by group. The result, with the
    columns tile and other behind the group's, is spread by all these and sorted so that homes come first.
    """
    idle = F.col(joined) if joined else F.lit(False)
    tiles = members.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.count_if(idle).alias("_j"))
    tiles = tiles.withColumns({"_loose": F.ceil((F.col("_n") - F.col("_j")) / size).cast("int"), "_tight": F.ceil(F.col("_j") / size).cast("int")})
    tiles = materialize(tiles.withColumn("_tiles", F.col("_loose") + F.col("_tight")).drop("_j"), "tiles")
    total = tiles.agg(F.sum("_n")).first()[0] or 0
    place = lambda n: F.pmod(F.xxhash64(member), F.greatest(F.col(n), F.lit(1))).cast("int")
    home = join_frequent(members, tiles, group, "_n", total).withColumn("_tile", F.when(idle, F.col("_loose") + place("_tight")).otherwise(place("_loose")))
    every = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    if visitors is None:
        met = F.when(idle, F.col("_loose") - 1).otherwise(F.col("_tiles") - 1)
        both = home.withColumn("_k", F.explode(F.when(met >= 0, F.sequence(F.lit(0), met)))).withColumns(
            {
                "tile": F.least("_tile", "_k"),
                "other": F.greatest("_tile", "_k"),
                "role": F.when(F.col("_k") >= F.col("_tile"), 0).otherwise(1),
            }
        ).drop("_k", "_tile")
    else:
        guests = join_frequent(visitors, tiles, group, "_n", total).withColumn("tile", every).withColumn("other", F.lit(0))
        both = home.withColumnRenamed("_tile", "tile").withColumns({"other": F.lit(0), "role": F.lit(0)}).unionByName(guests)
        if among:
            later = home.filter("_tile > 0").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("_tile") - 1))).drop("_tile")
            both = both.unionByName(later.withColumns({"other": F.lit(0), "role": F.lit(1)}))
    first = [*group, "tile", "other", "role"]
    both = both.select(*first, *[c for c in both.columns if c not in first and c not in ("_tiles", "_loose", "_tight", joined)])
    return both.repartition(*group, "tile", "other").sortWithinPartitions(*first)


def tile_visits(batches, keys: int):
    """(homes, visitors) of ``tiled`` rows: record batches of a tile's homes, and a batch of its visitors or, if there
    are none, the homes themselves. ``keys``: columns of group, tile and other; ``role`` follows them."""
    group, homes, visited = None, [], False
    for (*key, role), part in runs(batches, keys + 1):
        if key != group:
            if homes and not visited:
                yield from ((homes, h) for h in homes)
            group, homes, visited = key, [], False
        if role:
            visited = True
            if homes:
                yield homes, part
        else:
            homes.append(part)
    if homes and not visited:
        yield from ((homes, h) for h in homes)
