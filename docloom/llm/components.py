"""Connected components of a link table, on the executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.scratch import materialize, scratch_scope


def _jumped(parents: DataFrame) -> DataFrame:
    """Follow the parents of (id, parent) up to their roots, doubling the reach with every step."""
    while True:
        up = parents.select(F.col("id").alias("_id"), F.col("parent").alias("_up"))
        joined = materialize(
            parents.join(up, F.col("parent") == F.col("_id"), "left").select(
                "id", F.coalesce("_up", "parent").alias("parent"), (F.coalesce("_up", "parent") != F.col("parent")).alias("moved")
            ),
            "jump",
        )
        moved = not joined.filter("moved").isEmpty()
        parents = joined.select("id", "parent")
        if not moved:
            return parents


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``_components`` without the tables of its rounds."""
    with scratch_scope(links.sparkSession) as keep:
        return keep(_components(links, a, b))


def _components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id in ``links``; component is the smallest id reachable.

    Rounds of hooking and contraction: each id takes its smallest neighbour as parent if that is smaller,
    parents are followed to their roots, and the links are rewritten to roots. The smallest of a component never
    hooks, and each round leaves at most half of the ids of a component that still has links, so rounds grow with
    the logarithm of the largest component. Minima are pre-aggregated, so the centre of a large star costs a row
    for each task; tables between rounds are written to the shared folder. Null ids and links of an id to itself
    are left out. No links: an empty result.
    """
    edges = links.select(F.least(a, b).cast("long").alias("lo"), F.greatest(a, b).cast("long").alias("hi"))
    edges = materialize(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("lo < hi").distinct(), "edges")
    found: DataFrame | None = None
    while found is None or not edges.isEmpty():
        near = edges.select(F.col("hi").alias("id"), F.col("lo").alias("n")).unionAll(edges.select("lo", "hi"))
        parents = near.groupBy("id").agg(F.min("n").alias("n")).select("id", F.least("id", "n").alias("parent"))
        parents = _jumped(materialize(parents, "parents"))
        if found is None:
            found = parents
        else:
            nxt = parents.select(F.col("id").alias("_id"), F.col("parent").alias("_up"))
            found = materialize(
                found.join(nxt, F.col("parent") == F.col("_id"), "left").select("id", F.coalesce("_up", "parent").alias("parent")),
                "found",
            )
        lo = parents.select(F.col("id").alias("lo"), F.col("parent").alias("plo"))
        hi = parents.select(F.col("id").alias("hi"), F.col("parent").alias("phi"))
        moved = edges.join(lo, "lo").join(hi, "hi")
        edges = materialize(
            moved.filter("plo != phi").select(F.least("plo", "phi").alias("lo"), F.greatest("plo", "phi").alias("hi")).distinct(),
            "edges",
        )
    return found.select("id", F.col("parent").alias("component"))
