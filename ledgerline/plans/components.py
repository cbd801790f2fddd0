"""Connected components by alternating large-star and small-star steps.

The published MapReduce scheme (Kiveris et al., 2014): every step rewires edges
towards the smallest neighbour, so no step gathers a component in one task.
Minima are partial aggregates and the rewiring joins are plain equi-joins that
adaptive execution may split, so a node with a third of all edges is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.materialise import discard, materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)`` for every node of ``edges``; component is the smallest node reached.

    Self loops and null ends are ignored (a node seen only in those is absent).
    An empty edge table gives an empty result. Each step's edges are written to the
    shared folder, which cuts the lineage, and deleted once the next ones are there.
    """
    kind = edges.schema[left].dataType
    a, b = F.greatest(left, right), F.least(left, right)
    current = materialise(edges.select(a.alias("a"), b.alias("b")).filter("a > b").distinct(), "edges")
    before = _state(current)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .filter("a > b").distinct()
        )
        following = materialise(small, "edges")
        discard(current)
        current = following
        after = _state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("component")).union(
        roots.select(F.col("node"), F.col("node"))
    )
