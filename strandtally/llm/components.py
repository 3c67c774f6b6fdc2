"""Connected components by alternating stars.

Edges are rewired so that each vertex points to the smallest vertex it knows
of; a few rounds of two groupings leave a star for each component. Every round
is written to the shared folder, which ends its lineage.

Edge cases: edges with a null end, and from a vertex to itself, link nothing and
are left out; repeated edges count once; an empty table has no vertices. Rounds
grow with the logarithm of the longest path; beyond ``most_rounds``, far more
than any table of edges needs, that is an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(vertex, root) for each vertex of ``edges``; root is the smallest vertex of its component."""
    paths: list[str] = []
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "edges", paths)
    mark = _mark(e)
    for _ in range(most_rounds):
        # large star: neighbours above a vertex go to the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a vertex and its neighbours below go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, paths = paths, []
        e = stored(below.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges", paths)
        remove(old)  # the round before
        before, mark = mark, _mark(e)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("v", "u"))).first())
