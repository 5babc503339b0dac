"""Connected components of an edge table.

Alternating large-star and small-star steps (Kiveris, Lattanzi, Mirrokni, Rastogi,
Vassilvitskii, SoCC 2014): every step points nodes at the least neighbour seen, so the
edge table shrinks towards one star for each component. Long chains need a logarithmic
number of rounds, not one for each hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.scratch import cut


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node points at one root, and no root points anywhere."""
    children = edges.select(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("root"))
    roots = edges.select(F.col("v").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("root"))
    roles = children.unionByName(roots).groupBy("id").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return roles.where((F.col("child") > 1) | ((F.col("child") > 0) & (F.col("root") > 0))).isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of every node that has an edge to another; component is the least id in it.

    ``src`` and ``dst`` hold orderable ids. Rows with a null end and loops are left out,
    repeated edges count once, and an empty table gives an empty result. The loop's state
    is an edge table in the shared folder; one answer a round reaches the driver, whether
    stars are all that is left; edges that are stars from the start need no round. The
    minima of each step are a table of their own, so that joins on a node with very many
    edges can be split at run time.
    """
    a, b = F.col(src), F.col(dst)
    state = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _is_star_forest(state):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least")), "least")
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct(), "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("least")), "least")
        small = large.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        state = cut(small.unionByName(least.select("u", F.col("least").alias("v"))).distinct(), "edges")
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
