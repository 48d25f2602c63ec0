"""Connected components of an edge table by alternating star contraction.

Every round is two joins over the edges alone and is written to shared
storage, so a lost executor costs one stage and nothing gathers at the
driver but two counters.  Hubs are safe: neighbour minima are combined
before the shuffle and the joins carry one row per node on one side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    return both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and the node, to the smallest."""
    low = edges.groupBy("src").agg(F.min("dst").alias("low"))
    moved = edges.join(low, "src").where("dst != low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.unionByName(low.select("src", F.col("low").alias("dst"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(src, dst))"), F.max("dst")).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``src``, ``dst`` long) but the roots.

    root is the smallest node that can be reached.  Loops, repeated edges and
    either direction are fine; rows with a null end are ignored; no edges
    give no rows.
    """
    a, b = F.greatest("src", "dst"), F.least("src", "dst")
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src != dst").select(a.alias("src"), b.alias("dst")).distinct()
    edges = stored(edges, "edges")
    before = _signature(edges)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        edges = stored(_small_star(_large_star(edges)), "stars")
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
