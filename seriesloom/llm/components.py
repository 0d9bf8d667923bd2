"""Connected components of a graph that is never held in one place.

Alternating large-star and small-star steps: each is a minimum by node (combined map-side) and one
join. The edges of every round are written to the shared folder (and deleted a round later), so lineage stays short and a lost
executor costs one round at most. The number of rounds grows with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROUNDS = 60


def _star(both: DataFrame, keep) -> DataFrame:
    """Link the neighbours that ``keep`` selects to the least of each node's neighbours and itself."""
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """``edges``: two columns of one orderable type. Returns (node, component): the least node that each reaches.

    Loops and repeats are ignored, and a null end drops its edge; nodes without a link to another
    are not returned. An empty table of edges gives an empty result.
    """
    a, b = edges.columns
    e = edges.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`")
    e = common.materialize(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        # Large star: neighbours above a node go to its least neighbour.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "v > u").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        large = common.materialize(large, "edges")
        common.drop(e)
        # Small star: a node and its lesser neighbours go to the least of these; edges point down already.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = common.materialize(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        common.drop(large)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = common.materialize(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    common.drop(e)
    return out
