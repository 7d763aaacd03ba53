"""Connected components as a loop of DataFrame joins (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an edge; the root is the smallest node that is reachable.

    Nodes may be of any orderable type.  Self-loops, nulls and repeated edges are dropped.  No links
    leave the cluster: the driver sees two numbers a round.  A node with very many edges is
    aggregated before its shuffle; the join that follows is an inner equi-join that AQE can split.
    """
    u, v = F.col("u"), F.col("v")
    e, path = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (u != v))
        .distinct()
    )
    seen = _digest(e)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = e.union(e.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(u.alias("u"), F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("x"))
        e, path = written(small.select("x.u", "x.v").where(u != v).distinct(), path)
        now = _digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(u.alias("node"), v.alias("root")).union(e.select(v.alias("node"), v.alias("root")).distinct())


def _digest(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
