"""Connected components by alternating stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import written


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the least node ``m`` of their ``u``. The sums' key is derived anew, so the planner shuffles them apart from their aggregation and can split a node with very many edges."""
    return edges.join(least.select(F.concat("u", F.lit("")).alias("__u"), "m"), F.col("u") == F.col("__u")).drop("__u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = _with_least(edges, least)
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of every node that has an edge and is not its component's root.

    ``edges`` has string columns u and v. A round gives each node's larger neighbours to its least one and then
    joins its smaller neighbours to the least of them; it ends when edges no longer change, which is
    after a number of rounds that grows with the logarithm of the longest path.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = written(_pairs(edges), name)
    seen = state(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = written(_pairs(_small_star(_pairs(_large_star(now)))), name)
        if (new := state(now)) == seen:
            break
        seen = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
