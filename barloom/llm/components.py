"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that can reach a smaller one; root is the smallest that it can reach.

    Each round is checkpointed in the shared folder. The join of a node's links with its smallest neighbour has
    unique keys on one side, so Spark can split the links of a node with very many.
    """
    ends = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = checkpointed(edges.where(F.col(a) != F.col(b)).select(*ends).distinct())
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        if (after := _mark(now)) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = after


def _mark(edges: DataFrame):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def node_of(name, mark):
    """The node of a class: its smallest id, or a number from 2^62 on, drawn from its mark, where all its ids are null."""
    return F.coalesce(name.cast("long"), mark.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))


def with_component(classes: DataFrame, links: DataFrame, name: str, nameless: bool) -> DataFrame:
    """classes (with node, and name, null where node isn't an id) with component_id, the smallest id that links lead to.

    Null where no class of the component has an id; nameless says whether there may be classes without one. Where there
    are, ids must be below 2^62.
    """
    rooted = classes.join(connected_components(links), "node", "left").withColumn("component_id", F.coalesce("root", "node")).drop("root")
    if not nameless:
        return rooted
    without = classes.where(F.col(name).isNull()).select(F.col("node").alias("_nameless"))
    found = rooted.join(without, F.col("component_id") == F.col("_nameless"), "left")
    return found.withColumn("component_id", F.when(F.col("_nameless").isNull(), F.col("component_id"))).drop("_nameless")
