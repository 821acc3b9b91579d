"""Connected components of a graph that is only ever a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom.session import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node of the component) for every node of ``edges`` (``u, v`` longs).

    Alternates large-star and small-star steps until every node points at the smallest of its component. Each step is a
    partial aggregate and a join whose right side is unique, so a node with very many links can be split. Rounds are
    written, so a lost executor does not repeat the ones before.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = cut_lineage(edges, "edges"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == before or not state[0]:
            break
        before = state
        edges = cut_lineage(small_star(large_star(edges)), "edges")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def large_star(edges: DataFrame) -> DataFrame:
    """Neighbours above a node move to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
