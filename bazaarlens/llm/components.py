"""Connected components of links, as alternating star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Link larger neighbours of each node to the least node it sees."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return (
        joined.where("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes that have a link to another: component is the least node reached.

    links: two columns of numbers. Rounds grow with the logarithm of the longest chain; each ends
    with a reliable checkpoint. Nulls and links of a node to itself are ignored.
    """
    edges = links.toDF("a", "b").where("a <> b")
    edges = checkpointed(_small_star(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    before = None
    for _ in range(most_rounds):
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = mark
        edges = checkpointed(_small_star(_large_star(edges)))
    raise RuntimeError("components did not settle")
