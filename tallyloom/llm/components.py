"""Connected components by contraction: joins and groupings only.

Every node goes to the smallest of itself and its neighbours, twice along the way;
links are rewritten to where their ends went. A component is done when no link is
left; its root is its smallest node. Each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.store import materialize


def components(links: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root) for every node of a link."""
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "cc-links")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    where = nodes.withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("p"))
        up = materialize(up, "cc-up")
        next_up = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
        up = materialize(up.join(next_up, "p", "left").select("a", F.coalesce("q", "p").alias("p")), "cc-jump")
        where = where.join(up.withColumnRenamed("a", "root"), "root", "left")
        where = materialize(where.select("node", F.coalesce("p", "root").alias("root")), "cc-nodes")
        edges = edges.join(up, "a").select("b", F.col("p").alias("pa"))
        edges = edges.join(up.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        edges = edges.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = materialize(edges.distinct(), "cc-links")
    return where
