"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a grouped minimum and an equi-join over (a, b) rows; nothing is gathered for a whole
group or on the driver. Each round is a written table, so that lineage stays short and a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpen.llm.base import new_path, remove


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct (a, b) with a > b. Links each node to the least of its neighbourhood instead."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        out = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that occurs in links (columns a and b); root is the least node reachable.

    Self links, repeated links and either direction are accepted; rows with a null end are no links.
    """
    spark = links.sparkSession
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(a.alias("a"), b.alias("b")).distinct()
    before, last = None, ""
    while True:
        path = new_path(spark, "stars")
        edges.write.parquet(path)
        edges = spark.read.schema(edges.schema).parquet(path)
        # the edges are stars when no centre is itself a leaf; the sums tell a fixed point from progress
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last:
            remove(spark, last)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        before, last = now, path
        edges = _star(_star(edges, True), False)
