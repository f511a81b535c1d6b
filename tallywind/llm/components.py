"""Connected components by alternating large-star and small-star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its least neighbour to the larger (or the other smaller) neighbours.
    The least neighbour is a combined minimum; the join is split by Spark where a node is hot."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "of")
    both = edges.join(least, F.col("a") == F.col("of"))
    if large:
        out = both.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b); a component is named by its least id."""
    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "cc-edges")
    mark = None
    while True:
        edges = store(_step(store(_step(edges, True), "cc-large"), False), "cc-small")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == now:
            break
        mark = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
