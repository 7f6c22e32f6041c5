"""Connected components by alternating large-star and small-star steps (Kiveris et al., Connected Components in MapReduce
and Beyond, 2014). No node's neighbours are ever gathered: each step is an aggregate and an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _settled(edges: DataFrame) -> bool:
    """Each node has one neighbour, which has none: the edges are stars around the smallest nodes."""
    centres = edges.select(F.col("v").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("m")).distinct()
    ends = edges.select(F.col("u").alias("n"), F.lit(0).alias("c"), F.lit(1).alias("m"))
    return ends.unionByName(centres).groupBy("n").agg(F.sum("m").alias("m"), F.max("c").alias("c")).where("m > 1 or (m > 0 and c > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). One row (u, v) for each node u that is not the smallest of its component; v is the smallest."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        edges = materialize(edges, "large")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        met = edges.join(least, "u")
        edges = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        edges = materialize(edges, "small")
    return edges
