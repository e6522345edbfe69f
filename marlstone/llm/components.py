"""Connected components by alternating large stars and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, written


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(least, "a").select("m", F.col("b").alias("v")).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Edges have a < b. A node and its smaller neighbours point to the least of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether a node has two edges to lesser ones, or stands in the middle: else each component is a star around its least."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("lesser"), F.lit(0).alias("greater"))
    ends = ends.unionByName(edges.select(F.col("a").alias("node"), F.lit(0).alias("lesser"), F.lit(1).alias("greater")))
    return not ends.groupBy("node").agg(F.sum("lesser").alias("n"), F.max("greater").alias("g")).where("n > 1 or n = 1 and g = 1").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """node, component for every node of the edges (a, b) but the components' least nodes; component is the least node.

    Loops and repeated edges do no harm, null ends are passed over. No edges give no rows. Rounds grow with the
    logarithm of the longest path; a node of many neighbours is aggregated before it is shuffled and joined in splits.
    Each round is a written table; the result reads the last one, the only one that stays.
    """
    edges, before = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), []
    while True:
        edges = written(_small(_large(edges)))
        forget(*before)
        before = [edges]
        if not _unfinished(edges):
            out = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
            out.stored_at = edges.stored_at
            return out
