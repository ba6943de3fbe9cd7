"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebrook.llm.scratch import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node goes to the least node around it."""
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours go to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    moved = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.toDF("a", "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, label`` of every node of ``links(a, b)``: the least node it can reach.

    Each round is written to the shared folder, so lineage stays short and a
    lost executor costs at most a round. Links are moved, never multiplied, and
    minima are pre-aggregated, so a node with very many links is no hot group.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, path = written(edges.distinct(), "links")
    state = None
    while True:
        moved, new_path = written(_small_star(_large_star(edges)), "links")
        row = moved.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(spark, path)
        edges, path = moved, new_path
        if tuple(row) == state or row[0] == 0:
            break
        state = tuple(row)
    centres = edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).union(centres)
