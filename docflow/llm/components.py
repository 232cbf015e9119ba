"""Connected components by alternating large-star and small-star, as DataFrame steps.

Each step is a grouped minimum and a join; its result is a table in the shared folder, so a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.shared import discard, materialize


def _least(near: DataFrame) -> DataFrame:
    return materialize(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")


def _large(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """both(u, v), in both directions. Every greater neighbour gets the least of the node and its neighbours."""
    least = _least(both)
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The node and its smaller neighbours get the least of them."""
    near = both.where("v < u")
    least = _least(near)
    return near.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))), least


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node that has a link. links: a, b (long); loops and repeats do no harm.

    A table in the shared folder; the tables of its rounds are deleted as soon as the next one stands.
    """
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star-edges")
    mark, now = None, _mark(edges)
    while now != mark:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars, least = _large(both)
        lifted = materialize(stars.where("u != v").distinct(), "star-large")
        discard(least, edges)
        both = lifted.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        stars, least = _small(both)
        edges = materialize(stars.where("u != v").distinct(), "star-small")
        discard(least, lifted)
        mark, now = now, _mark(edges)
    roots = edges.select(F.col("v").alias("node")).distinct()
    found = materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node"))), "star-labels")
    discard(edges)
    return found
