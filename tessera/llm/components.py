"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: neighbours above a node move to its least neighbour; small
    star: a node and its neighbours below it do. A node's least neighbour is
    summed before the shuffle, so a hub costs no more than others."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = (moved.where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .unionAll(least.where("u > m").select(F.col("u").alias("a"), F.col("m").alias("b"))))
    return moved.where("a <> b")


def _is_done(edges: DataFrame) -> bool:
    """Whether every node has one edge down, or none and only edges from above."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(
        edges.select(F.col("b").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return (ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
                .where("down > 1 OR down = 1 AND up = 1").isEmpty())


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its
    least node. Loops and repeated edges don't matter, edges with a NULL end are
    left out. Each round is written to the shared folder; the driver sees one
    boolean a round."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_done(now):
        now = cut(_star(_star(now, large=True), large=False).distinct())
    return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
               .unionAll(now.select("b", "b").distinct()))


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it reaches."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label
