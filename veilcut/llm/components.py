"""Connected components, distributed: alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least member of the component of each of n nodes (arrays within one task)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, root the least node of its component.

    edges: (u, v) of one orderable type; loops, repeats and either direction are allowed.  Each round
    is two aggregations and two joins on nodes (a hub's rows are split by adaptive execution), written to
    the shared folder; rounds grow with the logarithm of the largest component, and no links change once every
    node points to its root, so the loop ends.  Only two sums a round come to the driver.
    """
    e = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a <> b").distinct()
    e = written(e, "links", small=True)
    sign = None
    while True:
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
        # a table of its own, so that the rows of a hub are dealt by an exchange that adaptive execution can split
        least = written(both.groupBy("x").agg(F.least("x", F.min("y")).alias("m")), "links", small=True)
        large = both.join(least, "x").where("y > x").select(F.col("m").alias("a"), F.col("y").alias("b")).where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        e = written(small.unionByName(low.select(F.col("m").alias("a"), "b")).distinct(), "links", small=True)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == sign:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        sign = now
