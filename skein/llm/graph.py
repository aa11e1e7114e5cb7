"""Connected components of links between numbered nodes, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """node, class (the smallest node that links lead to) for the nodes of the links (a, b)."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # Large star: a node's larger neighbours move to the smallest node around it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following = materialise(small, "edges")
        discard(edges)
        edges = following
        # Done when every node points at one other, and that one at none.
        ends = edges.groupBy("u").agg(F.count("*").alias("n")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("n")).distinct())
        if ends.groupBy("u").agg(F.count("*").alias("roles"), F.max("n").alias("n")).where("roles > 1 or n > 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("class"))


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes of all nodes after further links: only the links' own classes, as nodes, are connected anew."""
    of = lambda end: classes.select(F.col("node").alias(end), F.col("class").alias(f"c{end}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = components(between).select(F.col("node").alias("class"), F.col("class").alias("to"))
    old = classes.join(moved, "class", "left").select("node", F.coalesce("to", "class").alias("class"))
    # A node that no link had named before is its own class, and moves by itself.
    new = moved.select(F.col("class").alias("node"), F.col("to").alias("class")).join(classes.select("node"), "node", "left_anti")
    return materialise(old.unionByName(new), "classes")
