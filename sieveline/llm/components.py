"""Connected components of a table of links, by contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sieveline.sources.shared import written

LINKS_PER_TASK = 200_000


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of the links (a, b), whose nodes are ordered.

    Each round, every node moves to the smallest of its neighbours and itself, and the links move with their ends;
    links within one node vanish. A link leads to each node's target, so what was connected stays so, and at least half the
    nodes that are left go in a round. Minima are grouped in each task first, so a node with very many links is no
    burden. Every round is a written table, so a lost executor costs at most one round.
    """
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # As many tasks as the counted links need: a round of few links is not cut into hundreds of files.
    tasks = -(-edges.count() // LINKS_PER_TASK) + 1
    found = None
    while found is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")).coalesce(tasks))
        to_a = moves.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        to_b = moves.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("to_a != to_b")
        edges = written(moved.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct().coalesce(tasks))
        found = moves.withColumnRenamed("to", "component") if found is None else placed(found, moves.withColumnRenamed("to", "component"))
    return found


def placed(classes: DataFrame, later: DataFrame) -> DataFrame:
    """The classes (node, component) after their components were joined by later ones, which may bring nodes of their own."""
    to = later.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return classes.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes after more links (a, b), which are followed between classes only."""
    of = lambda end: classes.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = written(components(written(between.where("a != b").distinct())))
    fresh = merged.join(classes.select("node"), "node", "left_anti")
    return placed(classes, merged).unionByName(fresh)
