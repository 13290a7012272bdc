"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlens.session import written_table


def _jump(parents: DataFrame) -> DataFrame:
    """Follows parents until every node points at a root. ``parents``: node, root with root < node."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = written_table(
            parents.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")),
            "graph-jump",
        )
        parents = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the smallest node it reaches.

    Each round hooks every node to its smallest neighbour, follows the chains, and goes on with the
    edges between different roots. The edges shrink each round. Minima combine before the shuffle,
    and joins on a much linked node read written tables, so that Spark can split them.
    """
    edges = written_table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "graph-edges",
    )
    total = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        down = edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
        hooked = written_table(both.unionByName(down).groupBy("node").agg(F.min("root").alias("root")), "graph-hooks")
        roots = _jump(hooked.where("root < node"))
        # nodes that are roots so far are their own
        step = written_table(
            hooked.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "graph-roots",
        )
        if total is None:
            total = step
        else:
            up = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
            total = written_table(total.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "graph-total")
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = written_table(
            edges.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "graph-edges",
        )
    if total is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return total
