"""Connected components of a link table, by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.durable import stored
from corpusprep.llm.bitmap import few


def _roots(parents: DataFrame, small: bool) -> DataFrame:
    """``a, b``: every node ``a`` of a forest of parents ``b``, with its root in the parent's place."""
    while True:
        above = parents.select(F.col("a").alias("b"), F.col("b").alias("above"))
        parents = stored(
            parents.join(F.broadcast(above) if small else above, "b", "left")
            .select("a", F.coalesce("above", "b").alias("b"), F.col("above").isNotNull().alias("moved"))
        )
        moved = parents.agg(F.bool_or("moved")).first()[0]
        parents = parents.select("a", "b")
        if not moved:
            return parents


def _renamed(rows: DataFrame, column: str, roots: DataFrame, small: bool) -> DataFrame:
    """The rows with the root of ``column``, if it has one, in its place."""
    root = roots.select(F.col("a").alias("_node"), F.col("b").alias("_root"))
    joined = rows.join(F.broadcast(root) if small else root, F.col(column) == F.col("_node"), "left")
    return joined.withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b`` (bigint): the smallest node reachable.

    Every round hangs each node on its smallest neighbour, if that is smaller, finds the roots of
    these trees by doubling the steps, and goes on with the links between roots; every tree has two
    nodes at least, so rounds grow with the logarithm of the nodes.  Minima are partial aggregates
    and other steps are joins, so a node with very many links is no burden for one task.  Few links
    are joined without a shuffle.
    """
    links = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    found = links.limit(0)
    rounds = 0
    while n := links.count():
        small = few(n)
        roots = _roots(stored(links.groupBy("a").agg(F.min("b").alias("b"))), small)
        found = stored(_renamed(found, "b", roots, small).unionAll(roots)) if rounds else roots
        both = _renamed(_renamed(links, "a", roots, small), "b", roots, small).filter("a <> b")
        links = stored(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        rounds += 1
    tops = found.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(tops)
