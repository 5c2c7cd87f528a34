"""Connected components of a link table by alternating large and small stars.

Each round joins every node with the smallest neighbour its group knows; rounds end when the
table of (node, root) no longer changes, after about log(nodes) of them. All state stays in
tables; a round's table is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import use_checkpoint_dir


def _state(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select("b", "a"))
    root = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
    return (both.join(root, "a").where("b > a").select(F.col("b").alias("a"),
                                                      F.col("root").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    root = edges.groupBy("a").agg(F.min("b").alias("root"))
    moved = (edges.join(root, "a").where("b <> root")
             .select(F.col("b").alias("a"), F.col("root").alias("b")))
    return moved.union(root.select("a", F.col("root").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is its smallest node.

    Self links and repeated links are allowed; nodes must not be null.
    """
    use_checkpoint_dir(edges.sparkSession)
    edges = edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    seen = None
    while (state := _state(edges)) != seen:
        seen = state
        edges = _small_star(_large_star(edges)).checkpoint()
    roots = edges.select("b").distinct()
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(roots.select(F.col("b").alias("node"), F.col("b").alias("component"))))
