"""Connected components of links as an iterative DataFrame loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace


def label_components(work: Workspace, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(n, root)`` for every vertex of the symmetric ``edges``, root the smallest of its component."""
    labels = work.stage(edges.groupBy(F.col("s").alias("n")).agg(F.least(F.min("t"), F.col("s")).alias("f")), "labels")
    for _ in range(max_rounds):
        # smallest label next to each vertex; the vertex and the vertex it points to both take it over
        near = (
            edges.join(labels.select(F.col("n").alias("t"), F.col("f").alias("g")), "t")
            .groupBy(F.col("s").alias("n"))
            .agg(F.min("g").alias("g"))
        )
        told = labels.join(near, "n").select("n", "f", "g")
        told = work.stage(told, "told")
        hooks = told.groupBy(F.col("f").alias("n")).agg(F.min("g").alias("h"))
        hung = told.join(hooks, "n", "left").select("n", F.least("f", "g", "h").alias("p"))
        hung = work.stage(hung, "hung")
        jumped = (
            hung.join(hung.select(F.col("n").alias("p"), F.col("p").alias("q")), "p")
            .join(labels.select("n", F.col("f").alias("old")), "n")
            .select("n", F.least("p", "q").alias("f"), "old")
        )
        after = work.stage(jumped, "labels")
        moved = after.where(F.col("f") != F.col("old")).limit(1).count()
        work.drop(told, hung, labels)
        labels = after
        if not moved:
            return labels.select("n", F.col("f").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(item_id, component)`` of links ``(u, v)``; the component is its smallest id.

    ``nodes`` (``item_id``) adds ids without a link, each a component of its own. NULL
    ids are left out; repeated, reversed and self links are allowed.
    """
    work = Workspace(links.sparkSession, "components")
    pairs = work.stage(links.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select("u", "v"), "links")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("item_id"))
    if nodes is not None:
        ids = ids.unionByName(nodes.where(F.col("item_id").isNotNull()).select("item_id"))
    # numbers in the order of the ids, so that the smallest label is the smallest id
    ids = ids.distinct().repartitionByRange("item_id").sortWithinPartitions("item_id")
    names = work.stage(ids.withColumn("n", F.monotonically_increasing_id()), "names")
    number = lambda id_, n: names.select(F.col("item_id").alias(id_), F.col("n").alias(n))
    edges = pairs.join(number("u", "s"), "u").join(number("v", "t"), "v").select("s", "t")
    # an id is linked to itself, so that one without links is labelled too
    loops = names.select(F.col("n").alias("s"), F.col("n").alias("t"))
    both = work.stage(edges.unionByName(edges.select(F.col("t").alias("s"), F.col("s").alias("t"))).unionByName(loops).distinct(), "edges")
    labels = label_components(work, both)
    return labels.join(names, "n").join(number("component", "root"), "root").select("item_id", "component")
