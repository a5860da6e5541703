"""Problem 1: pairwise matches into groups.

The giant component is peeled by breadth-first joins from the vertex of highest
degree and anti-joined away; what is left are small components, labelled by
minimum propagation with hooking and shortcutting, so that a chain of n links
takes about log2(n) rounds and not n.

Ids are replaced once by dense, order-preserving longs: every later shuffle
moves 16 bytes an edge, and the smallest label is the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import label_components
from ..workspace import Workspace

#: Characters counted as blanks around an id.
BLANKS = " \t\n\r\x0b\x0c "


def clean_id(c: Column) -> Column:
    """Id without outer blanks and letter case."""
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def match_links(pairs: DataFrame, judgments: DataFrame, min_score: float = 0.80) -> DataFrame:
    """Links ``(u, v)``, u < v, distinct, of scored pairs and positive judgments.

    NULL and NaN scores, NULL answers, NULL or blank ids and links of an id with
    itself give no link. Other columns of the inputs are ignored.
    """
    scored = pairs.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") >= min_score)).select(
        clean_id(F.col("a")).alias("x"), clean_id(F.col("b")).alias("y")
    )
    judged = judgments.where(F.col("same_story")).select(
        clean_id(F.col("item_id_a")).alias("x"), clean_id(F.col("item_id_b")).alias("y")
    )
    return (
        scored.unionByName(judged)
        .where((F.col("x") != F.col("y")) & (F.col("x") != "") & (F.col("y") != ""))
        .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
        .distinct()
    )


def connected_groups(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(group_id, item_id)`` of string links ``(u, v)``; group_id is the smallest member.

    Repeated links, either direction and self links are allowed (an id whose only
    link is to itself is not returned). No links give no rows. The work tables
    stay in the shared folder for as long as the result is read.
    """
    spark = links.sparkSession
    work = Workspace(spark, "groups")
    raw = work.stage(links.where(F.col("u") != F.col("v")).select("u", "v"), "links")

    # dense ids in id order: range partitions, then a running number in each
    ids = raw.select(F.explode(F.array("u", "v")).alias("item_id")).distinct()
    ids = ids.repartitionByRange("item_id").sortWithinPartitions("item_id")
    names = work.stage(ids.withColumn("n", F.monotonically_increasing_id()), "names")

    edges = (
        raw.join(names.select(F.col("item_id").alias("u"), F.col("n").alias("s")), "u")
        .join(names.select(F.col("item_id").alias("v"), F.col("n").alias("t")), "v")
        .select(F.explode(F.array(F.struct("s", "t"), F.struct(F.col("t").alias("s"), F.col("s").alias("t")))).alias("e"))
        .select("e.s", "e.t")
    )
    edges = work.stage(edges, "edges")
    work.drop(raw)

    core, low, boundary = _peel(work, edges, max_rounds)
    rest = edges
    if core is not None:
        rest = edges.join(core.select(F.col("n").alias("s")), "s", "left_anti")
        if boundary is not None:
            # links that lead out of an unfinished core are kept, with the core as one vertex
            rest = rest.join(core.select(F.col("n").alias("t")), "t", "left_anti").select("s", "t").unionByName(boundary)
        rest = work.stage(rest.select("s", "t"), "rest")
    labels = label_components(work, rest, max_rounds)
    if core is not None:
        root = low
        if boundary is not None:
            joined = labels.where(F.col("n") == low).select("root").first()
            root = low if joined is None else joined[0]
            labels = labels.where(F.col("n") != low)
        labels = labels.unionByName(core.select("n", F.lit(root).cast("long").alias("root")))
    members = labels.join(names, "n")
    heads = names.select(F.col("n").alias("root"), F.col("item_id").alias("group_id"))
    return members.join(heads, "root").select("group_id", "item_id")


def _peel(work: Workspace, edges: DataFrame, max_rounds: int) -> tuple[DataFrame | None, int | None, DataFrame | None]:
    """Vertices reached from the busiest one, the smallest of them, and the links out of them if the search was not finished.

    The search goes on while the frontier is a fair share of what was reached.
    A long thin tail would cost a round for each link; it is left, with the core
    contracted to one vertex, to the propagation, which takes log2 of its length.
    """
    hub = edges.groupBy("s").count().agg(F.max_by("s", F.struct("count", F.col("s") * -1))).first()[0]
    if hub is None:
        return None, None, None
    spark = edges.sparkSession
    front = spark.createDataFrame([(hub,)], "n long")
    layers, reached, thin = [work.stage(front, "layer")], 1, 0
    for _ in range(max_rounds):
        seen = _union(layers)
        step = (
            edges.join(layers[-1].select(F.col("n").alias("s")), "s", "left_semi")
            .select(F.col("t").alias("n"))
            .distinct()
            .join(seen, "n", "left_anti")
        )
        step = work.stage(step, "layer")
        grown = step.count()
        if not grown:
            core = work.stage(_union(layers), "core")
            return core, core.agg(F.min("n")).first()[0], None
        layers.append(step)
        reached += grown
        thin = thin + 1 if grown * 50 < reached else 0
        if thin >= 2 or (len(layers) > 6 and reached < 64):
            break
    core = work.stage(_union(layers), "core")
    low = core.agg(F.min("n")).first()[0]
    inside = core.select(F.col("n").alias("s"))
    out = edges.join(inside, "s", "left_semi").join(core.select(F.col("n").alias("t")), "t", "left_anti")
    out = out.select("t").distinct()
    both = out.select(F.explode(F.array(F.struct(F.lit(low).cast("long").alias("s"), F.col("t")), F.struct(F.col("t").alias("s"), F.lit(low).cast("long").alias("t")))).alias("e"))
    return core, low, both.select("e.s", "e.t")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
