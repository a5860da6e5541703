"""Clusters of items with stable ids, versions and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from .components import components

DETAILS = ["item_id", "outlet", "title", "published", "url"]


def group_items(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items with their ``component``; an item without links is its own."""
    return items.join(components(links, items.select("item_id")), "item_id")


def component_sizes(grouped: DataFrame, min_outlets: int = 2) -> DataFrame:
    """``(component, size, outlets, fate)``: kept, single_item or single_outlet."""
    g = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("outlet").alias("outlets"))
    fate = F.when(F.col("outlets") >= min_outlets, "kept").when(F.col("size") < 2, "single_item").otherwise("single_outlet")
    return g.withColumn("fate", fate)


def new_clusters(grouped: DataFrame, min_outlets: int = 2) -> DataFrame:
    """``(cluster_id, component, anchor, anchor_published, size, outlets)`` of components of enough outlets.

    The anchor is the first item by (published, id); its date and hash make the id.
    """
    first = F.min(F.struct("published", "item_id"))
    g = grouped.groupBy("component").agg(first.alias("a"), F.count(F.lit(1)).alias("size"), F.countDistinct("outlet").alias("outlets"))
    return g.where(F.col("outlets") >= min_outlets).select(
        U.cluster_id(F.col("a.item_id"), F.col("a.published")).alias("cluster_id"), "component",
        F.col("a.item_id").alias("anchor"), F.col("a.published").alias("anchor_published"), "size", "outlets",
    )


def separate_ids(made: DataFrame, taken: DataFrame, probes: int = 1000) -> DataFrame:
    """``made`` with ids changed where another cluster has them; the earlier anchor keeps its id.

    Only the ids that collide are looked at again; that many is a handful at any size.
    """
    settled = None
    left = made
    for n in range(probes):
        used = taken.select("cluster_id") if settled is None else taken.select("cluster_id").unionByName(settled.select("cluster_id"))
        rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("anchor_published", "anchor"))
        ranked = left.withColumn("_rank", rank).join(used.distinct().withColumn("_used", F.lit(True)), "cluster_id", "left")
        clash = F.col("_used").isNotNull() | (F.col("_rank") > 1)
        fine = ranked.where(~clash).drop("_rank", "_used")
        settled = fine if settled is None else settled.unionByName(fine)
        left = ranked.where(clash).drop("_rank", "_used").withColumn("cluster_id", U.cluster_id(F.col("anchor"), F.col("anchor_published"), n + 1))
        if not left.limit(1).count():
            return settled
    raise RuntimeError("no free cluster id")


def _signature(members: DataFrame, key: str) -> DataFrame:
    """Size of each group and two sums of its ids' hashes; groups of equal ids are equal in all three."""
    h = F.xxhash64("item_id")
    return members.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.bit_xor(h).alias("h1"), F.sum(F.pmod(F.xxhash64(F.lit(1), "item_id"), F.lit(2**31))).alias("h2"))


def update_clusters(items: DataFrame, links: DataFrame, clusters: DataFrame, members: DataFrame, min_outlets: int = 2) -> tuple[DataFrame, DataFrame]:
    """``(clusters, members)`` after new links; see ``cluster_state``."""
    return cluster_state(items, links, clusters, members, min_outlets)[:2]


def cluster_state(items: DataFrame, links: DataFrame, clusters: DataFrame, members: DataFrame, min_outlets: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(clusters, members, fates)`` after new links; ``fates`` are the components with a fate, ``stored`` where a cluster is touched.

    The clusters are ``(cluster_id, version, status, anchor, anchor_published,
    superseded_by, size, state)``, the members ``(cluster_id, item_id)``: one row an item,
    never a list, since a cluster may grow large. Of the inputs, ``clusters`` has id,
    version, status, anchor and anchor_published, ``members`` one row ``(cluster_id,
    item_id, outlet, published)`` a stored item.

    Membership never shrinks: stored members are linked before anything else. Of the
    clusters that one component touches, the one with the earliest anchor lives on with
    a new version, the others are superseded by it and keep their items. A cluster whose
    members stay the same keeps its version. Components without a cluster become one if
    they have enough outlets. Superseded clusters are never touched again and aren't
    returned.
    """
    live = clusters.where(F.col("status") != "superseded")
    stored = members.join(live.select("cluster_id"), "cluster_id", "left_semi")
    hub = stored.groupBy("cluster_id").agg(F.min("item_id").alias("u"))
    stars = stored.join(hub, "cluster_id").select("u", F.col("item_id").alias("v"))
    # details of an item: the current ones, else those stored
    known = items.select("item_id", "outlet", "published", F.lit(0).alias("_o")).unionByName(stored.select("item_id", "outlet", "published", F.lit(1).alias("_o")))
    known = known.groupBy("item_id").agg(F.min_by(F.struct("outlet", "published"), F.struct("_o", "published", "outlet")).alias("x")).select("item_id", "x.outlet", "x.published")
    grouped = known.join(components(stars.unionByName(links.select("u", "v")), known.select("item_id")), "item_id")

    touched = stored.select("cluster_id", "item_id").join(grouped.select("item_id", "component"), "item_id").select("component", "cluster_id").distinct()
    ranked = touched.join(live, "cluster_id").withColumn("_rank", F.row_number().over(Window.partitionBy("component").orderBy("anchor_published", "cluster_id")))
    winners = ranked.where("_rank = 1").select("component", "cluster_id", "version", "status", "anchor", "anchor_published")
    losers = ranked.where("_rank > 1").join(winners.select("component", F.col("cluster_id").alias("superseded_by")), "component")
    now = _signature(grouped, "component")
    before = _signature(stored.select("cluster_id", "item_id").distinct(), "cluster_id").select("cluster_id", F.col("size").alias("_size"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    merged = losers.select("component").distinct().withColumn("_merged", F.lit(True))
    kept = winners.join(now, "component").join(before, "cluster_id").join(merged, "component", "left")
    changed = F.col("_merged").isNotNull() | (F.col("size") != F.col("_size")) | (F.col("h1") != F.col("_h1")) | (F.col("h2") != F.col("_h2"))
    none = F.lit(None).cast("string")
    shape = ["cluster_id", "version", "status", "anchor", "anchor_published", "superseded_by", "size", "state"]
    kept = kept.select(
        "cluster_id", (F.col("version") + changed.cast("int")).alias("version"), F.when(changed, "pending").otherwise(F.col("status")).alias("status"),
        "anchor", "anchor_published", none.alias("superseded_by"), "size", F.when(changed, "changed").otherwise("same").alias("state"),
    )
    gone = losers.join(before, "cluster_id").select(
        "cluster_id", "version", F.lit("superseded").alias("status"), "anchor", "anchor_published", "superseded_by", F.col("_size").alias("size"), F.lit("superseded").alias("state")
    )
    made = separate_ids(new_clusters(grouped.join(touched.select("component").distinct(), "component", "left_anti"), min_outlets), clusters)
    fresh = made.select("cluster_id", F.lit(1).alias("version"), F.lit("pending").alias("status"), "anchor", "anchor_published", none.alias("superseded_by"), "size", F.lit("new").alias("state"))
    owner = winners.select("component", "cluster_id").unionByName(made.select("component", "cluster_id"))
    after = grouped.select("component", "item_id").join(owner, "component").select("cluster_id", "item_id")
    left = stored.select("cluster_id", "item_id").distinct().join(losers.select("cluster_id"), "cluster_id", "left_semi")
    known_to = touched.select("component").distinct().withColumn("_t", F.lit(True))
    fates = component_sizes(grouped, min_outlets).join(known_to, "component", "left")
    fates = fates.withColumn("fate", F.when(F.col("_t").isNotNull(), "stored").otherwise(F.col("fate"))).drop("_t")
    return kept.select(shape).unionByName(gone.select(shape)).unionByName(fresh.select(shape)), after.unionByName(left), fates


def pending_mirror(clusters: DataFrame, mirrored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(insert, remove)``: pending clusters that the mirror lacks, and mirrored ids that are pending no more."""
    now = clusters.where(F.col("status") == "pending")
    return now.join(mirrored.select("cluster_id").distinct(), "cluster_id", "left_anti"), mirrored.select("cluster_id").distinct().join(now.select("cluster_id"), "cluster_id", "left_anti")


def pending_queue(clusters: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending clusters, oldest anchor first."""
    q = clusters.where(F.col("status") == "pending").orderBy("anchor_published", "cluster_id")
    return q if limit is None else q.limit(limit)


def backfill_urls(members: DataFrame, items: DataFrame) -> DataFrame:
    """Members with an empty address take that of their item; nothing else changes."""
    known = items.groupBy(F.col("id").alias("item_id")).agg(F.max("url").alias("_url"))
    return members.join(known, "item_id", "left").withColumn("url", F.coalesce(F.nullif("url", F.lit("")), F.col("_url"), F.lit(""))).drop("_url")
