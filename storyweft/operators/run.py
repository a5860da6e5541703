"""One run from items and vectors to clusters, pairs to judge and counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times as D
from ..sources.readers import ClusterSettings, vectors_of
from . import clusters as C
from .dedupe import latest_by_id
from .feeds import partition
from .pairs import comparable, route, score_pairs


@dataclass(frozen=True)
class ClusterRun:
    """What a run gives: clusters and their members, pairs between the thresholds, pairs for samples, and one row of counters."""

    clusters: DataFrame
    members: DataFrame
    borderline: DataFrame
    sample: DataFrame
    stats: DataFrame


def run_clustering(
    items: DataFrame, vectors: DataFrame, model: str, stored: DataFrame, stored_members: DataFrame, settings: ClusterSettings, now: str,
    promotional: Column, accepted: DataFrame | None = None,
) -> ClusterRun:
    """Cluster the items of the window before ``now`` against the stored clusters.

    The newest row of each item counts; promotional items take no part. Pairs of one
    model's vectors that score ``tau_high`` are linked, and so are the ``accepted``
    links ``(u, v)`` of judges, whatever they score; an accepted link may lead over an
    item that is not in the window. ``stored`` and ``stored_members`` are as in
    ``cluster_state``. Items whose vectors have another length than most are counted
    apart from those without a usable vector.
    """
    spark = items.sparkSession
    window = latest_by_id(items.where(F.col("published") >= D.window_start(now, settings.window_days)))
    news, _ = partition(window, promotional)
    news = news.select(F.col("id").alias("item_id"), "outlet", "published")
    own = vectors_of(vectors, model, news)
    usable = comparable(own)
    scored = route(score_pairs(usable, min(settings.sample_floor, settings.tau_low)), settings.tau_low, settings.tau_high, settings.sample_floor)
    extra = accepted.select("u", "v").distinct() if accepted is not None else spark.createDataFrame([], "u string, v string")
    links = scored.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(extra)
    after, members, fates = C.cluster_state(news, links, stored, stored_members, settings.min_outlets)
    one = lambda df, *counts: df.agg(*counts)
    some = own.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))).select("item_id").distinct()
    n = F.count(F.lit(1))
    parts = [
        one(news, n.alias("window_items")), one(some, n.alias("_some")), one(usable, n.alias("_usable")),
        one(scored, F.count_if("linked").alias("_linked"), F.count_if("borderline").alias("borderline_pairs")), one(extra, n.alias("_extra")),
        one(fates, n.alias("components"), F.count_if(F.col("fate") == "single_item").alias("dropped_single_item"), F.count_if(F.col("fate") == "single_outlet").alias("dropped_single_outlet")),
        one(after, F.count_if(F.col("state") != "superseded").alias("clusters_total"), F.count_if(F.col("state") == "new").alias("clusters_new"),
            F.count_if(F.col("state") == "changed").alias("clusters_requeued"), F.count_if(F.col("state") == "superseded").alias("clusters_superseded")),
    ]
    stats = parts[0]
    for p in parts[1:]:
        # one row each
        stats = stats.join(F.broadcast(p))
    stats = stats.select(
        "window_items", (F.col("window_items") - F.col("_some")).alias("items_without_vectors"), (F.col("_some") - F.col("_usable")).alias("items_skipped_dim_mismatch"),
        (F.col("_linked") + F.col("_extra")).alias("linked_pairs"), "borderline_pairs", "components", "clusters_total", "clusters_new", "clusters_requeued", "clusters_superseded",
        "dropped_single_item", "dropped_single_outlet",
    )
    return ClusterRun(after, members, scored.where("borderline"), scored.where("sample"), stats)
