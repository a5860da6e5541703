"""Stratified samples and review queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import vectors as V
from .judging import judge_queue, unanswered
from .ranking import numbered


def label_sample(pairs: DataFrame, already: DataFrame, floor: float, width: float, cap: int) -> DataFrame:
    """Pairs of each score bucket with the smallest ids, as many as the bucket still lacks.

    Pairs of one outlet, below the floor or sampled before are no candidates. What
    is in ``already`` counts towards the cap and is never evicted.
    """
    bucket = V.sample_bucket(F.col("score"), floor, width)
    have = already.withColumn("bucket", bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("have"))
    pool = pairs.where((F.col("outlet_a") != F.col("outlet_b")) & (F.round("score", 6) >= floor)).withColumn("bucket", bucket)
    pool = pool.join(already.select("pair_id").distinct(), "pair_id", "left_anti")
    ranked = pool.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy("pair_id"))).where(F.col("rn") <= cap)
    return ranked.join(have, "bucket", "left").where(F.col("rn") <= cap - F.coalesce("have", F.lit(0))).drop("have", "rn")


def labelling_order(pairs: DataFrame, tau_low: float, tau_high: float, buckets: int = 8) -> DataFrame:
    """``pairs`` with ``bucket``, ``turn`` and ``place``: round-robin over equal slices of [tau_low, tau_high), high scores first.

    Scores outside go to the nearest slice; one slice if the two are equal. ``turn``
    counts within a slice, ``place`` (from 1) over all.
    """
    b = pairs.withColumn("bucket", V.spread_bucket(F.col("score"), F.lit(float(tau_low)), F.lit(float(tau_high)), buckets))
    turns = numbered(b, "bucket", "score", "pair_id", "turn")
    # the sizes of the slices are one row
    sizes = b.where(F.col("score").isNotNull()).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("bucket", "n")).alias("_sizes"))
    full = F.aggregate("_sizes", F.lit(0).cast("long"), lambda s, x: s + F.least(x["n"], F.col("turn") - 1))
    round_ = F.size(F.filter("_sizes", lambda x: (x["n"] >= F.col("turn")) & (x["bucket"] <= F.col("bucket"))))
    return turns.join(F.broadcast(sizes)).withColumn("place", full + round_).drop("_sizes")


def allocate(bands: DataFrame, budget: int) -> DataFrame:
    """``(band, take)`` for rows ``(band, have, available)``: each slot goes to the band that has least, of equals the higher.

    A band's k-th slot has the key (have + k, -band), which grows with k, so the
    greedy choice is the ``budget`` smallest keys.
    """
    slots = bands.where("available > 0").select("band", F.explode(F.sequence(F.lit(0), F.least(F.col("available"), F.lit(budget)) - 1)).alias("k"), "have")
    chosen = slots.orderBy(F.col("have") + F.col("k"), F.col("band").desc()).limit(budget)
    return chosen.groupBy("band").agg(F.count(F.lit(1)).alias("take"))


def stride(rows: DataFrame, take: DataFrame) -> DataFrame:
    """``take`` rows of each band, evenly spread over its scores."""
    ranked = numbered(rows, "band", "score", "pair_id", "rn", descending=False, count="n").join(take, "band")
    # row rn-1 is chosen if it is floor(i * n / take) for some i: the next such i is the ceiling
    i = F.ceil((F.col("rn") - 1) * F.col("take") / F.col("n"))
    return ranked.where((i < F.col("take")) & (F.floor(i * F.col("n") / F.col("take")) == F.col("rn") - 1)).drop("rn", "n", "take")


def interleave(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``: bands spread evenly over the page, rows of a band in scattered order."""
    w = Window.partitionBy("band")
    scattered = rows.withColumn("_s", U.scatter("pair_id"))
    place = (F.row_number().over(w.orderBy("_s", "pair_id")) - 0.5) / F.count(F.lit(1)).over(w)
    return scattered.withColumn("place", place).drop("_s")


def page(pool: DataFrame, labels: DataFrame, edges: list[float], budget: int) -> DataFrame:
    """Pairs for one labelling page: most for the bands with fewest labels, spread over their scores."""
    banded = pool.withColumn("band", V.band(F.col("score"), edges))
    have = labels.withColumn("band", V.band(F.col("score"), edges)).groupBy("band").agg(F.count(F.lit(1)).alias("have"))
    free = banded.join(labels.select("pair_id").distinct(), "pair_id", "left_anti")
    sizes = free.groupBy("band").agg(F.count(F.lit(1)).alias("available")).join(have, "band", "left").select("band", F.coalesce("have", F.lit(0)).alias("have"), "available")
    return interleave(stride(free, allocate(sizes, budget)))


def queue_page(pairs: DataFrame, judged: DataFrame, budget: int) -> DataFrame:
    """The first unjudged pairs of the judge's queue with ``place``, a scattered order; none for a budget of 0 or less."""
    head = judge_queue(unanswered(pairs, judged), max(budget, 0))
    return head.withColumn("place", U.scatter("pair_id"))
