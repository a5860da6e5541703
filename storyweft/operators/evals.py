"""Scores of produced discrepancies against expected ones, batches of answers, and lanes of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, rate


def discrepancy_keys(rows: DataFrame) -> DataFrame:
    """``(case_id, keys)``: the distinct (kind, outlets in order) of each case; ``outlets`` is a list."""
    key = F.concat_ws("|", "kind", F.array_sort(F.array_distinct("outlets")))
    return rows.groupBy("case_id").agg(F.sort_array(F.collect_set(key)).alias("keys"))


def case_scores(cases: DataFrame, expected: DataFrame, produced: DataFrame, quotes: DataFrame) -> DataFrame:
    """Per case: found, discrepancies expected, produced and hit, quotes and valid quotes.

    ``cases`` has ``case_id`` and ``found``; ``quotes`` has ``case_id`` and ``problem``.
    A case without an analysis scores zero.
    """
    e = discrepancy_keys(expected).withColumnRenamed("keys", "_e")
    p = discrepancy_keys(produced).withColumnRenamed("keys", "_p")
    q = quotes.groupBy("case_id").agg(F.count(F.lit(1)).alias("_q"), F.count_if(F.col("problem").isNull()).alias("_v"))
    none = F.array().cast("array<string>")
    j = cases.join(e, "case_id", "left").join(p, "case_id", "left").join(q, "case_id", "left")
    want, got = F.coalesce("_e", none), F.coalesce("_p", none)
    return j.select(
        "case_id", "found", F.size(want).alias("expected"), F.size(got).alias("produced"), F.size(F.array_intersect(want, got)).alias("hit"),
        F.coalesce("_q", F.lit(0)).alias("quotes"), F.coalesce("_v", F.lit(0)).alias("quotes_valid"),
    )


def report(scores: DataFrame) -> DataFrame:
    """One row: cases, found, quote validity, precision and recall of discrepancies."""
    s = scores.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("found").alias("found"), F.sum("quotes").alias("q"), F.sum("quotes_valid").alias("v"),
        F.sum("hit").alias("h"), F.sum("produced").alias("p"), F.sum("expected").alias("e"),
    )
    share = lambda n, d: F.round(rate(F.col(n), F.col(d)), 6)
    return s.select("cases", "found", share("v", "q").alias("quote_validity"), share("h", "p").alias("precision"), share("h", "e").alias("recall"))


def is_stale(problems):
    """Whether there are problems and each is one of a changed cluster."""
    return (F.size(problems) > 0) & F.forall(problems, lambda p: p.startswith("cluster:") | F.contains(p, F.lit("is not in cluster")))


def collect_batch(results: DataFrame, pending: DataFrame, submitted: DataFrame) -> DataFrame:
    """Batch results with a disposition: not pending, not submitted, another version, or accept.

    ``submitted`` is ``(cluster_id, cluster_version)`` of what was sent; a cluster that was never
    sent differs from one that was sent in another version.
    """
    now = pending.select("cluster_id", F.col("version").alias("_now"))
    sent = submitted.select("cluster_id", F.col("cluster_version").alias("_sent"))
    d = F.when(F.col("_now").isNull(), "not pending").when(F.col("_sent").isNull(), "not submitted").when(F.col("_sent") != F.col("_now"), "another version").otherwise("accept")
    return results.join(now, "cluster_id", "left").join(sent, "cluster_id", "left").withColumn("disposition", d).drop("_now", "_sent")


def vector_scores(labels: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(scored, counts)``: labelled pairs with the cosine of their vectors as ``score``, a model each; ``counts`` is ``(model_id, scored, skipped)``.

    ``labels`` is ``(pair_id, item_id_a, item_id_b, same_story)``, one row a pair, and
    ``vectors`` ``(model_id, item_id, unit)``. A pair that lacks a vector of a model is
    skipped there. A stored score is never used.
    """
    side = lambda k: vectors.select("model_id", F.col("item_id").alias(f"item_id_{k}"), F.col("unit").alias(f"_{k}"))
    scored = labels.join(side("a"), "item_id_a").join(side("b"), ["model_id", "item_id_b"])
    scored = scored.select("model_id", "pair_id", "same_story", F.round(dot(F.col("_a"), F.col("_b")), 6).alias("score"))
    # one row
    all_ = labels.agg(F.count(F.lit(1)).alias("_n"))
    models = vectors.select("model_id").distinct().join(scored.groupBy("model_id").agg(F.count(F.lit(1)).alias("scored")), "model_id", "left")
    counts = models.join(F.broadcast(all_)).select("model_id", F.coalesce("scored", F.lit(0)).alias("scored"), (F.col("_n") - F.coalesce("scored", F.lit(0))).alias("skipped"))
    return scored, counts


def bench_order(results: DataFrame) -> DataFrame:
    """Models by recall, then AUC, both descending, then name."""
    return results.orderBy(F.col("recall").desc(), F.col("auc").desc(), "model_id")


def lane(answers: DataFrame, pool: DataFrame, low: float, high: float) -> DataFrame:
    """Pairs of two outlets whose answer lies between the cut-offs: what a human still has to look at."""
    crossing = pool.where(F.col("outlet_a") != F.col("outlet_b")).select("pair_id")
    return answers.where((F.col("p") >= low) & (F.col("p") < high)).join(crossing, "pair_id", "left_semi")


def chosen(ids: DataFrame, pool: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of an explicit list that are in the pool and have no label yet."""
    return pool.join(ids.select("pair_id").distinct(), "pair_id", "left_semi").join(labels.select("pair_id").distinct(), "pair_id", "left_anti")
