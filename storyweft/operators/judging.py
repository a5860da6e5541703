"""Pairs, answers of judges and humans, and the links they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from .dedupe import last_answers


def labelling_pool(first: DataFrame, second: DataFrame, labellable: Column | None = None) -> DataFrame:
    """Both tables by ``pair_id``; of a pair in both the row of ``first`` stays, of several the smallest.

    ``labellable`` is a rule on the columns; pairs that break it are no use to a human.
    """
    both = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)))
    rest = [F.col(c).asc_nulls_last() for c in first.columns if c != "pair_id"]
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy("_from", *rest))
    pool = both.withColumn("_rank", rank).where("_rank = 1").drop("_from", "_rank")
    return pool if labellable is None else pool.where(F.coalesce(labellable, F.lit(True)))


def is_labellable(outlet_a: Column, outlet_b: Column, class_a: Column, class_b: Column) -> Column:
    """Two outlets, and neither title of a class that is no news; an unknown outlet differs from any."""
    return ~F.coalesce(outlet_a == outlet_b, F.lit(False)) & class_a.isNull() & class_b.isNull()


def page_payload(pairs: DataFrame) -> DataFrame:
    """``(json)``: what a labelling page reads of each pair, under short names, the score to 4 places.

    ``pairs`` has ``pair_id``, ``score`` and, of both items, ``a_outlet``, ``a_title``,
    ``a_lede``, ``a``, ``a_published`` and the like for b. NULLs are kept.
    """
    side = lambda k: F.struct(F.col(f"{k}_outlet").alias("o"), F.col(f"{k}_title").alias("t"), F.col(f"{k}_lede").alias("l"), F.col(k).alias("i"), F.col(f"{k}_published").alias("p"))
    return pairs.select(F.to_json(F.struct(F.col("pair_id").alias("id"), (F.floor(F.col("score") * 10000 + 0.5) / 10000).alias("s"), side("a").alias("a"), side("b").alias("b")), {"ignoreNullFields": "false"}).alias("json"))


def labelled_pairs(labels: DataFrame, pool: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``(pairs, counts)``: pairs of the pool with the last answer ``same_story`` of their labels; ``counts`` is one row ``(pairs, unmatched)``.

    Labels whose pair is not in the pool can't be shown again and are only counted.
    """
    last = last_answers(labels, order).select("pair_id", "same_story")
    found = pool.join(last, "pair_id")
    known = pool.select("pair_id").distinct().withColumn("_known", F.lit(True))
    counts = last.join(known, "pair_id", "left").agg(F.count("_known").alias("pairs"), F.count_if(F.col("_known").isNull()).alias("unmatched"))
    return found, counts


def unanswered(pairs: DataFrame, *answered: DataFrame) -> DataFrame:
    """Pairs that none of the tables has an answer for; pairs of an id with itself are dropped."""
    out = pairs.where(F.col("a") != F.col("b"))
    done = None
    for t in answered:
        ids = t.select("pair_id")
        done = ids if done is None else done.unionByName(ids)
    return out if done is None else out.join(done.distinct(), "pair_id", "left_anti")


def judge_queue(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs of two outlets (or an unknown one) first, then by descending score."""
    q = pairs.orderBy(F.coalesce(F.col("outlet_a") == F.col("outlet_b"), F.lit(False)), F.col("score").desc(), "pair_id")
    return q if limit is None else q.limit(limit)


def judgment_problem(pairs_known: Column, backends: list[str]) -> Column:
    """First rule a judgment breaks, NULL if none."""
    reason = F.length(F.btrim("reason"))
    return (
        F.when(~pairs_known, "no such pair")
        .when(F.col("pair_id") != U.pair_id(F.lower(F.btrim("item_id_a")), F.lower(F.btrim("item_id_b"))), "ids differ from the pair")
        .when(F.col("same_story").isNull(), "no answer")
        .when(~F.coalesce(F.col("backend").isin(backends), F.lit(False)), "unknown backend")
        .when(F.coalesce(F.btrim("model"), F.lit("")) == "", "no model")
        .when(F.col("reason").isNull() | (reason < 10) | (reason > 300), "reason too short or long")
    )


def checked_judgments(judgments: DataFrame, pairs: DataFrame, backends: list[str]) -> DataFrame:
    """Judgments with ``problem``."""
    known = pairs.select("pair_id").distinct().withColumn("_known", F.lit(True))
    return judgments.join(known, "pair_id", "left").withColumn("problem", judgment_problem(F.col("_known").isNotNull(), backends)).drop("_known")


def accepted_links(human: DataFrame, judged: DataFrame, order: list[Column]) -> DataFrame:
    """``(u, v, source)``: pairs a human's last answer joins, and those a judge joins where no human answered.

    A "no" of a judge does nothing; a human's answer counts against any judge.
    """
    last = last_answers(human, order)
    ends = lambda df, s: df.where("same_story").select(F.least("item_id_a", "item_id_b").alias("u"), F.greatest("item_id_a", "item_id_b").alias("v"), F.lit(s).alias("source"))
    return ends(last, "human").unionByName(ends(judged.join(last.select("pair_id"), "pair_id", "left_anti"), "judge"))


def import_problems(rows: DataFrame, pool: DataFrame, labels: DataFrame, timestamp_ok: Column) -> DataFrame:
    """Rows of a label import with the first rule each breaks; nothing may be written while any row has one."""
    known = pool.groupBy("pair_id").agg(F.max(F.round("score", 4)).alias("_score"))
    old = labels.groupBy("pair_id").agg(F.bool_or("same_story").alias("_yes"), F.bool_or(~F.col("same_story")).alias("_no"))
    own = rows.groupBy("pair_id").agg((F.countDistinct("same_story") > 1).alias("_torn"))
    j = rows.join(known, "pair_id", "left").join(old, "pair_id", "left").join(own, "pair_id", "left")
    against = (F.col("same_story") & F.col("_no")) | (~F.col("same_story") & F.col("_yes"))
    problem = (
        F.when(F.col("same_story").isNull(), "no answer")
        .when(F.col("_score").isNull(), "no such pair")
        .when(F.round("score", 4) != F.col("_score"), "another score")
        .when(~timestamp_ok, "no timestamp")
        .when(F.col("_torn"), "answered twice in different ways")
        .when(F.coalesce(against, F.lit(False)), "differs from a stored label")
    )
    return j.withColumn("problem", problem).drop("_score", "_yes", "_no", "_torn")
