"""Scores against labels. Inputs have ``score`` (or ``p``) and ``same_story``; rows with a NULL in either are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import rate, rate_or_null


def _labelled(rows: DataFrame, score: str = "score") -> DataFrame:
    return rows.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col("same_story").isNotNull())


#: Ranges of score that running sums are cut into.
RANGES = 256


def _running(by_score: DataFrame) -> DataFrame:
    """Running sums over descending scores.

    The distinct scores are cut into ranges of equal width, summed in each and
    across the ranges, so that no task sees all of them.
    """
    ends = by_score.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * RANGES)).otherwise(F.lit(0))
    parts = by_score.join(F.broadcast(ends)).withColumn("_part", -at).drop("_lo", "_hi")
    inside = Window.partitionBy("_part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({"_t": F.sum("yes").over(inside), "_f": F.sum("no").over(inside)})
    totals = parts.groupBy("_part").agg(F.sum("yes").alias("y"), F.sum("no").alias("n"))
    # one row a range, RANGES + 1 at most
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("y").over(before), F.lit(0)).alias("y0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    return local.join(F.broadcast(starts), "_part").select("score", "yes", "no", (F.col("_t") + F.col("y0")).alias("tp"), (F.col("_f") + F.col("n0")).alias("fp"))


def _by_score(rows: DataFrame) -> DataFrame:
    yes = F.col("same_story").cast("int")
    return _labelled(rows).groupBy("score").agg(F.sum(yes).alias("yes"), F.sum(1 - yes).alias("no"))


def tune_table(rows: DataFrame) -> DataFrame:
    """``(score, tp, fp, fn, precision, recall)`` with each distinct score as the threshold."""
    by = _by_score(rows)
    run = _running(by)
    total = by.agg(F.sum("yes").alias("all"))
    return run.join(F.broadcast(total)).select(
        "score", "tp", "fp", (F.col("all") - F.col("tp")).alias("fn"),
        F.round(rate_or_null(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(rate_or_null(F.col("tp"), F.col("all")), 6).alias("recall"),
    )


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """``(tp, fp, tn, fn, accuracy, precision, recall)`` of two boolean columns."""
    t, g = F.col(truth), F.col(guess)
    n = lambda c: F.count_if(c)
    s = rows.where(t.isNotNull() & g.isNotNull()).agg(n(t & g).alias("tp"), n(~t & g).alias("fp"), n(~t & ~g).alias("tn"), n(t & ~g).alias("fn"))
    all_ = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return s.select(
        "tp", "fp", "tn", "fn", F.round(rate_or_null(F.col("tp") + F.col("tn"), all_), 6).alias("accuracy"),
        F.round(rate_or_null(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(rate_or_null(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"),
    )


def roc_auc(rows: DataFrame) -> DataFrame:
    """``(auc)`` with ties counted half; 0.5 if a class is empty."""
    run = _running(_by_score(rows))
    # of each score: its yes answers beat the no answers below it and tie with its own
    won = F.sum(F.col("yes") * (F.col("n") - F.col("fp")) + F.col("yes") * F.col("no") / 2)
    total = _by_score(rows).agg(F.sum("yes").alias("y"), F.sum("no").alias("n"))
    return run.join(F.broadcast(total)).groupBy().agg(won.alias("won"), F.first("y").alias("y"), F.first("n").alias("n")).select(
        F.round(F.coalesce(F.try_divide("won", F.col("y") * F.col("n")), F.lit(0.5)), 6).alias("auc")
    )


def separation(rows: DataFrame) -> DataFrame:
    """``(highest_false, lowest_true, recall, tau, separable, unreachable)`` at a precision of one.

    A match counts if it scores above every non-match; ``tau`` is the lowest such score.
    """
    l = _labelled(rows)
    yes, no = F.col("same_story"), ~F.col("same_story")
    ends = l.agg(F.max(F.when(no, F.col("score"))).alias("highest_false"), F.min(F.when(yes, F.col("score"))).alias("lowest_true"), F.count_if(yes).alias("all"))
    above = yes & (F.col("highest_false").isNull() | (F.col("score") > F.col("highest_false")))
    got = l.join(F.broadcast(ends)).groupBy("highest_false", "lowest_true", "all").agg(F.count_if(above).alias("got"), F.min(F.when(above, F.col("score"))).alias("tau"))
    return got.select(
        "highest_false", "lowest_true", F.round(rate(F.col("got"), F.col("all")), 6).alias("recall"), "tau",
        F.coalesce(F.col("got") == F.col("all"), F.lit(False)).alias("separable"), (F.col("all") - F.col("got")).alias("unreachable"),
    )


def calibration(rows: DataFrame, edges: list[float], p: str = "p") -> DataFrame:
    """``(bin, n, mean_p, yes_rate)`` of bins [edge, next edge); empty bins are left out.

    A billionth is added to the mean, so that halves round up whatever the order of the sum.
    """
    b = F.when(F.col(p) < edges[1], F.lit(0))
    for i in range(1, len(edges) - 1):
        b = b.when(F.col(p) < edges[i + 1], F.lit(i))
    l = _labelled(rows, p).withColumn("bin", b).where(F.col("bin").isNotNull())
    return l.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p) + 1e-9, 6).alias("mean_p"), F.round(F.avg(F.col("same_story").cast("int")), 6).alias("yes_rate"))


def triage(rows: DataFrame, no: float, yes: float, p: str = "p") -> DataFrame:
    """``(n_no, n_middle, n_yes, matches_lost, wrong_links)`` of two cut-offs."""
    l, q = _labelled(rows, p), F.col(p)
    return l.agg(
        F.count_if(q < no).alias("n_no"), F.count_if((q >= no) & (q < yes)).alias("n_middle"), F.count_if(q >= yes).alias("n_yes"),
        F.count_if((q < no) & F.col("same_story")).alias("matches_lost"), F.count_if((q >= yes) & ~F.col("same_story")).alias("wrong_links"),
    )


def prefilter(rows: DataFrame, cutoff: float, queue_floor: float, p: str = "p") -> DataFrame:
    """``(queue, dropped, matches, matches_lost)`` if pairs under the cut-off were never asked."""
    l = _labelled(rows, p).where(F.col("score") >= queue_floor)
    low = F.col(p) < cutoff
    return l.agg(F.count(F.lit(1)).alias("queue"), F.count_if(low).alias("dropped"), F.count_if("same_story").alias("matches"), F.count_if(low & F.col("same_story")).alias("matches_lost"))


def cutoff_grid(rows: DataFrame, cutoffs: list[float], p: str = "p") -> DataFrame:
    """``(cutoff, tp, fp, fn, precision)`` of each cut-off."""
    grid = _labelled(rows, p).withColumn("cutoff", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])))
    hit, y = F.col(p) >= F.col("cutoff"), F.col("same_story")
    g = grid.groupBy("cutoff").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    return g.withColumn("precision", F.round(rate_or_null(F.col("tp"), F.col("tp") + F.col("fp")), 6))


def halves_grid(rows: DataFrame, cutoffs: list[float], p: str = "p") -> DataFrame:
    """``(variant, tuning, cutoff, tp, fp, fn, precision)``: the grid of each variant on either half of the pairs.

    ``rows`` has ``variant``, ``tuning``, the probability and ``same_story``.
    """
    grid = _labelled(rows, p).withColumn("cutoff", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])))
    hit, y = F.col(p) >= F.col("cutoff"), F.col("same_story")
    g = grid.groupBy("variant", "tuning", "cutoff").agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"))
    return g.withColumn("precision", F.round(rate_or_null(F.col("tp"), F.col("tp") + F.col("fp")), 6))


def held_out_at_pick(rows: DataFrame, cutoffs: list[float], target: float, p: str = "p") -> DataFrame:
    """``(variant, picked, tp, fp, fn, precision)``: the lowest cut-off that reaches the precision on the tuning half, and what it does on the other.

    A variant that no cut-off brings there has NULLs.
    """
    grid = halves_grid(rows, cutoffs, p)
    picked = grid.where(F.col("tuning") & (F.col("tp") + F.col("fp") > 0) & (F.col("precision") >= target)).groupBy("variant").agg(F.min("cutoff").alias("picked"))
    held = grid.where(~F.col("tuning")).select("variant", F.col("cutoff").alias("picked"), "tp", "fp", "fn", "precision")
    return rows.select("variant").distinct().join(picked, "variant", "left").join(held, ["variant", "picked"], "left").select("variant", "picked", "tp", "fp", "fn", "precision")


def disagreements(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """The rows whose guess differs from the truth, both being known."""
    return rows.where(F.col(truth) != F.col(guess))


def pick_cutoff(rows: DataFrame, cutoffs: list[float], target: float, p: str = "p") -> DataFrame:
    """``(cutoff)``: the lowest that reaches the precision with at least one hit; NULL if none does."""
    return cutoff_grid(rows, cutoffs, p).where((F.col("tp") + F.col("fp") > 0) & (F.col("precision") >= target)).agg(F.min("cutoff").alias("cutoff"))
