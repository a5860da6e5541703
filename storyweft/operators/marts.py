"""Tables that are published: sources, stories, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import rate


def outlet_stats(members: DataFrame, discrepant: DataFrame | None = None) -> DataFrame:
    """Per outlet: stories, stories it was first with (ties shared), discrepant stories, and the rates.

    ``members`` is ``(story, outlet, published)``, ``discrepant`` ``(story, outlet)``, of
    which only outlets of the story count, once a story.
    """
    at = members.groupBy("story", "outlet").agg(F.min("published").alias("published"))
    first = at.withColumn("_r", F.rank().over(Window.partitionBy("story").orderBy("published")))
    stats = first.groupBy("outlet").agg(F.count(F.lit(1)).alias("stories"), F.count_if(F.col("_r") == 1).alias("first_stories"))
    if discrepant is None:
        stats = stats.withColumn("discrepancy_stories", F.lit(0).cast("long"))
    else:
        own = discrepant.select("story", "outlet").distinct().join(at.select("story", "outlet"), ["story", "outlet"], "left_semi")
        stats = stats.join(own.groupBy("outlet").agg(F.count(F.lit(1)).alias("d")), "outlet", "left").withColumn("discrepancy_stories", F.coalesce("d", F.lit(0))).drop("d")
    return stats.withColumns({
        "first_rate": F.round(rate(F.col("first_stories"), F.col("stories")), 6), "discrepancy_rate": F.round(rate(F.col("discrepancy_stories"), F.col("stories")), 6)
    })


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "low", 1).when(severity == "medium", 2).when(severity == "high", 3).otherwise(0)


def story_table(members: DataFrame, discrepancies: DataFrame | None = None) -> DataFrame:
    """``(story, date, outlets, items, severity)``; the date is that of the first item, the severity the rank of the worst discrepancy.

    ``discrepancies`` is ``(story, severity)``; a story without any has the rank 0.
    """
    stories = members.groupBy("story").agg(F.substring(F.min("published"), 1, 10).alias("date"), F.countDistinct("outlet").alias("outlets"), F.count(F.lit(1)).alias("items"))
    if discrepancies is None:
        return stories.withColumn("severity", F.lit(0))
    worst = discrepancies.groupBy("story").agg(F.max(severity_rank(F.col("severity"))).alias("_worst"))
    return stories.join(worst, "story", "left").withColumn("severity", F.coalesce("_worst", F.lit(0))).drop("_worst")


def front_page(stories: DataFrame, days: int = 4) -> DataFrame:
    """Stories of the newest ``days`` dates that have one with their ``place``, by date, outlets, severity and id, all descending."""
    newest = stories.select("date").distinct().orderBy(F.col("date").desc()).limit(days)
    order = [F.col(c).desc() for c in ("outlets", "severity", "story")]
    page = stories.join(newest, "date", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("date").orderBy(*order)))
    # as many rows as days
    sizes = page.groupBy("date").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("date", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return page.join(F.broadcast(starts), "date").withColumn("place", F.col("_start") + F.col("_n")).drop("_n", "_start").orderBy("place")


def claims_matrix(quotes: DataFrame, outlets: list[str]) -> DataFrame:
    """One row a claim, one column an outlet with the number of its quotes."""
    return quotes.where(F.col("claim_id").isNotNull()).groupBy("cluster_id", "claim_id").pivot("outlet", outlets).agg(F.count(F.lit(1)))


def claim_cells(quotes: DataFrame) -> DataFrame:
    """``(cluster_id, claim_id, outlet, quotes)``: the cells of the claims matrix that hold a quote, each quote once, in order."""
    return quotes.where(F.col("claim_id").isNotNull()).groupBy("cluster_id", "claim_id", "outlet").agg(F.sort_array(F.collect_set("quote")).alias("quotes"))


def story_links(members: DataFrame) -> DataFrame:
    """Members of each story in the order of outlet, time and id, one an item."""
    one = members.groupBy("story", "item_id").agg(F.min(F.struct("outlet", "published")).alias("x")).select("story", "item_id", "x.outlet", "x.published")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("story").orderBy("outlet", "published", "item_id")))


def by_outlet(members: DataFrame) -> DataFrame:
    """``(outlet, date, stories)``."""
    return members.select("outlet", F.substring("published", 1, 10).alias("date"), "story").distinct().groupBy("outlet", "date").agg(F.count(F.lit(1)).alias("stories"))


def run_summary(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """``(run, duration, agent_seconds, status)``; steps are ``(run, seconds, ok)``.

    An unknown duration stays unknown. A run failed if a step did, is empty without
    any steps, else ok.
    """
    s = steps.groupBy("run").agg(F.sum("seconds").alias("_sum"), F.count_if(~F.col("ok")).alias("_bad"), F.count(F.lit(1)).alias("_n"))
    status = F.when(F.coalesce("_bad", F.lit(0)) > 0, "failed").when(F.coalesce("_n", F.lit(0)) == 0, "empty").otherwise("ok")
    left = F.greatest(F.col("duration") - F.coalesce("_sum", F.lit(0.0)), F.lit(0.0))
    return runs.join(s, "run", "left").select("run", "duration", F.when(F.col("duration").isNotNull(), left).alias("agent_seconds"), status.alias("status"))


def last_successful(runs: DataFrame) -> DataFrame:
    """The newest run that did not fail."""
    return runs.where(F.col("status") != "failed").orderBy(F.col("date").desc()).limit(1)


def broken_links(pages: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """``(path, target)``: links within the site to pages that aren't there."""
    hrefs = pages.select(F.col(path).alias("path"), F.explode(F.regexp_extract_all(F.col(html), F.lit('href="(/[^"#?]*)'), F.lit(1))).alias("target")).distinct()
    return hrefs.join(pages.select(F.col(path).alias("target")).distinct(), "target", "left_anti").select("path", "target")


def weighted_score(values: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``values`` with ``total``, the weighted sum of its columns; a NULL counts as 0."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w))
    return values.withColumn("total", total)
