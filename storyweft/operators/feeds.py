"""From feed entries to items, and how healthy a feed is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times as D
from ..functions import urls as U


def to_items(entries: DataFrame, word_cap: int = 60) -> DataFrame:
    """Items of raw entries with a link: canonical address, id, plain capped texts, times in ISO form.

    Columns that an entry lacks count as NULL. Entries with a NULL or blank link are
    left out; a missing or unreadable time falls back to ``fetched``.
    """
    has = set(entries.columns)
    col = lambda c, kind="string": F.col(c) if c in has else F.lit(None).cast(kind)
    lede = T.lede_of(col("lede") if "lede" in has else col("summary"), col("description"), col("content"))
    return entries.where(F.btrim("link") != "").select(
        U.item_id(F.col("link")).alias("id"), "outlet", U.canonical_url(F.col("link")).alias("url"),
        T.plain_text(F.coalesce(col("title"), F.lit(""))).alias("title"), T.first_words(lede, word_cap).alias("lede"),
        T.author_name(col("author")).alias("author"), D.published_time(col("published"), col("updated"), F.col("fetched")).alias("published"), "fetched",
        T.clean_tags(F.coalesce(col("tags", "array<string>"), F.array().cast("array<string>"))).alias("tags"),
    )


def skipped_entries(entries: DataFrame) -> DataFrame:
    """``(outlet, entries, skipped)``: how many have no link."""
    no = ~F.coalesce(F.btrim("link") != "", F.lit(False))
    return entries.groupBy("outlet").agg(F.count(F.lit(1)).alias("entries"), F.count_if(no).alias("skipped"))


def _upper_median(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """The upper median of each key, from the counts of the distinct values; a key with many rows is no burden."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key)
    run = counts.withColumns({"_to": F.sum("_n").over(w.orderBy(value)), "_all": F.sum("_n").over(w)})
    return run.where(F.col("_to") > F.floor(F.col("_all") / 2)).groupBy(key).agg(F.min(value).alias(out))


def with_previous_time(rows: DataFrame, key: str, time: str, tie: str, out: str) -> DataFrame:
    """``rows`` with ``out``, the time of the row before in the order of time and tie; rows without a key or time are left out.

    Day by day, so that a key is not one task: the first row of a day follows the last
    of the day before that has one.
    """
    dated = rows.where(F.col(time).isNotNull() & F.col(key).isNotNull()).withColumn("_day", F.to_date(time))
    days = dated.groupBy(key, "_day").agg(F.max(time).alias("_max"))
    days = days.withColumn("_prev", F.lag("_max").over(Window.partitionBy(key).orderBy("_day"))).drop("_max")
    before = F.coalesce(F.lag(time).over(Window.partitionBy(key, "_day").orderBy(time, tie)), F.col("_prev"))
    return dated.join(days, [key, "_day"]).withColumn(out, before).drop("_day", "_prev")


def partition(items: DataFrame, promotional: Column) -> tuple[DataFrame, DataFrame]:
    """``(news, promotional)``: every item is in one of the two; where the rule gives NULL it is news."""
    hit = F.coalesce(promotional, F.lit(False))
    return items.where(~hit), items.where(hit)


def measure(entries: DataFrame, now: str) -> DataFrame:
    """Per outlet: entries, lede lengths, repeated titles, tracking parameters, recency and gaps.

    Medians are the upper of two. The gap needs more than two dated entries. Age and
    gap are hours.
    """
    words = T.word_count(F.coalesce("lede", F.lit("")))
    e = entries.withColumn("_w", words).withColumn("_ts", F.try_to_timestamp("published"))
    same = T.squeeze(F.col("title")) == F.rtrim(T.squeeze(F.col("lede")), F.lit("."))
    clock = F.lit(now).cast("timestamp")
    base = e.groupBy("outlet").agg(
        F.count(F.lit(1)).alias("entries"), F.max("_w").alias("max_lede_words"), F.count_if(F.coalesce(same, F.lit(False))).alias("equal_title"),
        F.count_if((F.col("_ts") <= clock) & (F.col("_ts") > clock - F.expr("INTERVAL 7 DAYS"))).alias("last_week"), F.max("published").alias("newest"),
        F.round((F.unix_timestamp(clock) - F.unix_timestamp(F.max("_ts"))) / 3600, 6).alias("age_hours"), F.count("_ts").alias("_dated"),
    )
    tracked = e.select("outlet", F.explode(U.tracking_params(F.col("link"))).alias("k")).groupBy("outlet").agg(F.countDistinct("k").alias("tracking"))
    dated = with_previous_time(e.where(F.col("_ts").isNotNull()).select("outlet", "_ts", "link"), "outlet", "_ts", "link", "_before")
    gaps = dated.withColumn("_gap", (F.unix_timestamp("_ts") - F.unix_timestamp("_before")) / 3600)
    medians = _upper_median(e, "outlet", "_w", "median_lede_words").join(_upper_median(gaps, "outlet", "_gap", "_g"), "outlet", "left")
    return (
        base.join(medians, "outlet", "left").join(tracked, "outlet", "left")
        .withColumn("gap_hours", F.when(F.col("_dated") > 2, F.round("_g", 6))).withColumn("tracking", F.coalesce("tracking", F.lit(0)))
        .drop("_g", "_dated")
    )


def gates(measured: DataFrame, min_words: int = 8, max_equal: float = 0.5, max_age_hours: float = 168) -> DataFrame:
    """``measured`` with ``has_lede``, ``stale`` and the list of reasons against the feed."""
    has = (F.col("median_lede_words") >= min_words) & (F.col("equal_title") < F.col("entries") * max_equal)
    stale = F.col("age_hours").isNull() | (F.col("age_hours") > max_age_hours)
    reasons = F.filter(F.array(F.when(~F.col("has_lede"), "no lede"), F.when(F.col("stale"), "stale")), lambda r: r.isNotNull())
    return measured.withColumn("has_lede", F.coalesce(has, F.lit(False))).withColumn("stale", stale).withColumn("reasons", reasons)


def title_class(title: Column, tags: Column, tag_words: list[str], patterns: dict[str, list[str]]) -> Column:
    """``tag`` if a tag is listed, else the name of the first pattern list that the title matches, else NULL."""
    normal = F.transform(tags, lambda t: T.folded_words(t))
    out = F.when(F.arrays_overlap(normal, F.array(*[F.lit(w) for w in tag_words])), "tag")
    for name, some in patterns.items():
        out = out.when(F.coalesce(title, F.lit("")).rlike("(?i)" + "|".join(f"(?:{p})" for p in some)), name)
    return out
