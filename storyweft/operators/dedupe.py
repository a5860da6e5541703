"""One row of many: the newest, the last, the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; ``order`` should decide every tie.

    The row is kept whole, so a window is used; Spark limits each group to one row
    before the shuffle, so a key with very many rows is no burden.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def latest_by_id(items: DataFrame) -> DataFrame:
    """The newest row of each id by (fetched, published); NULL ids are dropped."""
    ties = [F.col(c).asc_nulls_last() for c in ("title", "lede", "url", "outlet") if c in items.columns]
    return first_by(items.where(F.col("id").isNotNull()), ["id"], [F.col("fetched").desc_nulls_last(), F.col("published").desc_nulls_last(), *ties])


def last_answers(answers: DataFrame, order: list[Column]) -> DataFrame:
    """The last answer of each ``pair_id``, given the order of appending."""
    return first_by(answers.where(F.col("pair_id").isNotNull()), ["pair_id"], order)


def best_run(runs: DataFrame) -> DataFrame:
    """One record a date: one with a duration before one without, then the latest."""
    return first_by(runs, ["date"], [F.col("duration_seconds").isNull(), F.col("finished_at").desc_nulls_last()])


def new_rows(batch: DataFrame, stored: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of a batch whose key isn't stored yet, the first of each key."""
    return first_by(batch, keys, order).join(stored.select(*keys).distinct(), keys, "left_anti")
