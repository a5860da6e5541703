"""Sinks: append once, insert once, write only what changed, keep what a run still has.

A table without MERGE is changed by writing a new snapshot beside the old one and
switching to it; partitioned tables are changed partition by partition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import best_run, first_by, new_rows  # noqa: F401 - kept under its old name
from ..workspace import remove_path


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_items(items: DataFrame, root: str) -> DataFrame:
    """Append items by published date, those stored under the same date and id left out; returns what was added.

    Within the batch the first by (fetched, published) stays. An id may be stored
    under two dates. Only the partitions of the batch's dates are looked at.
    """
    spark = items.sparkSession
    dated = items.withColumn("item_date", F.to_date(F.substring("published", 1, 10)))
    order = [F.col("fetched"), F.col("published"), F.col("title")]
    if _exists(spark, f"{root}/items"):
        stored = spark.read.parquet(f"{root}/items").select("item_date", "id")
        added = new_rows(dated, stored, ["item_date", "id"], order)
    else:
        added = first_by(dated, ["item_date", "id"], order)
    staged = f"{root}/_added-{uuid.uuid4().hex[:8]}"
    added.write.parquet(staged)
    out = spark.read.parquet(staged)
    out.repartition("item_date").sortWithinPartitions("id").write.mode("append").partitionBy("item_date").parquet(f"{root}/items")
    return out


def insert_once(rows: DataFrame, path: str, key: str) -> None:
    """Append rows whose key isn't stored; nothing stored is ever replaced."""
    spark = rows.sparkSession
    order = [F.col(c) for c in rows.columns]
    fresh = new_rows(rows, spark.read.parquet(path), [key], order) if _exists(spark, path) else first_by(rows, [key], order)
    fresh.write.mode("append").parquet(path)


def row_hash(df: DataFrame, key: str):
    """Hash of a row's JSON with its columns in order of name."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c != key]), {"ignoreNullFields": "false"}), 256)


def changed_rows(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows that are new or differ from the stored row of their key."""
    old = stored.select(F.col(key), row_hash(stored, key).alias("_old"))
    return rows.withColumn("_new", row_hash(rows, key)).join(old, key, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("_new"))).drop("_old", "_new")


def _snapshots(spark: SparkSession, path: str) -> list[str]:
    """Paths of the complete snapshots of a table, oldest first."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
    return [f"{path}/{n}" for n in names if n.startswith("snapshot-") and _exists(spark, f"{path}/{n}/_SUCCESS")]


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete snapshot of a table written by ``upsert``."""
    return spark.read.parquet(_snapshots(spark, path)[-1])


def upsert(rows: DataFrame, path: str, key: str, keep: int = 2) -> int:
    """Write a new snapshot with the changed rows; returns how many changed. Without a change nothing is written.

    A snapshot counts once it is complete, and the one before stays until the next, so
    neither a crash nor a reader of the old one loses the table. ``keep`` snapshots stay.
    """
    spark = rows.sparkSession
    known = _snapshots(spark, path)
    n = int(known[-1].rsplit("-", 1)[1]) + 1 if known else 0
    if not known:
        rows.write.mode("overwrite").parquet(f"{path}/snapshot-{n:06d}")
        return spark.read.parquet(f"{path}/snapshot-{n:06d}").count()
    stored = spark.read.parquet(known[-1])
    changed = changed_rows(rows, stored, key)
    count = changed.count()
    if count:
        stored.join(changed.select(key), key, "left_anti").unionByName(changed).write.mode("overwrite").parquet(f"{path}/snapshot-{n:06d}")
        for old in known[: -(keep - 1) or None]:
            remove_path(spark, old)
    return count


def prune(kept: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys that are stored but that this run did not write."""
    return stored.select(key).distinct().join(kept.select(key).distinct(), key, "left_anti")


def set_status(clusters: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Clusters with a new status for the given ids; superseded ones stay."""
    hit = ids.select("cluster_id").distinct().withColumn("_hit", F.lit(True))
    new = F.when(F.col("_hit").isNotNull() & (F.col("status") != "superseded"), status).otherwise(F.col("status"))
    return clusters.join(hit, "cluster_id", "left").withColumn("status", new).drop("_hit")


def stable_json(df: DataFrame) -> DataFrame:
    """``(json)``: each row as JSON with sorted keys."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("json"))


def import_labels(problems: DataFrame, labels_path: str) -> int:
    """Append checked label rows if none has a problem; returns the number of rows with one."""
    bad = problems.where(F.col("problem").isNotNull()).count()
    if not bad:
        problems.drop("problem").write.mode("append").parquet(labels_path)
    return bad
