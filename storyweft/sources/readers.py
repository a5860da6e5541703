"""Readers of the data root: feeds as XML, items by date, JSON tables strict and tolerant."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.dedupe import best_run

_RSS = "title string, link string, description string, author string, pubDate string, category array<string>, guid string, `content:encoded` string, _broken string"
_ATOM = "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, updated string, published string, author struct<name:string>, category array<struct<_term:string>>, _broken string"


def rss_entries(spark: SparkSession, path: str, outlet: str) -> DataFrame:
    """Entries of RSS files in the columns of ``to_items``; ``fetched`` is the time of the file.

    An entry that can't be read comes with ``broken``, its text, and nothing else.
    """
    raw = _xml(spark, path, "item", _RSS)
    return raw.select(
        F.lit(outlet).alias("outlet"), "link", "title", F.coalesce(F.nullif("description", F.lit("")), F.col("`content:encoded`")).alias("summary"), "author", F.col("pubDate").alias("published"),
        F.lit(None).cast("string").alias("updated"), F.coalesce("category", F.array().cast("array<string>")).alias("tags"), _fetched().alias("fetched"), F.col("_broken").alias("broken"),
    )


def atom_entries(spark: SparkSession, path: str, outlet: str) -> DataFrame:
    """Entries of Atom files; the link is the alternate one, else the first."""
    raw = _xml(spark, path, "entry", _ATOM)
    alternate = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get("link", F.lit(0))["_href"])
    return raw.select(
        F.lit(outlet).alias("outlet"), link.alias("link"), "title", F.coalesce(F.nullif("summary", F.lit("")), "content").alias("summary"), F.col("author.name").alias("author"),
        "published", "updated", F.coalesce(F.transform("category", lambda c: c["_term"]), F.array().cast("array<string>")).alias("tags"), _fetched().alias("fetched"), F.col("_broken").alias("broken"),
    )


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").schema(schema).load(path)


def _fetched():
    return F.date_format(F.col("_metadata.file_modification_time"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def feed_entries(spark: SparkSession, feeds: list[tuple[str, str, str]]) -> DataFrame:
    """Entries of ``(outlet, kind, path)`` feeds together; kind is rss or atom."""
    read = {"rss": rss_entries, "atom": atom_entries}
    out = None
    for outlet, kind, path in feeds:
        part = read[kind](spark, path, outlet)
        out = part if out is None else out.unionByName(part)
    return out


def feed_failures(entries: DataFrame) -> DataFrame:
    """``(outlet, entries, broken)``: how many entries of each outlet could not be read."""
    return entries.groupBy("outlet").agg(F.count(F.lit(1)).alias("entries"), F.count("broken").alias("broken"))


def read_runs(spark: SparkSession, path: str, limit: int | None = 14) -> DataFrame:
    """Run records, one a date, the newest first; ``limit`` bounds the report."""
    runs = best_run(read_json_table(spark, path, schemas.RUN)).orderBy(F.col("date").desc())
    return runs if limit is None else runs.limit(limit)


def read_items(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """Stored items; with ``since`` only partitions of that date and later, with no upper end."""
    items = spark.read.parquet(f"{root}/items")
    return items if since is None else items.where(F.col("item_date") >= F.lit(since).cast("date"))


def read_json_table(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON object a file, or a line where the files end in ``.jsonl``.

    Strict reading fails on the first bad record; tolerant reading leaves bad ones out.
    """
    lines = path.endswith(".jsonl")
    reader = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.json(path)


def read_judgments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(readable, unreadable)`` judgments.

    A missing field, a broken file, or a ``same_story`` that is not true or false (the
    string "false" is not) makes a record unreadable.
    """
    raw = spark.read.text(path, wholetext=not path.endswith(".jsonl")).select(F.col("value"), F.col("_metadata.file_name").alias("file"))
    v = F.try_parse_json("value")
    answer = F.try_variant_get(v, "$.same_story", "boolean")
    is_bool = F.schema_of_variant(F.try_variant_get(v, "$.same_story", "variant")) == "BOOLEAN"
    parsed = raw.withColumn("j", F.from_json("value", schemas.JUDGMENT)).withColumn("_ok", F.coalesce(is_bool & answer.isNotNull(), F.lit(False)))
    needed = [c.split(" ")[0] for c in schemas.JUDGMENT.split(", ") if not c.startswith("same_story")]
    whole = F.col("_ok")
    for c in needed:
        whole = whole & F.col(f"j.{c}").isNotNull()
    readable = parsed.where(whole).select("j.*")
    return readable, parsed.where(~whole).select("file", "value")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, offset, value, readable)`` of JSON lines; ``offset`` orders the lines of a file."""
    text = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("offset"), "value")
    return text.withColumn("readable", F.try_parse_json("value").isNotNull())


def vectors_of(vectors: DataFrame, model: str, ids: DataFrame | None = None) -> DataFrame:
    """Vectors of one model, of the given ``item_id`` or of all."""
    own = vectors.where(F.col("model_id") == model)
    return own if ids is None else own.join(ids.select("item_id").distinct(), "item_id", "left_semi")


def cached_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions ``(model, variant, pair_id, prompt_id)`` with the stored ``p`` of the same prompt, NULL where there is none."""
    keys = ["model", "variant", "pair_id", "prompt_id"]
    known = answers.groupBy(*keys).agg(F.min("p").alias("p"))
    return questions.join(known, keys, "left")


@dataclass(frozen=True)
class ClusterSettings:
    """Thresholds of clustering, checked when made."""

    tau_low: float
    tau_high: float
    window_days: int = 4
    min_outlets: int = 2
    sample_floor: float = 0.2
    sample_width: float = 0.05
    sample_cap: int = 20

    def __post_init__(self):
        if not 0 <= self.tau_low <= self.tau_high <= 1:
            raise ValueError("thresholds must satisfy 0 <= tau_low <= tau_high <= 1")
        if self.window_days < 1 or self.min_outlets < 1 or self.sample_cap < 0 or not 0 < self.sample_width <= 1:
            raise ValueError("window_days, min_outlets, sample_cap or sample_width out of range")


def load_settings(path: str) -> ClusterSettings:
    """Settings of a YAML file; unknown keys are an error."""
    return ClusterSettings(**yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def load_outlets(spark: SparkSession, path: str) -> DataFrame:
    """Outlets of a YAML file with an ``outlets`` list."""
    rows = (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get("outlets")
    if not isinstance(rows, list):
        raise ValueError(f"{path} has no list of outlets")
    return spark.createDataFrame([(r["slug"], r["display_name"], r["homepage"], r["feed_url"]) for r in rows], "slug string, display_name string, homepage string, feed_url string")
