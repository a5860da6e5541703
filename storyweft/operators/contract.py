"""Checks of analyses: every rule that is broken becomes a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze, word_count
from .schema import schema_errors

ANALYSIS = (
    "cluster_id string, cluster_version int, backend string, model string, generated_at string, headline string, summary string, "
    "claims array<struct<id:string,statement:string,sources:array<struct<outlet:string,item_id:string,quote:string>>>>, "
    "discrepancies array<struct<kind:string,severity:string,explanation:string,quotes:array<struct<outlet:string,item_id:string,quote:string>>,claim_ids:array<string>>>, "
    "agreement string, notes string"
)
_ID, _ITEM, _CLUSTER = r"^c\d{1,2}$", r"^[0-9a-f]{40}$", r"^\d{4}-\d{2}-\d{2}-[0-9a-f]{6}$"


def _text(**rules) -> dict:
    return {"type": "string", **rules}


def _object(fields: dict, *optional: str) -> dict:
    return {"type": "object", "additionalProperties": False, "required": [f for f in fields if f not in optional], "properties": fields}


def _list(items: dict, **rules) -> dict:
    return {"type": "array", "items": items, **rules}


#: The format of an analysis.
BACKENDS = ["api", "claude_code"]
KINDS = ["contradiction", "number", "attribution", "framing", "omission"]
SEVERITIES = ["low", "medium", "high"]
AGREEMENTS = ["full", "partial", "conflicting"]
_QUOTE = _object({"outlet": _text(minLength=1), "item_id": _text(pattern=_ITEM), "quote": _text(minLength=3, maxLength=400)})
_CLAIM = _object({"id": _text(pattern=_ID), "statement": _text(minLength=1, maxLength=300), "sources": _list(_QUOTE, minItems=1)})
_DISCREPANCY = _object(
    {"kind": _text(enum=KINDS), "severity": _text(enum=SEVERITIES), "claim_ids": _list(_text(pattern=_ID)), "explanation": _text(minLength=1, maxLength=300), "quotes": _list(_QUOTE, minItems=2)},
    "claim_ids",
)
FORMAT = _object(
    {
        "cluster_id": _text(pattern=_CLUSTER), "cluster_version": {"type": "integer", "minimum": 1}, "backend": _text(enum=BACKENDS), "model": _text(minLength=1),
        "generated_at": _text(), "headline": _text(minLength=1, maxLength=120), "summary": _text(minLength=1, maxLength=600), "claims": _list(_CLAIM, minItems=1, maxItems=20),
        "discrepancies": _list(_DISCREPANCY, maxItems=10), "agreement": _text(enum=AGREEMENTS), "notes": _text(maxLength=500),
    },
    "notes",
)


def parse_analyses(raw: DataFrame, text: str = "text") -> DataFrame:
    """``raw`` with ``parsed`` and ``readable``; broken JSON and JSON that isn't an object give NULL."""
    parsed = F.from_json(F.col(text), ANALYSIS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_none"})
    return raw.withColumn("parsed", parsed).withColumn("readable", F.try_parse_json(F.col(text)).isNotNull())


def text_rules(parsed: DataFrame) -> DataFrame:
    """``parsed`` analyses with ``problems``: the rules on words, claims and outlets that a schema can't express."""
    rules = F.array(
        F.when(word_count(F.col("headline")) > 15, "headline: over 15 words"),
        F.when(word_count(F.col("summary")) > 80, "summary: over 80 words"),
        F.when(F.size(F.array_distinct(F.transform("claims", lambda c: c["id"]))) < F.size("claims"), "claims: id twice"),
        F.when(F.size(unknown_claims()) > 0, "discrepancies: unknown claim"),
        F.when(F.exists("discrepancies", lambda d: F.size(F.array_distinct(F.transform(d["quotes"], lambda q: q["outlet"]))) < 2), "discrepancies: one outlet"),
    )
    return parsed.withColumn("problems", F.filter(rules, lambda r: r.isNotNull()))


def schema_problems(raw: DataFrame, key: str = "cluster_id", text: str = "text", schema: dict | None = None) -> DataFrame:
    """``(key, problem)`` of JSON texts: every rule of the format that one breaks, and if none those on its words.

    A text that is no JSON, or NULL, is unreadable. ``schema`` replaces the format.
    """
    checked = raw.select(F.col(key), F.col(text).alias("text"), schema_errors(F.col(text), schema or FORMAT).alias("_errors"))
    shaped = parse_analyses(checked.where(F.size("_errors") == 0)).select(key, "parsed.claims", "parsed.discrepancies", "parsed.headline", "parsed.summary")
    rows = checked.select(key, F.explode("_errors").alias("problem"))
    return rows.unionByName(text_rules(shaped).select(key, F.explode("problems").alias("problem")))


def validate(raw: DataFrame, clusters: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """``(file_id, problem)`` of analyses ``(file_id, text)``, each filed under the id of its cluster.

    Rules in turn: the format; the cluster (there is one, it is the one the analysis
    names, not superseded, of the same version); its words; its quotes (of an item of
    the cluster, of the item's outlet, verbatim). A text that breaks the format is
    looked at no further. ``members`` is ``(cluster_id, item_id)``.
    """
    shape = schema_problems(raw, "file_id")
    sound = parse_analyses(raw.join(shape.select("file_id").distinct(), "file_id", "left_anti")).select("file_id", "parsed.*")
    c = clusters.select(F.col("cluster_id").alias("file_id"), F.col("version").alias("_version"), F.col("status").alias("_status"))
    filed = sound.join(c, "file_id", "left")
    about = (
        F.when(F.col("_version").isNull(), "cluster: no cluster file").when(F.col("cluster_id") != F.col("file_id"), "cluster: another id")
        .when(F.col("_status") == "superseded", "cluster: superseded").when(F.col("cluster_version") != F.col("_version"), "cluster: another version")
    )
    quotes = sound.select("file_id", F.explode(all_quotes()).alias("q")).select("file_id", "q.*").distinct()
    inside = members.select(F.col("cluster_id").alias("file_id"), "item_id").distinct().withColumn("_in", F.lit(True))
    j = quote_problems(quotes, items).join(inside, ["file_id", "item_id"], "left")
    of_quotes = j.select("file_id", F.when(F.col("_in").isNull(), "quotes: item is not in cluster").otherwise(F.concat(F.lit("quotes: "), "problem")).alias("problem"))
    return shape.unionByName(filed.select("file_id", about.alias("problem"))).unionByName(of_quotes).where(F.col("problem").isNotNull()).distinct()


def publishable(raw: DataFrame, clusters: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """``(file_id, outcome)`` of each analysis: story, stale (another version or superseded) or invalid.

    An analysis that breaks the format, or has no cluster, is invalid; of the others
    one of an old version is stale, whatever else is wrong with it.
    """
    p = validate(raw, clusters, members, items)
    of = p.groupBy("file_id").agg(
        F.bool_or(F.col("problem").isin("cluster: superseded", "cluster: another version")).alias("_stale"), F.bool_or(F.col("problem") == "cluster: no cluster file").alias("_alone")
    )
    outcome = F.when(F.col("_stale").isNull(), "story").when(F.col("_stale") & ~F.col("_alone"), "stale").otherwise("invalid")
    return raw.select("file_id").distinct().join(of, "file_id", "left").select("file_id", outcome.alias("outcome"))


def all_quotes():
    """Quotes of claims and of discrepancies in one list."""
    empty = F.array().cast("array<struct<outlet:string,item_id:string,quote:string>>")
    return F.concat(F.coalesce(F.flatten(F.transform("claims", lambda c: c["sources"])), empty), F.coalesce(F.flatten(F.transform("discrepancies", lambda d: d["quotes"])), empty))


def unknown_claims():
    """Claim ids that discrepancies name but no claim has."""
    return F.array_except(F.flatten(F.transform("discrepancies", lambda d: d["claim_ids"])), F.transform("claims", lambda c: c["id"]))


def flat_quotes(analyses: DataFrame) -> DataFrame:
    """``(cluster_id, outlet, item_id, quote)`` of every quote."""
    return analyses.select("cluster_id", F.explode(all_quotes()).alias("q")).select("cluster_id", "q.*")


def quote_problems(quotes: DataFrame, items: DataFrame) -> DataFrame:
    """``quotes`` with ``problem``: item unknown, outlet differs, not verbatim, or across title and lede; NULL if fine.

    Verbatim means within the title or within the lede, white space apart. ``items``
    has one row an id. A NULL quote is not verbatim; a NULL lede is empty.
    """
    i = items.select(F.col("id").alias("item_id"), F.col("outlet").alias("_outlet"), squeeze(F.coalesce("title", F.lit(""))).alias("_title"), squeeze(F.coalesce("lede", F.lit(""))).alias("_lede"))
    q = squeeze(F.coalesce("quote", F.lit("")))
    within = (q != "") & (F.contains("_title", q) | F.contains("_lede", q))
    across = (q != "") & F.contains(F.concat_ws(" ", "_title", "_lede"), q)
    problem = (
        F.when(F.col("_title").isNull(), "item unknown")
        .when(~F.coalesce(F.col("outlet") == F.col("_outlet"), F.lit(False)), "outlet differs")
        .when(within, F.lit(None))
        .when(across, "across title and lede")
        .otherwise("not verbatim")
    )
    return quotes.join(i, "item_id", "left").withColumn("problem", problem).drop("_outlet", "_title", "_lede")


def cluster_problems(analyses: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(cluster_id, disposition)``: missing, superseded, stale or current."""
    c = clusters.select("cluster_id", F.col("version").alias("_version"), F.col("status").alias("_status"))
    d = F.when(F.col("_version").isNull(), "missing").when(F.col("_status") == "superseded", "superseded").when(F.col("cluster_version") != F.col("_version"), "stale").otherwise("current")
    return analyses.join(c, "cluster_id", "left").select("cluster_id", d.alias("disposition"))


def split_valid(rows: DataFrame, problems: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows without any problem, and those with one and the list of theirs."""
    listed = problems.groupBy(key).agg(F.sort_array(F.collect_set("problem")).alias("problems"))
    return rows.join(listed, key, "left_anti"), rows.join(listed, key)
