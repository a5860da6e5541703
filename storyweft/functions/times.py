"""Times as ISO-8601 UTC strings, and their parsing. The session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso_utc(ts: Column) -> Column:
    """``2026-01-05T01:06:14Z``."""
    return F.date_format(ts, ISO)


def parse_time(raw: Column) -> Column:
    """Timestamp of an RFC-822 or ISO-8601 text with any offset; NULL if it is neither."""
    bare = F.regexp_replace(F.btrim(raw), r"^[A-Za-z]{3,9},\s*", "")
    zoned = F.regexp_replace(bare, r"\s(GMT|UT|UTC|Z)$", " +0000")
    rfc = [F.try_to_timestamp(zoned, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")]
    return F.coalesce(F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(bare)), F.when(zoned.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} "), F.coalesce(*rfc)))


def published_time(published: Column, updated: Column, fetched: Column) -> Column:
    """ISO form of the first that can be read: published, updated, fetched."""
    return iso_utc(F.coalesce(parse_time(published), parse_time(updated), parse_time(fetched)))


def window_start(now: str, days: int) -> Column:
    """ISO form of ``days`` before ``now``; the clock is always given."""
    return iso_utc(F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def is_timestamp(c: Column) -> Column:
    """Whether the text is exactly of the ISO form; NULL is not."""
    strict = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
    return F.coalesce(c.rlike(strict) & F.try_to_timestamp(c, F.lit(ISO)).isNotNull(), F.lit(False))


def format_duration(seconds: Column) -> Column:
    """``—`` for NULL, ``<1s``, ``12s``, ``3m 05s``, ``2h 07m``."""
    s = F.floor(seconds)
    return (
        F.when(seconds.isNull(), "—")
        .when(seconds < 1, "<1s")
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
    )
