"""Addresses, hashes and identifiers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: Fixed value: names of query parameters that only track.
TRACKING = r"(?i)^(utm_|fbclid|gclid|mc_|ref$|source$|at_)"
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _encode(c: Column) -> Column:
    """Form encoding with ``*`` escaped and ``~`` bare."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def canonical_url(url: Column) -> Column:
    """One form of an item's address.

    Scheme and host in lower case; path as it is; default and unreadable ports, user
    names, fragments and tracking parameters dropped; other parameters kept in order
    and encoded alike, blank values included.
    """
    u = F.regexp_replace(F.btrim(url), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(u, _URL, 1))
    authority = F.regexp_extract(u, _URL, 2)
    path, query = F.regexp_extract(u, _URL, 3), F.regexp_extract(u, _URL, 4)
    place = F.regexp_replace(authority, "^.*@", "")
    host = F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(place, r":0*(\d{1,5})$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    keep = (port != "") & ~default
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p: F.struct(_decode(F.substring_index(p, "=", 1)).alias("k"), _decode(F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("v")))
    kept = F.transform(F.filter(named, lambda q: ~q["k"].rlike(TRACKING)), lambda q: F.concat(_encode(q["k"]), F.lit("="), _encode(q["v"])))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when((host != "") | (authority != ""), F.concat(F.lit("//"), host, F.when(keep, F.concat(F.lit(":"), port)).otherwise(""))).otherwise(""),
        path,
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
    )


def tracking_params(url: Column) -> Column:
    """Tracking parameters of an address that have a value, in their order."""
    query = F.regexp_extract(url, _URL, 4)
    pairs = F.filter(F.split(query, "&"), lambda p: F.contains(p, F.lit("=")) & ~p.endswith("="))
    return F.filter(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)), lambda k: k.rlike(TRACKING))


def item_id(url: Column) -> Column:
    """sha1 of the canonical address."""
    return F.sha1(canonical_url(url))


def cluster_id(anchor: Column, published: Column, probe: int | None = None) -> Column:
    """Date of the anchor and six hex digits of its hash; a probe number is mixed in on collisions."""
    text = anchor if probe is None else F.concat(anchor, F.lit("\0"), F.lit(str(probe)))
    return F.concat(F.substring(published, 1, 10), F.lit("-"), F.substring(F.sha1(text), 1, 6))


def pair_id(a: Column, b: Column) -> Column:
    """The two ids in order, joined by a hyphen."""
    return F.concat(F.least(a, b), F.lit("-"), F.greatest(a, b))


@F.pandas_udf(StringType())
def scatter(ids: pd.Series) -> pd.Series:
    """Eight bytes of BLAKE2b as hex: an order that has nothing to do with the id."""
    return ids.map(lambda t: None if t is None else hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest())


@F.pandas_udf(BooleanType())
def in_tuning_half(ids: pd.Series) -> pd.Series:
    """Whether one byte of BLAKE2b of the id is even."""
    return ids.map(lambda t: None if t is None else hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=1).digest()[0] % 2 == 0)


def external_url(raw: Column) -> Column:
    """Web addresses, trimmed; anything else as ''."""
    u = F.btrim(raw)
    return F.coalesce(F.when(u.rlike("(?i)^https?://"), u), F.lit(""))


def base_path(raw: Column) -> Column:
    """Path with one slash at either end."""
    bare = F.btrim(F.btrim(raw), F.lit("/"))
    return F.when(bare == "", "/").otherwise(F.concat(F.lit("/"), bare, F.lit("/")))
