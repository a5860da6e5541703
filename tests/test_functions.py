import html

import pytest
from pyspark.sql import functions as F

from storyweft.functions import text as T
from storyweft.functions import times as D
from storyweft.functions import urls as U
from storyweft.functions import vectors as V


def one(spark, make, *values, kinds=None):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {k}" for n, k in zip(names, kinds or ["string"] * len(values))))
    return df.select(make(*map(F.col, names)).alias("r")).first().r


@pytest.mark.parametrize("raw, plain", [
    ("<p>A &amp; B</p>", "A & B"), ("&lt;b&gt;x", "<b>x"), ("a  b\n c", "a b c"), ("", ""), (None, None), ("<br/>", ""), ("x" * 40000, "x" * 40000),
])
def test_plain_text(spark, raw, plain):
    assert one(spark, T.plain_text, raw) == plain
    if raw and "&" in raw:
        assert html.unescape("&amp;") == "&"


def test_words(spark):
    assert one(spark, T.word_count, " a  b c ") == 3 and one(spark, T.word_count, "") == 0 and one(spark, T.word_count, None) is None
    assert one(spark, lambda c: T.first_words(c, 2), " a b  c") == "a b"
    assert one(spark, T.slugify, "--Héllo, World 2!") == "h-llo-world-2"
    assert one(spark, T.author_name, "a@b.c (Some Name)") == "Some Name" and one(spark, T.author_name, "") is None
    assert one(spark, T.clean_tags, [" a ", "", None, "b  c"], kinds=["array<string>"]) == ["a", "b c"]
    assert one(spark, T.lede_of, None, "", "<i>x</i>") == "x"


@pytest.mark.parametrize("raw, canonical", [
    ("HTTPS://Example.COM/Some/Mixed-Case/Path?utm_source=x", "https://example.com/Some/Mixed-Case/Path"), ("https://a.b:443/x/", "https://a.b/x/"), ("https://a.b:8443/x#f", "https://a.b:8443/x"),
    ("http://host:abc/x", "http://host/x"), ("http://u:p@a.b/x?b=&a=1&ref=z&fbclid=1", "http://a.b/x?b=&a=1"), ("http://a.b/?q=a b~*", "http://a.b/?q=a+b~%2A"), (None, None),
])
def test_canonical_url(spark, raw, canonical):
    assert one(spark, U.canonical_url, raw) == canonical
    if canonical and "~" not in canonical:
        assert one(spark, U.canonical_url, canonical) == canonical


def test_ids(spark):
    assert one(spark, U.pair_id, "b", "a") == "a-b"
    assert one(spark, U.cluster_id, "x", "2026-01-02T00:00:00Z").startswith("2026-01-02-")
    assert one(spark, U.external_url, " HTTPS://x ") == "HTTPS://x" and one(spark, U.external_url, "javascript:1") == "" and one(spark, U.external_url, None) == ""
    assert one(spark, U.base_path, "/a/b/") == "/a/b/" and one(spark, U.base_path, "") == "/"
    assert len(one(spark, U.scatter, "a-b")) == 16 and one(spark, U.in_tuning_half, "a-b") in (True, False)


@pytest.mark.parametrize("raw, iso", [
    ("2026-09-16T08:00:00-04:00", "2026-09-16T12:00:00Z"), ("Wed, 16 Sep 2026 14:46:00 +0200", "2026-09-16T12:46:00Z"), ("Wed, 16 Sep 2026 10:42:07 GMT", "2026-09-16T10:42:07Z"),
    ("Wed, 16 Sep 2026 10:00:10 -0400", "2026-09-16T14:00:10Z"), ("nonsense", None), (None, None), ("", None),
])
def test_times(spark, raw, iso):
    assert one(spark, lambda c: D.iso_utc(D.parse_time(c)), raw) == iso


@pytest.mark.parametrize("seconds, text", [(None, "—"), (0.4, "<1s"), (59.9, "59s"), (60.0, "1m 00s"), (3725.0, "1h 02m")])
def test_duration(spark, seconds, text):
    assert one(spark, D.format_duration, seconds, kinds=["double"]) == text


def test_vectors(spark):
    a = ["array<double>"] * 2
    assert one(spark, V.cosine, [0.0, 0.0], [1.0, 1.0], kinds=a) == 0.0
    assert abs(one(spark, V.cosine, [1.0, 1.0], [2.0, 2.0], kinds=a) - 1) < 1e-12
    assert one(spark, lambda s: V.sample_bucket(s, 0.3, 0.05), 0.95, kinds=["double"]) == 12
    assert one(spark, lambda s: V.sample_bucket(s, 0.3, 0.05), 0.1, kinds=["double"]) == 0
    assert one(spark, lambda s: V.band(s, [0.8, 0.6]), 0.7, kinds=["double"]) == 0.6
    assert one(spark, V.verdict, 0.5, kinds=["double"]) is None
    assert one(spark, V.rate, 1.0, 0.0, kinds=["double"] * 2) == 0.0 and one(spark, V.rate_or_null, 1.0, 0.0, kinds=["double"] * 2) is None
    assert all(-1 <= x < 1 for x in one(spark, V.hash_vector, "text"))
