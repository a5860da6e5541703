import json

import pytest
from pyspark.sql import functions as F

from storyweft import schemas
from storyweft.backends import ask, embed_by_hash, embed_new
from storyweft.sources import readers, sinks
from storyweft.streaming import ingest

ENTRY = "outlet string, link string, title string, lede string, author string, published string, fetched string"


def items(spark, rows):
    return spark.createDataFrame([(i, "o", f"https://x/{i}", t, "l", None, p, f, []) for i, t, p, f in rows], schemas.ITEM)


def test_append_items_is_idempotent(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    rows = items(spark, [("a", "t", "2026-01-01T00:00:00Z", "1"), ("a", "u", "2026-01-01T05:00:00Z", "0"), ("b", "t", "2026-01-02T00:00:00Z", "1"), ("a", "v", "2026-01-02T00:00:00Z", "1")])
    assert sinks.append_items(rows, root).count() == 3
    assert sinks.append_items(rows, root).count() == 0
    assert readers.read_items(spark, root).count() == 3
    assert {r.id for r in readers.read_items(spark, root, "2026-01-02").collect()} == {"a", "b"}
    assert readers.read_items(spark, root).where("id = 'a' and item_date = '2026-01-01'").first().title == "u"


def test_upsert_writes_only_changes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert sinks.upsert(df, path, "k") == 2 and sinks.upsert(df, path, "k") == 0
    assert sinks.upsert(spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string"), path, "k") == 2
    assert {tuple(r) for r in sinks.read_snapshot(spark, path).collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_insert_once(spark, tmp_path):
    path = f"file://{tmp_path}/j"
    sinks.insert_once(spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), path, "k")
    sinks.insert_once(spark.createDataFrame([("a", 9), ("b", 3)], "k string, v int"), path, "k")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


def test_status_and_runs(spark):
    c = spark.createDataFrame([("a", "pending"), ("b", "superseded")], "cluster_id string, status string")
    assert {tuple(r) for r in sinks.set_status(c, c, "analyzed").collect()} == {("a", "analyzed"), ("b", "superseded")}
    runs = spark.createDataFrame([("d", 5.0, "1"), ("d", None, "2")], "date string, duration_seconds double, finished_at string")
    assert sinks.best_run(runs).first().duration_seconds == 5.0


def test_judgments_strict_types(spark, tmp_path):
    good = {"pair_id": "a-b", "item_id_a": "a", "item_id_b": "b", "same_story": True, "reason": "r", "backend": "x", "model": "m", "judged_at": "t"}
    lines = [json.dumps(good), json.dumps(good | {"same_story": "false"}), json.dumps({k: v for k, v in good.items() if k != "model"}), "{broken"]
    (tmp_path / "j.jsonl").write_text("\n".join(lines))
    ok, bad = readers.read_judgments(spark, f"file://{tmp_path}/j.jsonl")
    assert ok.count() == 1 and bad.count() == 3


def test_json_tables(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\nbroken\n')
    assert readers.read_json_table(spark, f"file://{tmp_path}/a.jsonl", "k int", strict=False).where("k is not null").count() == 1
    with pytest.raises(Exception):
        readers.read_json_table(spark, f"file://{tmp_path}/a.jsonl", "k int").collect()
    assert {r.readable for r in readers.read_numbered_lines(spark, f"file://{tmp_path}/a.jsonl").collect()} == {True, False}


def test_feeds(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<rss><channel><item><title>T</title><link>https://x/1?utm_source=a</link><description>&lt;p&gt;L &amp;amp; m&lt;/p&gt;</description><pubDate>Wed, 16 Sep 2026 14:46:00 +0200</pubDate><category>c</category></item><item><title>no link</title></item></channel></rss>")
    (tmp_path / "a.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="https://y/2" rel="alternate"/><summary>S</summary><updated>2026-09-16T08:00:00-04:00</updated><author><name>N</name></author></entry></feed>')
    entries = readers.feed_entries(spark, [("o", "rss", f"file://{tmp_path}/r.xml"), ("p", "atom", f"file://{tmp_path}/a.xml")])
    from storyweft.operators.feeds import to_items

    rows = {r.outlet: r for r in to_items(entries).collect()}
    assert rows["o"].url == "https://x/1" and rows["o"].published == "2026-09-16T12:46:00Z" and rows["o"].tags == ["c"] and rows["o"].lede == "L & m"
    assert rows["p"].url == "https://y/2" and rows["p"].published == "2026-09-16T12:00:00Z" and rows["p"].author == "N"


def test_streaming_ingest(spark, tmp_path):
    src, root, ck = (f"file://{tmp_path}/{n}" for n in ("src", "root", "ck"))
    rows = [("o", "https://x/1", "t", "l", None, "2026-01-01T00:00:00Z", "2026-01-01T01:00:00Z"), ("o", None, "t", "l", None, None, "2026-01-01T01:00:00Z"), ("o", "https://x/2?utm_x=1", "t", "l", None, None, "2026-01-03T01:00:00Z")]
    spark.createDataFrame(rows, ENTRY).write.parquet(src)
    ingest.ingest_entries(spark, src, ENTRY, root, ck).awaitTermination()
    spark.createDataFrame(rows[:1], ENTRY).write.mode("append").parquet(src)
    ingest.ingest_entries(spark, src, ENTRY, root, ck).awaitTermination()
    stored = readers.read_items(spark, root)
    assert stored.count() == 2 and {str(r.item_date) for r in stored.collect()} == {"2026-01-01", "2026-01-03"}


def test_streaming_windows(spark, tmp_path):
    spark.sql("select timestamp'2026-01-01 00:00:00' ts, 'a' k, 1.0d value union all select timestamp'2026-01-01 01:00:00', 'a', 2.0d union all select timestamp'2026-01-09 01:00:00', 'a', 2.0d").write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp, k string, value double").parquet(f"file://{tmp_path}/e")
    seen = []
    ingest.run_once(ingest.windowed_counts(stream, "ts", "1 day", "1 day", "1 day", ["k"]), lambda df, _: seen.extend(df.collect()), f"file://{tmp_path}/c")
    assert {(r.n, r.total) for r in seen} == {(2, 3.0)}


def test_backends(spark):
    class Fake:
        model_id = "fake"

        def embed(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    i = items(spark, [("a", "t", "1", "1"), ("b", "tt", "1", "1"), ("a", "ttt", "1", "2")])
    have = spark.createDataFrame([("b", "fake", 2, [0.0, 1.0])], "item_id string, model_id string, dim int, vector array<double>")
    assert [tuple(r) for r in embed_new(i, have, Fake, "fake").collect()] == [("a", "fake", 2, [5.0, 1.0])]
    assert embed_by_hash(i, have).count() == 2

    def make():
        tries = []

        def post(body):
            if len(tries) > 1:
                raise RuntimeError("asked again")
            if body == "bad":
                raise RuntimeError("no")
            if body == "refused":
                error = RuntimeError("bad request")
                error.status = 400
                tries.append(body)
                raise error
            return {"high": 2.0, "true": True, "text": "0.5"}.get(body, 0.5)

        return post

    q = spark.createDataFrame([("p", "ok"), ("q", "bad"), ("r", "high"), ("s", "true"), ("t", "text"), ("u", "refused")], "pair_id string, body string")
    assert {r.pair_id: (r.p, r.error) for r in ask(q.coalesce(1), make, wait=0).collect()} == {
        "p": (0.5, None), "q": (None, "no"), "r": (None, "outside [0, 1]"), "s": (None, "True is no number"), "t": (None, "'0.5' is no number"), "u": (None, "bad request"),
    }


def test_settings(tmp_path, spark):
    (tmp_path / "c.yaml").write_text("tau_low: 0.6\ntau_high: 0.8\n")
    assert readers.load_settings(str(tmp_path / "c.yaml")).tau_high == 0.8
    with pytest.raises(ValueError):
        readers.ClusterSettings(0.9, 0.8)
    (tmp_path / "o.yaml").write_text("outlets:\n  - {slug: a, display_name: A, homepage: h, feed_url: f}\n")
    assert readers.load_outlets(spark, str(tmp_path / "o.yaml")).first().slug == "a"


def test_stable_json(spark):
    df = spark.createDataFrame([(1, None)], "b int, a string")
    assert sinks.stable_json(df).first().json == '{"a":null,"b":1}'
    assert df.select(F.lit(1)).count() == 1
