"""Queries that work row by row: scans, projections, predicates, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import times as D
from ..functions import urls as U
from ..functions import vectors as V
from ..operators import dedupe, feeds, judging
from .registry import query, table

#: White space as the SQL side writes it.
S = r"[\s\v\x{85}\p{Z}]"


def squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{S}+', ' ', 'g'))"


def words(c: str) -> str:
    return f"list_filter(string_split({squeezed(c)}, ' '), lambda w: w <> '')"


NOW = "2026-08-01T00:00:00Z"

_URL_PARTS = r"""
    SELECT *, lower(regexp_extract(link, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS s,
      lower(regexp_extract(link, '^[^:]+://([^/?#:]*)', 1)) AS h, regexp_extract(link, '^[^:]+://[^/?#:]*:0*([0-9]+)', 1) AS port,
      regexp_extract(link, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path,
      list_filter(string_split(regexp_extract(link, '\?([^#]*)', 1), '&'), lambda k: k <> '') AS q"""
_CANONICAL = r"""s || '://' || h || CASE WHEN port = '' OR (s = 'http' AND port = '80') OR (s = 'https' AND port = '443') THEN '' ELSE ':' || port END || path
      || CASE WHEN len(list_filter(q, lambda k: NOT regexp_matches(k, '(?i)^(utm_|fbclid|gclid|mc_|ref(=|$)|source(=|$)|at_)'))) = 0 THEN ''
         ELSE '?' || array_to_string(list_filter(q, lambda k: NOT regexp_matches(k, '(?i)^(utm_|fbclid|gclid|mc_|ref(=|$)|source(=|$)|at_)')), '&') END"""


@query("a03_latest_items", """
    SELECT id, outlet, title, fetched FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched DESC NULLS LAST, published DESC NULLS LAST, title NULLS LAST, lede NULLS LAST, url NULLS LAST, outlet NULLS LAST) AS r
      FROM items WHERE id IS NOT NULL) WHERE r = 1""")
def latest_items(spark, d):
    return dedupe.latest_by_id(table(spark, d, "items")).select("id", "outlet", "title", "fetched")


@query("a04_items_since", f"SELECT id, published FROM items WHERE published >= '{NOW}'")
def items_since(spark, d):
    return table(spark, d, "items").where(F.col("published") >= NOW).select("id", "published")


@query("a14_vectors_of_model", """
    SELECT item_id, dim FROM vectors WHERE model_id = 'prism-32m' AND item_id IN (SELECT id FROM items)""")
def vectors_of_model(spark, d):
    from ..sources.readers import vectors_of

    return vectors_of(table(spark, d, "vectors"), "prism-32m", table(spark, d, "items").select(F.col("id").alias("item_id"))).select("item_id", "dim")


@query("c01_plain_text")
def plain_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.plain_text(F.col("text")).alias("plain"))


@query("c03_first_words", f"SELECT id, array_to_string(list_slice({words('lede')}, 1, 10), ' ') AS head FROM items")
def first_words(spark, d):
    return table(spark, d, "items").select("id", T.first_words(F.col("lede"), 10).alias("head"))


@query("c04_author", r"""
    SELECT entry_id, CASE WHEN regexp_extract(author, '^\S+@\S+\s*\((.+)\)$', 1) <> '' THEN regexp_extract(author, '^\S+@\S+\s*\((.+)\)$', 1) ELSE nullif(author, '') END AS author FROM incoming""")
def author(spark, d):
    return table(spark, d, "incoming").select("entry_id", T.author_name(F.col("author")).alias("author"))


def unmarked(c: str) -> str:
    """Text without tags, the five basic entities and the no-break space resolved."""
    out = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{sign}')"
    return out


@query("c05_tags", f"SELECT id, list_filter(list_transform(tags, lambda t: {squeezed(unmarked('t'))}), lambda t: t <> '') AS tags FROM items")
def tags(spark, d):
    return table(spark, d, "items").select("id", T.clean_tags(F.col("tags")).alias("tags"))


@query("c06_folded_title", f"SELECT id, lower({squeezed('title')}) AS folded FROM items")
def folded_title(spark, d):
    return table(spark, d, "items").select("id", T.folded_words(F.col("title")).alias("folded"))


@query("c07_word_count", f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN len({words('text')}) END AS words FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("c08_slug", "SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM items")
def slug(spark, d):
    return table(spark, d, "items").select("id", T.slugify(F.col("title")).alias("slug"))


@query("c09_embed_text", "SELECT id, coalesce(title, '') || ' ' || coalesce(lede, '') AS text FROM items")
def embed_text(spark, d):
    return table(spark, d, "items").select("id", T.embed_text(F.col("title"), F.col("lede")).alias("text"))


@query("c11_canonical_url", f"WITH p AS ({_URL_PARTS} FROM incoming WHERE link IS NOT NULL) SELECT entry_id, {_CANONICAL} AS url FROM p")
def canonical_url(spark, d):
    return table(spark, d, "incoming").where("link IS NOT NULL").select("entry_id", U.canonical_url(F.col("link")).alias("url"))


@query("c12_tracking_params", r"""
    SELECT entry_id, list_filter(list_transform(list_filter(string_split(regexp_extract(link, '\?([^#]*)', 1), '&'), lambda k: regexp_matches(k, '=.')), lambda k: string_split(k, '=')[1]),
      lambda k: regexp_matches(k, '(?i)^(utm_|fbclid|gclid|mc_|ref$|source$|at_)')) AS params FROM incoming""")
def tracking(spark, d):
    return table(spark, d, "incoming").select("entry_id", U.tracking_params(F.col("link")).alias("params"))


@query("c13_item_id", f"WITH p AS ({_URL_PARTS} FROM incoming WHERE link IS NOT NULL) SELECT entry_id, sha1({_CANONICAL}) AS item_id FROM p")
def item_id(spark, d):
    return table(spark, d, "incoming").where("link IS NOT NULL").select("entry_id", U.item_id(F.col("link")).alias("item_id"))


@query("c14_cluster_id", "SELECT id, substr(published, 1, 10) || '-' || substr(sha1(id), 1, 6) AS cluster_id FROM items")
def cluster_id(spark, d):
    return table(spark, d, "items").select("id", U.cluster_id(F.col("id"), F.col("published")).alias("cluster_id"))


@query("c15_pair_id", "SELECT least(a, b) || '-' || greatest(a, b) AS pair_id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score FROM pairs")
def pair_id(spark, d):
    return table(spark, d, "pairs").select(U.pair_id(F.col("a"), F.col("b")).alias("pair_id"), F.nanvl("score", F.lit(None).cast("double")).alias("score"))


@query("c16_scatter")
def scatter(spark, d):
    ids = table(spark, d, "judgments").select("pair_id").distinct()
    return ids.select("pair_id", U.scatter("pair_id").alias("scatter"), U.in_tuning_half("pair_id").alias("tuning"))


@query("c19_external_url", "SELECT entry_id, CASE WHEN regexp_matches(trim(link), '(?i)^https?://') THEN trim(link) ELSE '' END AS url FROM incoming")
def external_url(spark, d):
    return table(spark, d, "incoming").select("entry_id", U.external_url(F.col("link")).alias("url"))


@query("c20_base_path", "SELECT DISTINCT outlet, CASE WHEN trim(outlet, '/') = '' THEN '/' ELSE '/' || trim(outlet, '/') || '/' END AS base FROM items")
def base_path(spark, d):
    return table(spark, d, "items").select("outlet", U.base_path(F.col("outlet")).alias("base")).distinct()


@query("c21_published_time", "SELECT entry_id, coalesce(published, fetched) AS published FROM incoming")
def published_time(spark, d):
    null = F.lit(None).cast("string")
    return table(spark, d, "incoming").select("entry_id", D.published_time(F.col("published"), null, F.col("fetched")).alias("published"))


@query("c22_iso_utc", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def iso_utc(spark, d):
    return table(spark, d, "events").select("event_id", D.iso_utc(F.col("ts")).alias("at"))


@query("c23_window_start", f"SELECT id FROM items WHERE published >= strftime(TIMESTAMP '2026-08-01' - INTERVAL 4 DAY, '%Y-%m-%dT%H:%M:%SZ')")
def in_window(spark, d):
    return table(spark, d, "items").where(F.col("published") >= D.window_start(NOW, 4)).select("id")


@query("c25_duration", """
    SELECT event_id, CASE WHEN value IS NULL THEN '—' WHEN value * 20 < 1 THEN '<1s' WHEN floor(value * 20) < 60 THEN CAST(CAST(floor(value * 20) AS BIGINT) AS VARCHAR) || 's'
      WHEN floor(value * 20) < 3600 THEN printf('%dm %02ds', CAST(floor(floor(value * 20) / 60) AS BIGINT), CAST(floor(value * 20) AS BIGINT) % 60)
      ELSE printf('%dh %02dm', CAST(floor(floor(value * 20) / 3600) AS BIGINT), CAST(floor((CAST(floor(value * 20) AS BIGINT) % 3600) / 60) AS BIGINT)) END AS took FROM events""")
def duration(spark, d):
    return table(spark, d, "events").select("event_id", D.format_duration(F.col("value") * 20).alias("took"))


@query("c26_is_timestamp", r"""
    SELECT pair_id, judged_at, coalesce(regexp_matches(judged_at, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$'), false) AS ok FROM judgments""")
def is_timestamp(spark, d):
    return table(spark, d, "judgments").select("pair_id", "judged_at", D.is_timestamp(F.col("judged_at")).alias("ok"))


@query("c27_cosine", """
    SELECT a.vec_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))
      / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


@query("c28_hash_vector", """
    SELECT id, list_transform(range(0, 8), lambda i: CAST(CAST('0x' || substr(sha256(coalesce(title, '') || ' ' || coalesce(lede, '')), CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT) AS DOUBLE) / 4294967296.0 * 2 - 1) AS vector
    FROM items""")
def hash_vector(spark, d):
    return table(spark, d, "items").select("id", V.hash_vector(T.embed_text(F.col("title"), F.col("lede"))).alias("vector"))


@query("c29_sample_bucket", """
    SELECT a, b, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, CASE WHEN score IS NOT NULL AND NOT isnan(score) THEN least(greatest(CAST(floor((round(score, 6) - 0.3) / 0.05) AS INTEGER), 0), 13) END AS bucket FROM pairs""")
def sample_bucket(spark, d):
    fine = F.col("score").isNotNull() & ~F.isnan("score")
    return table(spark, d, "pairs").select("a", "b", F.nanvl("score", F.lit(None).cast("double")).alias("score"), F.when(fine, V.sample_bucket(F.col("score"), 0.3, 0.05)).alias("bucket"))


@query("c30_spread_bucket", """
    WITH p AS (SELECT * FROM pairs WHERE score IS NOT NULL AND NOT isnan(score)), e AS (SELECT min(score) AS lo, max(score) AS hi FROM p)
    SELECT a, b, score, CASE WHEN hi <= lo THEN 0 ELSE least(greatest(CAST(floor((score - lo) / (hi - lo) * 8) AS INTEGER), 0), 7) END AS bucket FROM p, e""")
def spread_bucket(spark, d):
    p = table(spark, d, "pairs").where(F.col("score").isNotNull() & ~F.isnan("score"))
    ends = p.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return p.join(F.broadcast(ends)).select("a", "b", "score", V.spread_bucket(F.col("score"), F.col("lo"), F.col("hi")).alias("bucket"))


EDGES = [0.80, 0.75, 0.70, 0.65, 0.60]


@query("c31_band", """
    SELECT a, b, score, CASE WHEN score >= 0.80 THEN 0.80 WHEN score >= 0.75 THEN 0.75 WHEN score >= 0.70 THEN 0.70 WHEN score >= 0.65 THEN 0.65 WHEN score >= 0.60 THEN 0.60 ELSE 0 END::DOUBLE AS band
    FROM pairs WHERE score IS NOT NULL AND NOT isnan(score)""")
def band(spark, d):
    p = table(spark, d, "pairs").where(F.col("score").isNotNull() & ~F.isnan("score"))
    return p.select("a", "b", "score", V.band(F.col("score"), EDGES).alias("band"))


@query("c32_verdict", "SELECT a, b, score, CASE WHEN score >= 0.9 THEN true WHEN score < 0.5 THEN false END AS same FROM pairs WHERE score IS NOT NULL AND NOT isnan(score)")
def verdict(spark, d):
    p = table(spark, d, "pairs").where(F.col("score").isNotNull() & ~F.isnan("score"))
    return p.select("a", "b", "score", V.verdict(F.col("score"), 0.9, 0.5).alias("same"))


@query("c35_rates", """
    SELECT backend, CASE WHEN count(*) = 0 THEN 0 ELSE round(count(same_story) / count(*), 6) END AS answered,
      round(count(*) FILTER (same_story) / nullif(count(same_story), 0), 6) AS yes FROM judgments GROUP BY backend""")
def rates(spark, d):
    g = table(spark, d, "judgments").groupBy("backend").agg(F.count(F.lit(1)).alias("n"), F.count("same_story").alias("a"), F.count_if("same_story").alias("y"))
    return g.select("backend", F.round(V.rate(F.col("a"), F.col("n")), 6).alias("answered"), F.round(V.rate_or_null(F.col("y"), F.col("a")), 6).alias("yes"))


@query("c41_round_score", "SELECT a, b, round(score, 6) AS score FROM pairs WHERE score IS NOT NULL AND NOT isnan(score)")
def round_score(spark, d):
    return table(spark, d, "pairs").where(F.col("score").isNotNull() & ~F.isnan("score")).select("a", "b", F.round("score", 6).alias("score"))


@query("d01_skipped_entries", "SELECT outlet, count(*) AS entries, count(*) FILTER (link IS NULL OR trim(link) = '') AS skipped FROM incoming GROUP BY outlet")
def skipped(spark, d):
    return feeds.skipped_entries(table(spark, d, "incoming"))


@query("d01_to_items", f"""
    WITH p AS ({_URL_PARTS} FROM incoming WHERE link IS NOT NULL AND trim(link) <> '')
    SELECT sha1({_CANONICAL}) AS id, outlet, {_CANONICAL} AS url, coalesce(published, fetched) AS published, nullif(author, '') AS author FROM p""")
def to_items(spark, d):
    return feeds.to_items(table(spark, d, "incoming")).select("id", "outlet", "url", "published", "author")


TAGS = ["games", "media"]
PATTERNS = {"question": [r"^why\b", r"^how\b"], "list": [r"[0-9]+%", r"^[0-9,]+ days"]}


@query("d03_title_class", f"""
    SELECT id, CASE WHEN list_has_any(list_transform(tags, lambda t: lower({squeezed('t')})), ['games', 'media']) THEN 'tag'
      WHEN regexp_matches(title, '(?i)(?:^why\\b)|(?:^how\\b)') THEN 'question' WHEN regexp_matches(title, '(?i)(?:[0-9]+%)|(?:^[0-9,]+ days)') THEN 'list' END AS class FROM items""")
def title_class(spark, d):
    return table(spark, d, "items").select("id", feeds.title_class(F.col("title"), F.col("tags"), TAGS, PATTERNS).alias("class"))


BACKENDS = ["nightly", "quickjudge", "api"]


@query("d16_judgment_problems", """
    WITH k AS (SELECT DISTINCT a || '-' || b AS pair_id FROM pairs)
    SELECT j.pair_id, j.judged_at, CASE WHEN k.pair_id IS NULL THEN 'no such pair'
      WHEN j.pair_id <> least(lower(trim(item_id_a)), lower(trim(item_id_b))) || '-' || greatest(lower(trim(item_id_a)), lower(trim(item_id_b))) THEN 'ids differ from the pair'
      WHEN same_story IS NULL THEN 'no answer' WHEN NOT coalesce(backend IN ('nightly', 'quickjudge', 'api'), false) THEN 'unknown backend' WHEN coalesce(trim(model), '') = '' THEN 'no model'
      WHEN reason IS NULL OR length(trim(reason)) NOT BETWEEN 10 AND 300 THEN 'reason too short or long' END AS problem
    FROM judgments j LEFT JOIN k ON j.pair_id = k.pair_id""")
def judgment_problems(spark, d):
    known = table(spark, d, "pairs").select(F.concat("a", F.lit("-"), "b").alias("pair_id"))
    return judging.checked_judgments(table(spark, d, "judgments"), known, BACKENDS).select("pair_id", "judged_at", "problem")


@query("b01_new_items", f"""
    WITH p AS ({_URL_PARTS} FROM incoming WHERE link IS NOT NULL AND trim(link) <> ''),
    n AS (SELECT sha1({_CANONICAL}) AS id, coalesce(published, fetched) AS published, fetched, entry_id FROM p)
    SELECT id, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY entry_id) AS r FROM n) WHERE r = 1 AND id NOT IN (SELECT id FROM items)""")
def new_items(spark, d):
    entries = table(spark, d, "incoming").where(F.btrim("link") != "").select(U.item_id(F.col("link")).alias("id"), "entry_id")
    return dedupe.new_rows(entries, table(spark, d, "items"), ["id"], [F.col("entry_id")])


@query("b04_changed_rows", """
    SELECT id FROM (SELECT id, fetched, row_number() OVER (PARTITION BY id ORDER BY fetched DESC) AS r, count(DISTINCT fetched) OVER (PARTITION BY id) AS n FROM items)
    WHERE r = 1 AND n > 1""")
def changed(spark, d):
    from ..sources.sinks import changed_rows

    t = table(spark, d, "items").groupBy("id")
    return changed_rows(t.agg(F.max("fetched").alias("fetched")), t.agg(F.min("fetched").alias("fetched")), "id").select("id")


@query("w01_windowed_events", """
    SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed(spark, d):
    from ..streaming.ingest import windowed_counts

    w = windowed_counts(table(spark, d, "events"), "ts", "1 day", "1 day", "4 days", ["event_type"])
    return w.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("t01_sessions", """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session(spark, d):
    from ..streaming.ingest import sessions

    return sessions(table(spark, d, "events"), "ts", "1 day", "1 day", "user_id")


@query("w03_gaps", """
    SELECT event_id, date_diff('second', date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), date_trunc('second', ts)) AS gap FROM events""")
def gaps(spark, d):
    e = feeds.with_previous_time(table(spark, d, "events"), "user_id", "ts", "event_id", "before")
    return e.select("event_id", (F.unix_timestamp("ts") - F.unix_timestamp("before")).alias("gap"))


@query("w15_first_of_group", "SELECT outlet, id FROM (SELECT outlet, id, row_number() OVER (PARTITION BY outlet ORDER BY published, id, fetched) AS r FROM items) WHERE r = 1")
def first_of_group(spark, d):
    return dedupe.first_by(table(spark, d, "items"), ["outlet"], [F.col("published"), F.col("id"), F.col("fetched")]).select("outlet", "id")


@query("c10_pair_question", """
    SELECT pair_id, CAST(json_object('title', x.title, 'other', y.title) AS VARCHAR) AS question FROM (SELECT DISTINCT a || '-' || b AS pair_id, a, b FROM pairs) p
    JOIN (SELECT id, min(coalesce(title, '')) AS title FROM items GROUP BY id) x ON p.a = x.id JOIN (SELECT id, min(coalesce(title, '')) AS title FROM items GROUP BY id) y ON p.b = y.id""")
def pair_question(spark, d):
    i = table(spark, d, "items").groupBy("id").agg(F.min(F.coalesce("title", F.lit(""))).alias("title"))
    p = table(spark, d, "pairs").select("a", "b").distinct().withColumn("pair_id", F.concat("a", F.lit("-"), "b"))
    j = p.join(i.select(F.col("id").alias("a"), F.col("title").alias("x")), "a").join(i.select(F.col("id").alias("b"), F.col("title").alias("y")), "b")
    return j.select("pair_id", T.pair_question(F.col("x").alias("title"), F.col("y").alias("other")).alias("question"))


@query("b13_stable_json", """SELECT CAST(to_json({'author': author, 'fetched': fetched, 'id': id, 'lede': lede, 'outlet': outlet, 'published': published, 'tags': tags, 'title': title, 'url': url}) AS VARCHAR) AS json FROM items""")
def stable_json(spark, d):
    from ..sources.sinks import stable_json as as_json

    return as_json(table(spark, d, "items"))


@query("b14_best_run", """
    SELECT date, event_id FROM (SELECT strftime(ts, '%Y-%m-%d') AS date, event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY (event_type = 'error'), strftime(ts, '%Y-%m-%dT%H:%M:%S') || event_id DESC) AS r FROM events) WHERE r = 1""")
def best_run(spark, d):
    from ..sources.sinks import best_run as best

    e = table(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("date"), "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("duration_seconds"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id").cast("string")).alias("finished_at"),
    )
    return best(e).select("date", "event_id")
