"""Queries for published tables: feeds, outlets, stories, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, feeds, marts
from .pairs import _GROUPED, known_links, plain_items
from .registry import query, table
from .rows import S

NOW = "2026-09-15T00:00:00Z"
_WORDS = f"len(list_filter(string_split(trim(regexp_replace(coalesce(lede, ''), '{S}+', ' ', 'g')), ' '), lambda w: w <> ''))"
_SAME = f"coalesce(trim(regexp_replace(title, '{S}+', ' ', 'g')) = rtrim(trim(regexp_replace(lede, '{S}+', ' ', 'g')), '.'), false)"
MEASURE_SQL = f"""
    WITH e AS (SELECT *, {_WORDS} AS w, {_SAME} AS same, CAST(published AS TIMESTAMP) AS ts,
      list_filter(list_transform(list_filter(string_split(regexp_extract(link, '\\?([^#]*)', 1), '&'), lambda k: regexp_matches(k, '=.')), lambda k: string_split(k, '=')[1]), lambda k: regexp_matches(k, '(?i)^(utm_|fbclid|gclid|mc_|ref$|source$|at_)')) AS tp FROM incoming),
    b AS (SELECT outlet, count(*) AS entries, list_sort(list(w))[count(*) // 2 + 1] AS median_lede_words, max(w) AS max_lede_words, count(*) FILTER (same) AS equal_title,
      count(*) FILTER (ts <= TIMESTAMP '2026-09-15' AND ts > TIMESTAMP '2026-09-08') AS last_week, max(published) AS newest, round(date_diff('second', max(ts), TIMESTAMP '2026-09-15') / 3600, 6) AS age_hours, count(ts) AS dated FROM e GROUP BY outlet),
    t AS (SELECT outlet, count(DISTINCT k) AS tracking FROM (SELECT outlet, unnest(tp) AS k FROM e) GROUP BY outlet),
    g0 AS (SELECT outlet, date_diff('second', lag(ts) OVER (PARTITION BY outlet ORDER BY ts), ts) / 3600 AS gap FROM e WHERE ts IS NOT NULL),
    g AS (SELECT outlet, list_sort(list(gap))[count(*) // 2 + 1] AS gap FROM g0 WHERE gap IS NOT NULL GROUP BY outlet),
    m AS (SELECT outlet, entries, median_lede_words, max_lede_words, equal_title, last_week, newest, age_hours, coalesce(tracking, 0) AS tracking, CASE WHEN dated > 2 THEN round(gap, 6) END AS gap_hours
      FROM b LEFT JOIN t USING (outlet) LEFT JOIN g USING (outlet))"""


@query("g01_feed_measure", MEASURE_SQL + " SELECT * FROM m")
def measure(spark, d):
    return feeds.measure(table(spark, d, "incoming"), NOW)


@query("d15_feed_gates", MEASURE_SQL + """ SELECT outlet, median_lede_words >= 8 AND equal_title < entries * 0.5 AS has_lede, age_hours IS NULL OR age_hours > 168 AS stale,
    list_filter([CASE WHEN NOT (median_lede_words >= 8 AND equal_title < entries * 0.5) THEN 'no lede' END, CASE WHEN age_hours IS NULL OR age_hours > 168 THEN 'stale' END], lambda r: r IS NOT NULL) AS reasons FROM m""")
def gate(spark, d):
    return feeds.gates(feeds.measure(table(spark, d, "incoming"), NOW)).select("outlet", "has_lede", "stale", "reasons")


MEMBERS_SQL = _GROUPED + """, k AS (SELECT component FROM g GROUP BY component HAVING count(DISTINCT outlet) >= 2), m AS (SELECT g.component AS story, item_id, outlet, published FROM g JOIN k USING (component)),
    v AS (SELECT story, max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS severity FROM (SELECT story, CASE WHEN count(*) > 2 THEN 'high' WHEN count(*) = 2 THEN 'medium' ELSE 'low' END AS severity
      FROM quotes q JOIN m ON m.item_id = q.item_id WHERE claim_id IS NULL GROUP BY story, q.cluster_id) GROUP BY story)"""


def members(spark, d):
    g = clusters.group_items(plain_items(spark, d), known_links(spark, d))
    kept = clusters.component_sizes(g).where("fate = 'kept'").select("component")
    return g.join(kept, "component", "left_semi").select(F.col("component").alias("story"), "item_id", "outlet", "published", "url")


@query("g03_outlet_stats", MEMBERS_SQL + """, o AS (SELECT story, outlet, min(published) AS published FROM m GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY story ORDER BY published) AS r FROM o),
    x AS (SELECT DISTINCT o.story, o.outlet FROM o JOIN (SELECT m.story, q.outlet FROM quotes q JOIN m ON m.item_id = q.item_id WHERE q.claim_id IS NULL) y ON y.story = o.story AND y.outlet = o.outlet)
    SELECT r.outlet, count(*) AS stories, count(*) FILTER (r = 1) AS first_stories, count(x.story) AS discrepancy_stories, round(count(*) FILTER (r = 1) / count(*), 6) AS first_rate, round(count(x.story) / count(*), 6) AS discrepancy_rate
    FROM r LEFT JOIN x ON r.story = x.story AND r.outlet = x.outlet GROUP BY r.outlet""")
def outlet_stats(spark, d):
    m = members(spark, d)
    quoted = table(spark, d, "quotes").where("claim_id IS NULL").select("item_id", "outlet").join(m.select("item_id", "story"), "item_id").select("story", "outlet")
    return marts.outlet_stats(m, quoted)


@query("s04_stories", MEMBERS_SQL + " SELECT story, substr(min(published), 1, 10) AS date, count(DISTINCT outlet) AS outlets, count(*) AS items, coalesce(any_value(v.severity), 0) AS severity FROM m LEFT JOIN v USING (story) GROUP BY story")
def stories(spark, d):
    return marts.story_table(*severities(spark, d))


def severities(spark, d):
    """Members, and discrepancies of a severity by the number of quotes without a claim."""
    m = members(spark, d)
    q = table(spark, d, "quotes").where("claim_id IS NULL").join(m.select("item_id", "story"), "item_id").groupBy("story", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return m, q.select("story", F.when(F.col("n") > 2, "high").when(F.col("n") == 2, "medium").otherwise("low").alias("severity"))


@query("w14_front_page", MEMBERS_SQL + """, s AS (SELECT story, substr(min(published), 1, 10) AS date, count(DISTINCT outlet) AS outlets, count(*) AS items, coalesce(any_value(v.severity), 0) AS severity FROM m LEFT JOIN v USING (story) GROUP BY story)
    SELECT *, row_number() OVER (ORDER BY date DESC, outlets DESC, severity DESC, story DESC) AS place FROM s WHERE date IN (SELECT DISTINCT date FROM s ORDER BY date DESC LIMIT 4)""")
def front(spark, d):
    return marts.front_page(marts.story_table(*severities(spark, d)))


@query("s06_story_links", MEMBERS_SQL + " SELECT story, item_id, outlet, published, row_number() OVER (PARTITION BY story ORDER BY outlet, published, item_id) AS place FROM m")
def links(spark, d):
    return marts.story_links(members(spark, d))


@query("g21_by_outlet", MEMBERS_SQL + " SELECT outlet, substr(published, 1, 10) AS date, count(DISTINCT story) AS stories FROM m GROUP BY 1, 2")
def by_outlet(spark, d):
    return marts.by_outlet(members(spark, d))


@query("w04_first_to_report", MEMBERS_SQL + """, o AS (SELECT story, outlet, min(published) AS published FROM m GROUP BY 1, 2) SELECT story, outlet FROM (SELECT *, rank() OVER (PARTITION BY story ORDER BY published) AS r FROM o) WHERE r = 1""")
def first_to_report(spark, d):
    from pyspark.sql import Window

    at = members(spark, d).groupBy("story", "outlet").agg(F.min("published").alias("published"))
    return at.withColumn("r", F.rank().over(Window.partitionBy("story").orderBy("published"))).where("r = 1").select("story", "outlet")


@query("j23_claim_cells", "SELECT cluster_id, claim_id, outlet, list_sort(list(DISTINCT quote)) AS quotes FROM quotes WHERE claim_id IS NOT NULL GROUP BY 1, 2, 3")
def claim_cells(spark, d):
    return marts.claim_cells(table(spark, d, "quotes"))


@query("j23_claims_matrix", """SELECT cluster_id, claim_id, nullif(count(*) FILTER (outlet = 'pixel-harbor'), 0) AS "pixel-harbor", nullif(count(*) FILTER (outlet = 'deltacourier'), 0) AS deltacourier
    FROM quotes WHERE claim_id IS NOT NULL GROUP BY 1, 2""")
def claims(spark, d):
    return marts.claims_matrix(table(spark, d, "quotes"), ["pixel-harbor", "deltacourier"])


@query("g14_counts", """SELECT (SELECT count(*) FROM items) AS item_rows, (SELECT count(DISTINCT id) FROM items) AS items, (SELECT count(*) FROM judgments) AS judgments, (SELECT count(*) FROM quotes) AS quotes, (SELECT count(*) FROM incoming) AS entries""")
def counts(spark, d):
    t = lambda n: table(spark, d, n)
    i = t("items").groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("item_rows"), F.count("id").alias("items"))
    one = lambda n, name: t(n).agg(F.count(F.lit(1)).alias(name))
    # one row each
    return i.join(F.broadcast(one("judgments", "judgments"))).join(F.broadcast(one("quotes", "quotes"))).join(F.broadcast(one("incoming", "entries")))


@query("g15_run_summary", """WITH s AS (SELECT user_id AS run, value AS seconds, event_type <> 'error' AS ok FROM events WHERE event_type <> 'signup'),
    r AS (SELECT user_id AS run, CASE WHEN user_id % 3 = 0 THEN NULL ELSE sum(value) END AS duration FROM events GROUP BY user_id),
    a AS (SELECT run, sum(seconds) AS t, count(*) FILTER (NOT ok) AS bad, count(*) AS n FROM s GROUP BY run)
    SELECT run, round(duration, 4) AS duration, CASE WHEN duration IS NOT NULL THEN round(greatest(duration - coalesce(t, 0), 0), 4) END AS agent_seconds,
      CASE WHEN coalesce(bad, 0) > 0 THEN 'failed' WHEN coalesce(n, 0) = 0 THEN 'empty' ELSE 'ok' END AS status FROM r LEFT JOIN a USING (run)""")
def run_summary(spark, d):
    e = table(spark, d, "events")
    steps = e.where("event_type <> 'signup'").select(F.col("user_id").alias("run"), F.col("value").alias("seconds"), (F.col("event_type") != "error").alias("ok"))
    runs = e.groupBy(F.col("user_id").alias("run")).agg(F.sum("value").alias("v")).select("run", F.when(F.col("run") % 3 != 0, F.col("v")).alias("duration"))
    return marts.run_summary(runs, steps).select("run", F.round("duration", 4).alias("duration"), F.round("agent_seconds", 4).alias("agent_seconds"), "status")


@query("f07_weighted_score", """WITH x AS (SELECT outlet, count(*) AS n, count(author) AS a, count(lede) AS l FROM items GROUP BY outlet) SELECT outlet, CAST(4.0 * n + 3.0 * a + 2.0 * l AS DOUBLE) AS total FROM x""")
def weighted(spark, d):
    g = table(spark, d, "items").groupBy("outlet").agg(F.count(F.lit(1)).alias("n"), F.count("author").alias("a"), F.count("lede").alias("l"))
    return marts.weighted_score(g, {"n": 4.0, "a": 3.0, "l": 2.0}).select("outlet", "total")


_BUILT = """
    b AS (SELECT DISTINCT cluster_id, claim_id, coalesce(outlet, '') AS outlet, coalesce(item_id, '') AS item_id, coalesce(quote, '') AS quote FROM quotes WHERE cluster_id IS NOT NULL),
    c AS (SELECT cluster_id, count(DISTINCT claim_id) AS claims, bool_or(length(quote) < 3) AS short, bool_or(length(quote) > 400) AS long, bool_or(NOT regexp_matches(claim_id, '^c[0-9]{1,2}$')) AS odd,
      bool_or(NOT regexp_matches(item_id, '^[0-9a-f]{40}$')) AS unknown, bool_or(outlet = '') AS nowhere FROM b WHERE claim_id IS NOT NULL GROUP BY 1),
    d AS (SELECT cluster_id, count(*) AS n, count(DISTINCT outlet) AS outlets, bool_or(length(quote) < 3) AS short, bool_or(length(quote) > 400) AS long,
      bool_or(NOT regexp_matches(item_id, '^[0-9a-f]{40}$')) AS unknown, bool_or(outlet = '') AS nowhere FROM b WHERE claim_id IS NULL GROUP BY 1),
    a AS (SELECT cluster_id FROM b GROUP BY 1),
    e AS (SELECT cluster_id, unnest(list_filter([CASE WHEN NOT regexp_matches(cluster_id, '^[0-9]{4}-[0-9]{2}-[0-9]{2}-[0-9a-f]{6}$') THEN 'cluster_id: pattern' END,
      CASE WHEN coalesce(claims, 0) = 0 THEN 'claims: minItems' END, CASE WHEN claims > 20 THEN 'claims: maxItems' END, CASE WHEN odd THEN 'claims/id: pattern' END,
      CASE WHEN c.short THEN 'claims/sources/quote: minLength' END, CASE WHEN c.long THEN 'claims/sources/quote: maxLength' END, CASE WHEN c.unknown THEN 'claims/sources/item_id: pattern' END, CASE WHEN c.nowhere THEN 'claims/sources/outlet: minLength' END,
      CASE WHEN d.n = 1 THEN 'discrepancies/quotes: minItems' END, CASE WHEN d.short THEN 'discrepancies/quotes/quote: minLength' END, CASE WHEN d.long THEN 'discrepancies/quotes/quote: maxLength' END,
      CASE WHEN d.unknown THEN 'discrepancies/quotes/item_id: pattern' END, CASE WHEN d.nowhere THEN 'discrepancies/quotes/outlet: minLength' END], lambda p: p IS NOT NULL)) AS problem FROM a LEFT JOIN c USING (cluster_id) LEFT JOIN d USING (cluster_id))"""


def built_analyses(spark, d):
    """An analysis of each cluster made of its quotes: those without a claim are one discrepancy."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    q = table(spark, d, "quotes").where("cluster_id IS NOT NULL").select("cluster_id", "claim_id", F.struct(blank("outlet").alias("outlet"), blank("item_id").alias("item_id"), blank("quote").alias("quote")).alias("q")).distinct()
    of_claim = q.where("claim_id IS NOT NULL").groupBy("cluster_id", "claim_id").agg(F.sort_array(F.collect_list("q")).alias("sources"))
    claims = of_claim.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct(F.col("claim_id").alias("id"), F.lit("It was said.").alias("statement"), "sources"))).alias("claims"))
    found = q.where("claim_id IS NULL").groupBy("cluster_id").agg(F.sort_array(F.collect_list("q")).alias("quotes"))
    found = found.select("cluster_id", F.array(F.struct(F.lit("number").alias("kind"), F.lit("low").alias("severity"), F.lit("They differ.").alias("explanation"), "quotes")).alias("discrepancies"))
    whole = q.select("cluster_id").distinct().join(claims, "cluster_id", "left").join(found, "cluster_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(whole.schema[c].dataType))
    text = F.to_json(F.struct(
        "cluster_id", F.lit(1).alias("cluster_version"), F.lit("api").alias("backend"), F.lit("m").alias("model"), F.lit("2026-01-01T00:00:00Z").alias("generated_at"), F.lit("A headline").alias("headline"),
        F.lit("A summary.").alias("summary"), none("claims").alias("claims"), none("discrepancies").alias("discrepancies"), F.lit("partial").alias("agreement"),
    ))
    return whole.select("cluster_id", text.alias("text"))


@query("v01_analysis_problems", f"""WITH {_BUILT} SELECT * FROM e
    UNION ALL SELECT cluster_id, 'discrepancies: one outlet' FROM d WHERE outlets < 2 AND cluster_id NOT IN (SELECT cluster_id FROM e)""")
def analysis_problems(spark, d):
    from ..operators.contract import schema_problems

    return schema_problems(built_analyses(spark, d)).select("cluster_id", "problem")


@query("d13_publishable", f"""WITH {_BUILT},
    k AS (SELECT cluster_id, CASE WHEN count(DISTINCT item_id) % 3 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN count(DISTINCT item_id) % 5 = 0 THEN 'superseded' ELSE 'analyzed' END AS status FROM quotes WHERE claim_id IS NOT NULL GROUP BY 1),
    i AS (SELECT id, min(outlet) AS outlet, min(coalesce(title, '')) AS title, min(coalesce(lede, '')) AS lede FROM items GROUP BY id),
    x AS (SELECT b.*, i.id, i.outlet AS o, trim(regexp_replace(b.quote, '{S}+', ' ', 'g')) AS q, trim(regexp_replace(title, '{S}+', ' ', 'g')) AS t, trim(regexp_replace(lede, '{S}+', ' ', 'g')) AS l FROM b LEFT JOIN i ON i.id = b.item_id),
    w AS (SELECT DISTINCT cluster_id FROM x WHERE id IS NULL OR outlet <> o OR q = '' OR NOT (contains(t, q) OR contains(l, q))
      UNION SELECT cluster_id FROM b WHERE (cluster_id, item_id) NOT IN (SELECT (cluster_id, item_id) FROM quotes WHERE claim_id IS NOT NULL AND item_id IS NOT NULL)
      UNION SELECT cluster_id FROM d WHERE outlets < 2)
    SELECT a.cluster_id AS file_id, CASE WHEN a.cluster_id IN (SELECT cluster_id FROM e) OR version IS NULL THEN 'invalid' WHEN status = 'superseded' OR version <> 1 THEN 'stale'
      WHEN a.cluster_id IN (SELECT cluster_id FROM w) THEN 'invalid' ELSE 'story' END AS outcome FROM a LEFT JOIN k USING (cluster_id)""")
def publishable(spark, d):
    from ..operators.contract import publishable as outcome_of

    q = table(spark, d, "quotes").where("claim_id IS NOT NULL")
    n = q.groupBy("cluster_id").agg(F.countDistinct("item_id").alias("n"))
    stored = n.select("cluster_id", F.when(F.col("n") % 3 == 0, 2).otherwise(1).alias("version"), F.when(F.col("n") % 5 == 0, "superseded").otherwise("analyzed").alias("status"))
    i = table(spark, d, "items").groupBy("id").agg(F.min("outlet").alias("outlet"), F.min(F.coalesce("title", F.lit(""))).alias("title"), F.min(F.coalesce("lede", F.lit(""))).alias("lede"))
    return outcome_of(built_analyses(spark, d).withColumnRenamed("cluster_id", "file_id"), stored, q.select("cluster_id", "item_id"), i)
