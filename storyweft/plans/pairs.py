"""Queries on pairs of items: scoring, routing, joins, components, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, components, dedupe, judging, pairs
from ..operators.contract import quote_problems
from .registry import query, table

#: Pairs that can be compared, once each, with their id.
PAIRS_SQL = """p AS (SELECT a, b, a || '-' || b AS pair_id, max(outlet_a) AS outlet_a, max(outlet_b) AS outlet_b, max(score) AS score
      FROM pairs WHERE score IS NOT NULL AND NOT isnan(score) AND a <> b GROUP BY a, b)"""
#: The last answer of each pair.
LAST_SQL = """l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY judged_at DESC NULLS LAST, same_story, backend NULLS LAST, model NULLS LAST, reason NULLS LAST) AS rn
      FROM judgments WHERE same_story IS NOT NULL) WHERE rn = 1)"""
def last_order():
    return [F.col("judged_at").desc_nulls_last(), F.col("same_story"), F.col("backend").asc_nulls_last(), F.col("model").asc_nulls_last(), F.col("reason").asc_nulls_last()]

REACH = """sym AS (SELECT u AS s, v AS t FROM links UNION SELECT v, u FROM links),
    reach(s, t) AS (SELECT s, t FROM sym UNION SELECT r.s, e.t FROM reach r JOIN sym e ON r.t = e.s),
    comp AS (SELECT s AS item_id, least(s, min(t)) AS component FROM reach GROUP BY s)"""


def scored(spark, d):
    p = table(spark, d, "pairs").where(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("a") != F.col("b")))
    return p.groupBy("a", "b").agg(F.max("outlet_a").alias("outlet_a"), F.max("outlet_b").alias("outlet_b"), F.max("score").alias("score")).withColumn("pair_id", F.concat("a", F.lit("-"), "b"))


def answers(spark, d):
    return table(spark, d, "judgments").where(F.col("same_story").isNotNull())


def last(spark, d):
    return dedupe.last_answers(answers(spark, d), last_order())


USABLE_SQL = """
    c AS (SELECT model_id, item_id, vector FROM vectors WHERE vector IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0),
    n AS (SELECT model_id, len(vector) AS dim, count(*) AS k FROM c GROUP BY 1, 2), m AS (SELECT model_id, max_by(dim, k * 100000 + dim) AS dim FROM n GROUP BY 1),
    o AS (SELECT c.model_id, item_id, min(vector) AS v FROM c JOIN m ON c.model_id = m.model_id AND len(vector) = m.dim GROUP BY 1, 2),
    u AS (SELECT model_id, item_id, v, CASE WHEN list_dot_product(v, v) = 0 THEN 1.0 ELSE sqrt(list_dot_product(v, v)) END AS w FROM o)"""
COSINE_SQL = f"""WITH {USABLE_SQL}
    SELECT x.model_id, x.item_id AS a, y.item_id AS b, round(list_dot_product(x.v, y.v) / (x.w * y.w), 6) AS score
    FROM u x JOIN u y ON x.model_id = y.model_id AND x.item_id < y.item_id WHERE round(list_dot_product(x.v, y.v) / (x.w * y.w), 6) >= 0.8"""


@query("g12_majority_dim", """
    WITH n AS (SELECT model_id, len(vector) AS dim, count(*) AS k FROM vectors WHERE vector IS NOT NULL GROUP BY 1, 2) SELECT model_id, max_by(dim, k * 100000 + dim) AS dim FROM n GROUP BY 1""")
def majority(spark, d):
    return pairs.majority_dim(table(spark, d, "vectors"))


@query("j01_cosine_pairs", COSINE_SQL)
def cosine_pairs(spark, d):
    return pairs.score_pairs(pairs.comparable(table(spark, d, "vectors")), 0.8, nan=True)


@query("j01_cosine_join", COSINE_SQL)
def cosine_join(spark, d):
    return cosine_pairs(spark, d)


@query("j01_cosine_join_all", COSINE_SQL)
def cosine_join_all(spark, d):
    return cosine_pairs(spark, d)


@query("d06_route", f"""WITH {PAIRS_SQL}
    SELECT pair_id, score, score >= 0.80 AS linked, score >= 0.57 AND score < 0.80 AS borderline, score >= 0.30 AS sample FROM p""")
def route(spark, d):
    return pairs.route(scored(spark, d), 0.57, 0.80, 0.30).select("pair_id", "score", "linked", "borderline", "sample")


@query("j02_without_vector", """
    SELECT outlet, count(*) AS items, count(*) FILTER (id NOT IN (SELECT item_id FROM vectors)) AS without FROM (SELECT DISTINCT id, outlet FROM items) GROUP BY outlet""")
def without_vector(spark, d):
    items = table(spark, d, "items").select("id", "outlet").distinct()
    have = table(spark, d, "vectors").select(F.col("item_id").alias("id")).distinct().withColumn("have", F.lit(1))
    return items.join(have, "id", "left").groupBy("outlet").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("have").isNull()).alias("without"))


@query("j04_to_embed", "SELECT DISTINCT id FROM items WHERE id NOT IN (SELECT item_id FROM vectors WHERE model_id = 'lattice-8m')")
def to_embed(spark, d):
    v = table(spark, d, "vectors").where("model_id = 'lattice-8m'").select(F.col("item_id").alias("id"))
    return table(spark, d, "items").select("id").distinct().join(v, "id", "left_anti")


@query("j05_pair_items", f"""WITH {PAIRS_SQL}, i AS (SELECT id, min(title) AS title, min(published) AS published FROM items GROUP BY id)
    SELECT pair_id, score, x.title AS a_title, y.title AS b_title, x.published AS a_published, y.published AS b_published FROM p JOIN i x ON p.a = x.id JOIN i y ON p.b = y.id""")
def pair_items(spark, d):
    i = table(spark, d, "items").groupBy("id").agg(F.min("title").alias("title"), F.min("published").alias("published"))
    return pairs.with_items(scored(spark, d), i, ["title", "published"]).select("pair_id", "score", "a_title", "b_title", "a_published", "b_published")


@query("j06_unlabelled", f"WITH {PAIRS_SQL} SELECT pair_id, score FROM p WHERE pair_id NOT IN (SELECT pair_id FROM judgments WHERE same_story IS NOT NULL AND backend = 'api')")
def unlabelled(spark, d):
    return judging.unanswered(scored(spark, d), answers(spark, d).where("backend = 'api'")).select("pair_id", "score")


@query("j07_unjudged_queue", f"WITH {PAIRS_SQL} SELECT pair_id, score FROM p WHERE score >= 0.57 AND pair_id NOT IN (SELECT pair_id FROM judgments WHERE same_story IS NOT NULL) ORDER BY coalesce(outlet_a = outlet_b, false), score DESC, pair_id LIMIT 150")
def unjudged(spark, d):
    return judging.judge_queue(judging.unanswered(scored(spark, d).where("score >= 0.57"), answers(spark, d)), 150).select("pair_id", "score")


@query("j08_accepted_links", f"""
    WITH h AS (SELECT * FROM judgments WHERE backend = 'api'), j AS (SELECT * FROM judgments WHERE backend <> 'api'),
    {LAST_SQL.replace('FROM judgments', 'FROM h')}
    SELECT least(item_id_a, item_id_b) AS u, greatest(item_id_a, item_id_b) AS v, 'human' AS source FROM l WHERE same_story
    UNION ALL SELECT least(item_id_a, item_id_b), greatest(item_id_a, item_id_b), 'judge' FROM j WHERE same_story AND pair_id NOT IN (SELECT pair_id FROM l)""")
def accepted(spark, d):
    j = table(spark, d, "judgments")
    return judging.accepted_links(j.where("backend = 'api' AND same_story IS NOT NULL"), j.where("backend <> 'api'"), last_order())


@query("j13_quote_problems", r"""
    WITH i AS (SELECT id, min(outlet) AS outlet, min(coalesce(title, '')) AS title, min(coalesce(lede, '')) AS lede FROM items GROUP BY id),
    x AS (SELECT q.quote_id, q.outlet, i.outlet AS o, i.id, trim(regexp_replace(coalesce(quote, ''), '[\s\v\x{85}\p{Z}]+', ' ', 'g')) AS q,
      trim(regexp_replace(title, '[\s\v\x{85}\p{Z}]+', ' ', 'g')) AS t, trim(regexp_replace(lede, '[\s\v\x{85}\p{Z}]+', ' ', 'g')) AS l FROM quotes q LEFT JOIN i ON q.item_id = i.id)
    SELECT quote_id, CASE WHEN id IS NULL THEN 'item unknown' WHEN NOT coalesce(outlet = o, false) THEN 'outlet differs' WHEN q <> '' AND (contains(t, q) OR contains(l, q)) THEN NULL
      WHEN q <> '' AND contains(t || ' ' || l, q) THEN 'across title and lede' ELSE 'not verbatim' END AS problem FROM x""")
def quote_check(spark, d):
    i = table(spark, d, "items").groupBy("id").agg(F.min("outlet").alias("outlet"), F.min(F.coalesce("title", F.lit(""))).alias("title"), F.min(F.coalesce("lede", F.lit(""))).alias("lede"))
    return quote_problems(table(spark, d, "quotes"), i).select("quote_id", "problem")


@query("j17_answered_by_both", "SELECT DISTINCT pair_id FROM judgments WHERE backend = 'api' AND pair_id IN (SELECT pair_id FROM judgments WHERE backend <> 'api')")
def answered_by_both(spark, d):
    j = table(spark, d, "judgments")
    return j.where("backend = 'api'").select("pair_id").distinct().join(j.where("backend <> 'api'").select("pair_id"), "pair_id", "left_semi")


@query("j18_import_problems", f"""WITH {PAIRS_SQL}, k AS (SELECT pair_id, max(round(score, 4)) AS s FROM p GROUP BY 1),
    r AS (SELECT j.pair_id, j.same_story, j.judged_at FROM judgments j WHERE backend = 'quickjudge'),
    o AS (SELECT pair_id, bool_or(same_story) AS yes, bool_or(NOT same_story) AS no FROM judgments WHERE backend = 'nightly' GROUP BY 1),
    w AS (SELECT pair_id, count(DISTINCT same_story) > 1 AS torn FROM r GROUP BY 1)
    SELECT r.pair_id, r.judged_at, CASE WHEN same_story IS NULL THEN 'no answer' WHEN k.s IS NULL THEN 'no such pair' WHEN torn THEN 'answered twice in different ways'
      WHEN coalesce((same_story AND no) OR (NOT same_story AND yes), false) THEN 'differs from a stored label' END AS problem
    FROM r LEFT JOIN k USING (pair_id) LEFT JOIN o USING (pair_id) LEFT JOIN w USING (pair_id)""")
def import_check(spark, d):
    j, pool = table(spark, d, "judgments"), scored(spark, d)
    rows = j.where("backend = 'quickjudge'").join(pool.select("pair_id", "score"), "pair_id", "left")
    from ..functions.times import is_timestamp

    return judging.import_problems(rows, pool, j.where("backend = 'nightly'"), is_timestamp(F.col("judged_at"))).select("pair_id", "judged_at", "problem")


@query("u01_labelling_pool", f"""WITH {PAIRS_SQL} SELECT pair_id, score, CASE WHEN score >= 0.57 AND score < 0.80 THEN 'pending' ELSE 'sample' END AS source FROM p WHERE score >= 0.30""")
def pool(spark, d):
    p = pairs.route(scored(spark, d), 0.57, 0.80, 0.30)
    pick = lambda flag, name: p.where(flag).select("pair_id", "score", F.lit(name).alias("source"))
    return judging.labelling_pool(pick("borderline", "pending"), pick("sample", "sample"))


@query("u02_answered_ids", "SELECT pair_id FROM judgments WHERE backend = 'api' UNION SELECT pair_id FROM judgments WHERE backend <> 'api'")
def answered_ids(spark, d):
    j = table(spark, d, "judgments")
    return j.where("backend = 'api'").select("pair_id").union(j.where("backend <> 'api'").select("pair_id")).distinct()


@query("u03_agreed_pairs", "SELECT pair_id FROM judgments WHERE same_story INTERSECT SELECT a || '-' || b FROM pairs WHERE score >= 0.57 AND NOT isnan(score)")
def agreed(spark, d):
    j = table(spark, d, "judgments").where("same_story")
    return j.select("pair_id").intersect(scored(spark, d).where("score >= 0.57").select("pair_id"))


@query("u05_pruned_vectors", "SELECT item_id FROM vectors EXCEPT SELECT id FROM items")
def pruned(spark, d):
    from ..sources.sinks import prune

    return prune(table(spark, d, "items").select(F.col("id").alias("item_id")), table(spark, d, "vectors"), "item_id")


@query("j24_backfill_url", """
    WITH i AS (SELECT id, max(url) AS url FROM items GROUP BY id) SELECT q.quote_id, coalesce(i.url, '') AS url FROM quotes q LEFT JOIN i ON q.item_id = i.id""")
def backfill(spark, d):
    m = table(spark, d, "quotes").select("quote_id", "item_id").withColumn("url", F.lit(""))
    return clusters.backfill_urls(m, table(spark, d, "items")).select("quote_id", "url")


LINKS_SQL = "links AS (SELECT DISTINCT a AS u, b AS v FROM pairs WHERE score >= 0.85 AND NOT isnan(score) AND a <> b)"


def strong(spark, d, tau: float = 0.85):
    return scored(spark, d).where(F.col("score") >= tau).select(F.col("a").alias("u"), F.col("b").alias("v"))


@query("f01_components", f"WITH RECURSIVE {LINKS_SQL}, {REACH} SELECT item_id, component FROM comp")
def comps(spark, d):
    return components.components(strong(spark, d))


@query("f04_labelled_clusters", f"""WITH RECURSIVE links AS (SELECT DISTINCT lower(trim(item_id_a)) AS u, lower(trim(item_id_b)) AS v FROM judgments WHERE same_story AND lower(trim(item_id_a)) <> lower(trim(item_id_b))), {REACH}
    SELECT component, count(*) AS size, count(DISTINCT i.outlet) AS outlets FROM comp JOIN (SELECT id, min(outlet) AS outlet FROM items GROUP BY id) i ON i.id = item_id GROUP BY component HAVING count(DISTINCT i.outlet) >= 2""")
def labelled_clusters(spark, d):
    clean = lambda c: F.lower(F.btrim(c))
    j = table(spark, d, "judgments").where("same_story").select(clean("item_id_a").alias("u"), clean("item_id_b").alias("v")).where("u <> v")
    i = table(spark, d, "items").groupBy(F.col("id").alias("item_id")).agg(F.min("outlet").alias("outlet"))
    g = components.components(j).join(i, "item_id")
    return clusters.component_sizes(g).where("fate = 'kept'").select("component", "size", "outlets")


ITEMS_SQL = "i AS (SELECT id AS item_id, min(outlet) AS outlet, min(published) AS published FROM items GROUP BY id)"


def plain_items(spark, d):
    return table(spark, d, "items").groupBy(F.col("id").alias("item_id")).agg(F.min("outlet").alias("outlet"), F.min("published").alias("published"), F.min("title").alias("title"), F.min("url").alias("url"))


def known_links(spark, d, tau: float = 0.85):
    ids = table(spark, d, "items").select("id").distinct()
    return strong(spark, d, tau).join(ids.select(F.col("id").alias("u")), "u", "left_semi").join(ids.select(F.col("id").alias("v")), "v", "left_semi")


_GROUPED = f"""WITH RECURSIVE {ITEMS_SQL}, links AS (SELECT DISTINCT a AS u, b AS v FROM pairs WHERE score >= 0.85 AND NOT isnan(score) AND a <> b AND a IN (SELECT item_id FROM i) AND b IN (SELECT item_id FROM i)),
    {REACH}, g AS (SELECT i.item_id, i.outlet, i.published, coalesce(c.component, i.item_id) AS component FROM i LEFT JOIN comp c ON i.item_id = c.item_id)"""


@query("f02_dropped_components", f"""{_GROUPED} SELECT component, count(*) AS size, count(DISTINCT outlet) AS outlets,
    CASE WHEN count(DISTINCT outlet) >= 2 THEN 'kept' WHEN count(*) < 2 THEN 'single_item' ELSE 'single_outlet' END AS fate FROM g GROUP BY component""")
def dropped(spark, d):
    return clusters.component_sizes(clusters.group_items(plain_items(spark, d), known_links(spark, d)))


@query("story_clusters", f"""{_GROUPED}, c AS (SELECT component, min(published || item_id) AS f, count(*) AS size, count(DISTINCT outlet) AS outlets FROM g GROUP BY component HAVING count(DISTINCT outlet) >= 2)
    SELECT substr(f, 1, 10) || '-' || substr(sha1(substr(f, 21)), 1, 6) AS cluster_id, component, substr(f, 21) AS anchor, size, outlets FROM c""")
def story_clusters(spark, d):
    g = clusters.group_items(plain_items(spark, d), known_links(spark, d))
    return clusters.new_clusters(g).select("cluster_id", "component", "anchor", "size", "outlets")


def stored_clusters(spark, d):
    """Clusters of the strongest links, as an earlier run would have stored them."""
    g = clusters.group_items(plain_items(spark, d), known_links(spark, d, 0.93))
    made = clusters.separate_ids(clusters.new_clusters(g), clusters.new_clusters(g).limit(0))
    stored = made.select("cluster_id", F.lit(1).alias("version"), F.lit("analyzed").alias("status"), "anchor", "anchor_published")
    return stored, g.join(made.select("component", "cluster_id"), "component").select("cluster_id", "item_id", "outlet", "published")


@query("f03_updated_clusters")
def updated(spark, d):
    stored, members = stored_clusters(spark, d)
    return clusters.update_clusters(plain_items(spark, d), known_links(spark, d), stored, members)[0]


@query("f03_updated_members")
def updated_members(spark, d):
    stored, members = stored_clusters(spark, d)
    return clusters.update_clusters(plain_items(spark, d), known_links(spark, d), stored, members)[1]


@query("f06_pending_queue")
def pending(spark, d):
    stored, members = stored_clusters(spark, d)
    after, _ = clusters.update_clusters(plain_items(spark, d), known_links(spark, d), stored, members)
    return clusters.pending_queue(after, 25).select("cluster_id", "anchor_published", "version")


@query("s01_pair_rank", f"WITH {PAIRS_SQL} SELECT pair_id, score, row_number() OVER (PARTITION BY outlet_a ORDER BY score DESC, a, b) AS rank FROM p WHERE score >= 0.8")
def pair_rank(spark, d):
    return pairs.rank_pairs(scored(spark, d).where("score >= 0.8")).select("pair_id", "score", "rank")
