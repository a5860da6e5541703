"""Queries of whole runs: from items, vectors and judgments to clusters, and models against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evals, feeds, judging, metrics, pairs
from ..operators.clusters import pending_queue
from ..operators.run import run_clustering
from ..sources.readers import ClusterSettings
from .pairs import PAIRS_SQL, REACH, USABLE_SQL, last_order, scored
from .registry import query, table
from .rows import PATTERNS, TAGS, squeezed

#: A window over all the items, and thresholds; the clock is given.
SETTINGS = ClusterSettings(0.57, 0.80, window_days=4000, sample_floor=0.57)
NOW, MODEL = "2026-12-31T00:00:00Z", "lattice-8m"

_PROMO = f"""(list_has_any(list_transform(tags, lambda t: lower({squeezed('t')})), ['games', 'media']) OR regexp_matches(coalesce(title, ''), '(?i)(?:^why\\b)|(?:^how\\b)') OR regexp_matches(coalesce(title, ''), '(?i)(?:[0-9]+%)|(?:^[0-9,]+ days)'))"""
_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched DESC NULLS LAST, published DESC NULLS LAST, title NULLS LAST, lede NULLS LAST, url NULLS LAST, outlet NULLS LAST) AS rn
      FROM items WHERE id IS NOT NULL AND published >= '2016-01-19T00:00:00Z') WHERE rn = 1)"""
_ACCEPTED = """jd AS (SELECT *, lower(trim(item_id_a)) AS x, lower(trim(item_id_b)) AS y FROM judgments),
    hm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY judged_at DESC NULLS LAST, same_story, backend NULLS LAST, model NULLS LAST, reason NULLS LAST) AS rn FROM jd WHERE backend = 'api' AND same_story IS NOT NULL AND pair_id IS NOT NULL) WHERE rn = 1),
    ac AS (SELECT least(x, y) AS u, greatest(x, y) AS v FROM hm WHERE same_story UNION SELECT least(x, y), greatest(x, y) FROM jd WHERE backend <> 'api' AND same_story AND pair_id NOT IN (SELECT pair_id FROM hm))"""
_USABLE = USABLE_SQL.replace("FROM vectors", "FROM (SELECT * FROM vectors WHERE model_id = 'lattice-8m' AND item_id IN (SELECT id FROM news))")
RUN_SQL = f"""WITH RECURSIVE {_LATEST}, news AS (SELECT id AS item_id, id, outlet, published FROM latest WHERE NOT coalesce({_PROMO}, false)), {_ACCEPTED}, {_USABLE},
    sc AS (SELECT x.item_id AS a, y.item_id AS b, round(list_dot_product(x.v, y.v) / (x.w * y.w), 6) AS score FROM u x JOIN u y ON x.item_id < y.item_id WHERE round(list_dot_product(x.v, y.v) / (x.w * y.w), 6) >= 0.57),
    links AS (SELECT a AS u, b AS v FROM sc WHERE score >= 0.80 UNION SELECT u, v FROM ac), {REACH},
    g AS (SELECT news.item_id, outlet, published, coalesce(component, news.item_id) AS component FROM news LEFT JOIN comp ON comp.item_id = news.item_id),
    k AS (SELECT component, count(*) AS size, count(DISTINCT outlet) AS outlets, min(published || item_id) AS f FROM g GROUP BY component),
    cl AS (SELECT component, substr(f, 1, 10) || '-' || substr(sha1(substr(f, 21)), 1, 6) AS cluster_id, substr(f, 21) AS anchor, substr(f, 1, 20) AS anchor_published, size FROM k WHERE outlets >= 2)"""


def _run(spark, d):
    items, j = table(spark, d, "items"), table(spark, d, "judgments")
    clean = lambda c: F.lower(F.btrim(c))
    j = j.withColumns({"item_id_a": clean("item_id_a"), "item_id_b": clean("item_id_b")})
    links = judging.accepted_links(j.where("backend = 'api' AND same_story IS NOT NULL"), j.where("backend <> 'api'"), last_order())
    none = lambda shape: spark.createDataFrame([], shape)
    promo = feeds.title_class(F.col("title"), F.col("tags"), TAGS, PATTERNS).isNotNull()
    return run_clustering(
        items, table(spark, d, "vectors"), MODEL, none("cluster_id string, version int, status string, anchor string, anchor_published string"),
        none("cluster_id string, item_id string, outlet string, published string"), SETTINGS, NOW, promo, links,
    )


@query("run_clusters", RUN_SQL + " SELECT cluster_id, 1 AS version, 'pending' AS status, anchor, anchor_published, size, 'new' AS state FROM cl")
def run_clusters(spark, d):
    return _run(spark, d).clusters.drop("superseded_by")


@query("run_members", RUN_SQL + " SELECT cluster_id, item_id FROM cl JOIN g USING (component)")
def run_members(spark, d):
    return _run(spark, d).members


@query("run_queue", RUN_SQL + " SELECT cluster_id, anchor_published FROM cl ORDER BY anchor_published, cluster_id LIMIT 25")
def run_queue(spark, d):
    return pending_queue(_run(spark, d).clusters, 25).select("cluster_id", "anchor_published")


@query("run_borderline", RUN_SQL + " SELECT a, b, score FROM sc WHERE score < 0.80")
def run_borderline(spark, d):
    return _run(spark, d).borderline.select("a", "b", "score")


@query("run_stats", RUN_SQL + """, sv AS (SELECT count(DISTINCT item_id) AS n FROM c)
    SELECT (SELECT count(*) FROM news) AS window_items, (SELECT count(*) FROM news) - sv.n AS items_without_vectors, sv.n - (SELECT count(*) FROM u) AS items_skipped_dim_mismatch,
      (SELECT count(*) FROM sc WHERE score >= 0.80) + (SELECT count(*) FROM ac) AS linked_pairs, (SELECT count(*) FROM sc WHERE score < 0.80) AS borderline_pairs, (SELECT count(*) FROM k) AS components,
      (SELECT count(*) FROM cl) AS clusters_total, (SELECT count(*) FROM cl) AS clusters_new, 0::BIGINT AS clusters_requeued, 0::BIGINT AS clusters_superseded,
      (SELECT count(*) FROM k WHERE outlets < 2 AND size < 2) AS dropped_single_item, (SELECT count(*) FROM k WHERE outlets < 2 AND size >= 2) AS dropped_single_outlet FROM sv""")
def run_stats(spark, d):
    return _run(spark, d).stats


@query("d04_partition", f"SELECT id, fetched, coalesce({_PROMO}, false) AS promotional FROM items")
def partition(spark, d):
    news, promo = feeds.partition(table(spark, d, "items"), feeds.title_class(F.col("title"), F.col("tags"), TAGS, PATTERNS).isNotNull())
    mark = lambda df, hit: df.select("id", "fetched", F.lit(hit).alias("promotional"))
    return mark(news, False).unionByName(mark(promo, True))


_CLASSES = f"t AS (SELECT id, bool_or(coalesce(regexp_matches(title, '(?i)(?:^why\\b)|(?:^how\\b)') OR regexp_matches(title, '(?i)(?:[0-9]+%)|(?:^[0-9,]+ days)'), false)) AS odd FROM items GROUP BY id)"


def labellable_pool(spark, d):
    """The pool of pairs a human can judge, without tags, as a title alone is at hand."""
    tags = F.array().cast("array<string>")
    odd = table(spark, d, "items").select("id", feeds.title_class(F.col("title"), tags, TAGS, PATTERNS).alias("c")).groupBy("id").agg(F.max("c").alias("c"))
    side = lambda k: odd.select(F.col("id").alias(k), F.col("c").alias(f"class_{k}"))
    p = pairs.route(scored(spark, d), 0.57, 0.80, 0.30).join(side("a"), "a", "left").join(side("b"), "b", "left")
    rule = judging.is_labellable(F.col("outlet_a"), F.col("outlet_b"), F.col("class_a"), F.col("class_b"))
    return judging.labelling_pool(p.where("borderline"), p.where("sample"), rule)


@query("d07_labellable", f"WITH {PAIRS_SQL}, {_CLASSES} SELECT pair_id, score FROM p LEFT JOIN t x ON p.a = x.id LEFT JOIN t y ON p.b = y.id WHERE score >= 0.30 AND NOT coalesce(outlet_a = outlet_b, false) AND NOT coalesce(x.odd, false) AND NOT coalesce(y.odd, false)")
def labellable(spark, d):
    return labellable_pool(spark, d).select("pair_id", "score")


@query("j11_trial_pairs", f"WITH {PAIRS_SQL}, l AS (SELECT DISTINCT pair_id FROM judgments WHERE same_story IS NOT NULL AND pair_id IS NOT NULL) SELECT count(*) FILTER (p.pair_id IS NOT NULL) AS pairs, count(*) FILTER (p.pair_id IS NULL) AS unmatched FROM l LEFT JOIN p ON p.pair_id = l.pair_id")
def trial_pairs(spark, d):
    return judging.labelled_pairs(table(spark, d, "judgments").where("same_story IS NOT NULL"), scored(spark, d), last_order())[1]


_LABELS = """l AS (SELECT pair_id, item_id_a, item_id_b, same_story FROM (SELECT pair_id, lower(trim(item_id_a)) AS item_id_a, lower(trim(item_id_b)) AS item_id_b, same_story,
      row_number() OVER (PARTITION BY pair_id ORDER BY judged_at DESC NULLS LAST, same_story, backend NULLS LAST, model NULLS LAST, reason NULLS LAST) AS rn FROM judgments WHERE same_story IS NOT NULL AND pair_id IS NOT NULL) WHERE rn = 1)"""


def _vector_scores(spark, d):
    from .pairs import last

    clean = lambda c: F.lower(F.btrim(c)).alias(c)
    labels = last(spark, d).select("pair_id", clean("item_id_a"), clean("item_id_b"), "same_story")
    return evals.vector_scores(labels, pairs.comparable(table(spark, d, "vectors")))


@query("j12_vector_scores", f"WITH {USABLE_SQL}, {_LABELS} SELECT x.model_id, pair_id, same_story, round(list_dot_product(x.v, y.v) / (x.w * y.w), 6) AS score FROM l JOIN u x ON x.item_id = item_id_a JOIN u y ON y.item_id = item_id_b AND y.model_id = x.model_id")
def vector_scores(spark, d):
    return _vector_scores(spark, d)[0]


@query("j12_skipped", f"""WITH {USABLE_SQL}, {_LABELS}, s AS (SELECT x.model_id, count(*) AS scored FROM l JOIN u x ON x.item_id = item_id_a JOIN u y ON y.item_id = item_id_b AND y.model_id = x.model_id GROUP BY 1)
    SELECT m.model_id, coalesce(scored, 0) AS scored, (SELECT count(*) FROM l) - coalesce(scored, 0) AS skipped FROM (SELECT DISTINCT model_id FROM u) m LEFT JOIN s USING (model_id)""")
def skipped(spark, d):
    return _vector_scores(spark, d)[1]


_HALVES = f"""{PAIRS_SQL}, {_LABELS}, h AS (SELECT backend AS variant, length(l.pair_id) % 2 = 0 AND substr(l.pair_id, 1, 1) < '8' AS tuning, p.score AS p, l.same_story FROM l JOIN p USING (pair_id) JOIN (SELECT DISTINCT pair_id, backend FROM judgments WHERE backend IS NOT NULL) b ON b.pair_id = l.pair_id),
    g AS (SELECT variant, tuning, cutoff, count(*) FILTER (p >= cutoff AND same_story) AS tp, count(*) FILTER (p >= cutoff AND NOT same_story) AS fp, count(*) FILTER (p < cutoff AND same_story) AS fn FROM h, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS cutoff) GROUP BY ALL),
    q AS (SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision FROM g)"""


def _halves(spark, d):
    from .scores import labelled

    who = table(spark, d, "judgments").where("backend IS NOT NULL").select("pair_id", F.col("backend").alias("variant")).distinct()
    # SQL has no BLAKE2b: the halves are made by the first digit here, by in_tuning_half otherwise
    tuning = (F.length("pair_id") % 2 == 0) & (F.substring("pair_id", 1, 1) < "8")
    return labelled(spark, d).join(who, "pair_id").select("variant", tuning.alias("tuning"), "p", "same_story")


@query("g11_halves", f"WITH {_HALVES} SELECT variant, tuning, cutoff, tp, fp, fn, precision FROM q")
def halves(spark, d):
    from .scores import CUTOFFS

    return metrics.halves_grid(_halves(spark, d), CUTOFFS)


@query("g11_held_out", f"""WITH {_HALVES}, k AS (SELECT variant, min(cutoff) AS picked FROM q WHERE tuning AND tp + fp > 0 AND precision >= 0.6 GROUP BY 1)
    SELECT v.variant, picked, q.tp, q.fp, q.fn, q.precision FROM (SELECT DISTINCT variant FROM h) v LEFT JOIN k USING (variant) LEFT JOIN q ON q.variant = v.variant AND NOT q.tuning AND q.cutoff = k.picked""")
def held_out(spark, d):
    from .scores import CUTOFFS

    return metrics.held_out_at_pick(_halves(spark, d), CUTOFFS, 0.6)


@query("g05_disagreements", f"WITH {PAIRS_SQL}, {_LABELS} SELECT pair_id, same_story, score >= 0.80 AS g FROM l JOIN p USING (pair_id) WHERE same_story <> (score >= 0.80)")
def disagreements(spark, d):
    from .scores import labelled

    return metrics.disagreements(labelled(spark, d).withColumn("g", F.col("score") >= 0.80), "same_story", "g").select("pair_id", "same_story", "g")


@query("c40_page_payload", f"""WITH {PAIRS_SQL}, i AS (SELECT id, min(outlet) AS outlet, min(title) AS title, min(lede) AS lede, min(published) AS published FROM items GROUP BY id)
    SELECT pair_id, json_object('id', pair_id, 's', round(score, 4), 'a', {{'o': x.outlet, 't': x.title, 'l': x.lede, 'i': a, 'p': x.published}}, 'b', {{'o': y.outlet, 't': y.title, 'l': y.lede, 'i': b, 'p': y.published}})::VARCHAR AS json
    FROM p JOIN i x ON x.id = a JOIN i y ON y.id = b WHERE score >= 0.57""")
def page_payload(spark, d):
    columns = ["outlet", "title", "lede", "published"]
    i = table(spark, d, "items").groupBy("id").agg(*[F.min(c).alias(c) for c in columns])
    rows = judging.page_payload(pairs.with_items(scored(spark, d).where("score >= 0.57"), i, columns))
    return rows.select(F.get_json_object("json", "$.id").alias("pair_id"), "json")
