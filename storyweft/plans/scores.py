"""Queries that score pairs against answers, and samples for labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, sampling
from .pairs import LAST_SQL, PAIRS_SQL, answers, last, scored
from .registry import query, table

#: Scores with the last answer of their pair.
LABELLED_SQL = f"{PAIRS_SQL}, {LAST_SQL}, s AS (SELECT p.pair_id, p.score, p.score AS p, p.outlet_a, p.outlet_b, l.same_story FROM p JOIN l USING (pair_id))"
CUTOFFS = [0.5, 0.6, 0.7, 0.8, 0.9]
BINS = [0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0001]


def labelled(spark, d):
    return scored(spark, d).join(last(spark, d).select("pair_id", "same_story"), "pair_id").withColumn("p", F.col("score"))


@query("w02_last_answer", f"WITH {LAST_SQL} SELECT pair_id, same_story, judged_at FROM l")
def last_answer(spark, d):
    return last(spark, d).select("pair_id", "same_story", "judged_at")


@query("g04_tune_table", f"""WITH {LABELLED_SQL}, b AS (SELECT score, count(*) FILTER (same_story) AS yes, count(*) FILTER (NOT same_story) AS no FROM s GROUP BY score),
    r AS (SELECT score, sum(yes) OVER (ORDER BY score DESC) AS tp, sum(no) OVER (ORDER BY score DESC) AS fp, sum(yes) OVER () AS n FROM b)
    SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(n - tp AS BIGINT) AS fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(n, 0), 6) AS recall FROM r""")
def tune(spark, d):
    return metrics.tune_table(labelled(spark, d))


@query("g05_judge_scores", f"""WITH h AS (SELECT pair_id, bool_or(same_story) AS t FROM judgments WHERE backend = 'api' AND same_story IS NOT NULL GROUP BY 1),
    g AS (SELECT pair_id, bool_or(same_story) AS g FROM judgments WHERE backend <> 'api' AND same_story IS NOT NULL GROUP BY 1), j AS (SELECT * FROM h JOIN g USING (pair_id)),
    c AS (SELECT count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (NOT t AND NOT g) AS tn, count(*) FILTER (t AND NOT g) AS fn FROM j)
    SELECT *, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""")
def judge_scores(spark, d):
    one = lambda where, name: answers(spark, d).where(where).groupBy("pair_id").agg(F.bool_or("same_story").alias(name))
    return metrics.confusion(one("backend = 'api'", "t").join(one("backend <> 'api'", "g"), "pair_id"), "t", "g")


@query("g05_score_confusion", f"""WITH {LABELLED_SQL}, j AS (SELECT same_story AS t, score >= 0.80 AS g FROM s),
    c AS (SELECT count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (NOT t AND NOT g) AS tn, count(*) FILTER (t AND NOT g) AS fn FROM j)
    SELECT *, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""")
def score_confusion(spark, d):
    return metrics.confusion(labelled(spark, d).withColumn("g", F.col("score") >= 0.80), "same_story", "g")


@query("g06_roc_auc", f"""WITH {LABELLED_SQL}, r AS (SELECT same_story, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM s),
    t AS (SELECT sum(k) FILTER (same_story) AS k, count(*) FILTER (same_story) AS y, count(*) FILTER (NOT same_story) AS n FROM r)
    SELECT round(CASE WHEN y = 0 OR n = 0 THEN 0.5 ELSE (k - y * (y + 1) / 2.0) / (CAST(y AS DOUBLE) * n) END, 6) AS auc FROM t""")
def auc(spark, d):
    return metrics.roc_auc(labelled(spark, d))


@query("g07_separation", f"""WITH {LABELLED_SQL}, e AS (SELECT max(score) FILTER (NOT same_story) AS highest_false, min(score) FILTER (same_story) AS lowest_true, count(*) FILTER (same_story) AS n FROM s),
    g AS (SELECT count(*) FILTER (same_story AND (highest_false IS NULL OR score > highest_false)) AS got, min(score) FILTER (same_story AND (highest_false IS NULL OR score > highest_false)) AS tau FROM s, e)
    SELECT highest_false, lowest_true, round(coalesce(got / nullif(n, 0), 0), 6) AS recall, tau, got = n AS separable, n - got AS unreachable FROM e, g""")
def separation(spark, d):
    return metrics.separation(labelled(spark, d))


@query("g08_calibration", f"""WITH {LABELLED_SQL}, b AS (SELECT *, CASE WHEN p < 0.1 THEN 0 WHEN p < 0.3 THEN 1 WHEN p < 0.5 THEN 2 WHEN p < 0.7 THEN 3 WHEN p < 0.9 THEN 4 WHEN p < 1.0001 THEN 5 END AS bin FROM s)
    SELECT bin, count(*) AS n, round(avg(p) + 1e-9, 6) AS mean_p, round(avg(CAST(same_story AS INT)), 6) AS yes_rate FROM b GROUP BY bin""")
def calibration(spark, d):
    return metrics.calibration(labelled(spark, d), BINS)


@query("g09_triage", f"""WITH {LABELLED_SQL} SELECT count(*) FILTER (p < 0.5) AS n_no, count(*) FILTER (p >= 0.5 AND p < 0.9) AS n_middle, count(*) FILTER (p >= 0.9) AS n_yes,
    count(*) FILTER (p < 0.5 AND same_story) AS matches_lost, count(*) FILTER (p >= 0.9 AND NOT same_story) AS wrong_links FROM s""")
def triage(spark, d):
    return metrics.triage(labelled(spark, d), 0.5, 0.9)


@query("g09_prefilter", f"""WITH {LABELLED_SQL} SELECT count(*) AS queue, count(*) FILTER (p < 0.6) AS dropped, count(*) FILTER (same_story) AS matches, count(*) FILTER (p < 0.6 AND same_story) AS matches_lost FROM s WHERE score >= 0.57""")
def prefilter(spark, d):
    return metrics.prefilter(labelled(spark, d), 0.6, 0.57)


_GRID = f"""WITH {LABELLED_SQL}, c AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS cutoff),
    g AS (SELECT cutoff, count(*) FILTER (p >= cutoff AND same_story) AS tp, count(*) FILTER (p >= cutoff AND NOT same_story) AS fp, count(*) FILTER (p < cutoff AND same_story) AS fn FROM s, c GROUP BY cutoff)"""


@query("g11_cutoff_grid", f"{_GRID} SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision FROM g")
def grid(spark, d):
    return metrics.cutoff_grid(labelled(spark, d), CUTOFFS)


@query("g10_pick_cutoff", f"{_GRID} SELECT min(cutoff) AS cutoff FROM g WHERE tp + fp > 0 AND tp / (tp + fp) >= 0.6")
def pick(spark, d):
    return metrics.pick_cutoff(labelled(spark, d), CUTOFFS, 0.6)


_BUCKET = "least(greatest(CAST(floor((round(score, 6) - 0.3) / 0.05) AS INTEGER), 0), 13)"


@query("w05_label_sample", f"""WITH {PAIRS_SQL}, a AS (SELECT * FROM p WHERE pair_id IN (SELECT pair_id FROM judgments WHERE backend = 'api')), h AS (SELECT {_BUCKET} AS bucket, count(*) AS have FROM a GROUP BY 1),
    c AS (SELECT pair_id, score, {_BUCKET} AS bucket, row_number() OVER (PARTITION BY {_BUCKET} ORDER BY pair_id) AS rn FROM p WHERE outlet_a <> outlet_b AND round(score, 6) >= 0.3 AND pair_id NOT IN (SELECT pair_id FROM a))
    SELECT pair_id, score, bucket FROM c LEFT JOIN h USING (bucket) WHERE rn <= 20 - coalesce(have, 0)""")
def label_sample(spark, d):
    p = scored(spark, d)
    already = p.join(table(spark, d, "judgments").where("backend = 'api'").select("pair_id"), "pair_id", "left_semi")
    return sampling.label_sample(p, already, 0.3, 0.05, 20).select("pair_id", "score", "bucket")


@query("w06_labelling_order", f"""WITH {PAIRS_SQL}, b AS (SELECT pair_id, score, least(greatest(CAST(floor((score - 0.57::DOUBLE) / (0.80::DOUBLE - 0.57::DOUBLE) * 8) AS INTEGER), 0), 7) AS bucket FROM p),
    t AS (SELECT pair_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, pair_id) AS turn FROM b)
    SELECT *, row_number() OVER (ORDER BY turn, bucket) AS place FROM t""")
def labelling_order(spark, d):
    return sampling.labelling_order(scored(spark, d), 0.57, 0.80).select("pair_id", "bucket", "turn", "place")


EDGES = [0.80, 0.75, 0.70, 0.65, 0.60]
_BAND = "(CASE WHEN score >= 0.80 THEN 0.80 WHEN score >= 0.75 THEN 0.75 WHEN score >= 0.70 THEN 0.70 WHEN score >= 0.65 THEN 0.65 WHEN score >= 0.60 THEN 0.60 ELSE 0 END)::DOUBLE"
_SIZES = f"""{PAIRS_SQL}, a AS (SELECT * FROM p WHERE pair_id IN (SELECT pair_id FROM judgments)), h AS (SELECT {_BAND} AS band, count(*) AS have FROM a GROUP BY 1),
    f AS (SELECT pair_id, score, {_BAND} AS band FROM p WHERE pair_id NOT IN (SELECT pair_id FROM a)), z AS (SELECT band, coalesce(any_value(have), 0) AS have, count(*) AS available FROM f LEFT JOIN h USING (band) GROUP BY band),
    k AS (SELECT band, have, unnest(range(0, available)) AS k FROM z), t AS (SELECT band, count(*) AS take FROM (SELECT * FROM k ORDER BY have + k, band DESC LIMIT 150) GROUP BY band)"""


def _page_parts(spark, d):
    p = scored(spark, d)
    return p, p.join(table(spark, d, "judgments").select("pair_id"), "pair_id", "left_semi")


@query("w07_allocate", f"WITH {_SIZES} SELECT band, take FROM t")
def allocate(spark, d):
    from ..functions import vectors as V

    p, labels = _page_parts(spark, d)
    b = lambda df: df.withColumn("band", V.band(F.col("score"), EDGES))
    have = b(labels).groupBy("band").agg(F.count(F.lit(1)).alias("have"))
    free = b(p.join(labels.select("pair_id"), "pair_id", "left_anti")).groupBy("band").agg(F.count(F.lit(1)).alias("available"))
    return sampling.allocate(free.join(have, "band", "left").select("band", F.coalesce("have", F.lit(0)).alias("have"), "available"), 150)


@query("w08_page", f"""WITH {_SIZES}, r AS (SELECT pair_id, f.band, take, row_number() OVER (PARTITION BY f.band ORDER BY score, pair_id) - 1 AS i, count(*) OVER (PARTITION BY f.band) AS n FROM f JOIN t ON f.band = t.band)
    SELECT pair_id, band FROM r WHERE i IN (SELECT unnest(list_transform(range(0, take), lambda k: CAST(floor(k * n / take) AS BIGINT))))""")
def page(spark, d):
    p, labels = _page_parts(spark, d)
    return sampling.page(p, labels, EDGES, 150).select("pair_id", "band")


@query("w11_queue_page")
def queue_page(spark, d):
    return sampling.queue_page(scored(spark, d).where("score >= 0.57"), answers(spark, d), 100).select("pair_id", "place")


@query("w11_queue_head", f"""WITH {PAIRS_SQL} SELECT pair_id FROM p WHERE score >= 0.57 AND pair_id NOT IN (SELECT pair_id FROM judgments WHERE same_story IS NOT NULL)
    ORDER BY coalesce(outlet_a = outlet_b, false), score DESC, pair_id LIMIT 100""")
def queue_head(spark, d):
    return sampling.queue_page(scored(spark, d).where("score >= 0.57"), answers(spark, d), 100).select("pair_id")


@query("g18_band_table", f"""WITH {PAIRS_SQL}, q AS (SELECT {_BAND} AS band, pair_id IN (SELECT pair_id FROM judgments) AS done FROM p)
    SELECT band, count(*) FILTER (done) AS labelled, count(*) AS pool FROM q GROUP BY band""")
def band_table(spark, d):
    from ..functions import vectors as V

    done = table(spark, d, "judgments").select("pair_id").distinct().withColumn("done", F.lit(True))
    return scored(spark, d).join(done, "pair_id", "left").groupBy(V.band(F.col("score"), EDGES).alias("band")).agg(F.count("done").alias("labelled"), F.count(F.lit(1)).alias("pool"))


@query("j20_lane", f"""WITH {LABELLED_SQL} SELECT pair_id, p FROM s WHERE p >= 0.5 AND p < 0.9 AND pair_id IN (SELECT pair_id FROM p WHERE outlet_a <> outlet_b)""")
def lane(spark, d):
    from ..operators.evals import lane as lane_of

    return lane_of(labelled(spark, d).select("pair_id", "p"), scored(spark, d), 0.5, 0.9)


@query("j21_chosen_pairs", f"""WITH {PAIRS_SQL} SELECT pair_id, score FROM p WHERE pair_id IN (SELECT pair_id FROM judgments WHERE backend = 'nightly') AND pair_id NOT IN (SELECT pair_id FROM judgments WHERE backend = 'api')""")
def chosen_pairs(spark, d):
    from ..operators.evals import chosen

    j = table(spark, d, "judgments")
    return chosen(j.where("backend = 'nightly'"), scored(spark, d), j.where("backend = 'api'")).select("pair_id", "score")


_CASES = """
    c AS (SELECT cluster_id AS case_id, bool_or(claim_id IS NOT NULL) AS found FROM quotes GROUP BY 1),
    e AS (SELECT case_id, list_sort(list(DISTINCT k)) AS keys FROM (SELECT cluster_id AS case_id, claim_id || '|' || outlet AS k FROM quotes WHERE claim_id IS NOT NULL) GROUP BY 1),
    p AS (SELECT case_id, list_sort(list(DISTINCT k)) AS keys FROM (SELECT q.cluster_id AS case_id, claim_id || '|' || i.outlet AS k FROM quotes q JOIN (SELECT id, min(outlet) AS outlet FROM items GROUP BY id) i ON i.id = q.item_id WHERE claim_id IS NOT NULL) GROUP BY 1),
    q AS (SELECT cluster_id AS case_id, count(*) AS n, count(*) FILTER (item_id IN (SELECT id FROM items)) AS v FROM quotes GROUP BY 1),
    s AS (SELECT c.case_id, found, coalesce(len(e.keys), 0) AS expected, coalesce(len(p.keys), 0) AS produced, coalesce(len(list_intersect(e.keys, p.keys)), 0) AS hit, n AS quotes, v AS quotes_valid
      FROM c LEFT JOIN e USING (case_id) LEFT JOIN p USING (case_id) LEFT JOIN q USING (case_id))"""


def _case_scores(spark, d):
    from ..operators.evals import case_scores

    q = table(spark, d, "quotes")
    i = table(spark, d, "items").groupBy(F.col("id").alias("item_id")).agg(F.min("outlet").alias("_o"))
    cases = q.groupBy(F.col("cluster_id").alias("case_id")).agg(F.bool_or(F.col("claim_id").isNotNull()).alias("found"))
    claims = q.where("claim_id IS NOT NULL").select(F.col("cluster_id").alias("case_id"), F.col("claim_id").alias("kind"), "outlet", "item_id")
    expected = claims.select("case_id", "kind", F.array("outlet").alias("outlets"))
    produced = claims.join(i, "item_id").select("case_id", "kind", F.array("_o").alias("outlets"))
    checked = q.join(i, "item_id", "left").select(F.col("cluster_id").alias("case_id"), F.when(F.col("_o").isNull(), "item unknown").alias("problem"))
    return case_scores(cases, expected, produced, checked)


@query("g17_case_scores", f"WITH {_CASES} SELECT case_id, found, expected, produced, hit, quotes, quotes_valid FROM s")
def case_scores(spark, d):
    return _case_scores(spark, d)


@query("g16_eval_report", f"""WITH {_CASES} SELECT count(*) AS cases, count(*) FILTER (found) AS found, round(sum(quotes_valid) / sum(quotes), 6) AS quote_validity, round(sum(hit) / sum(produced), 6) AS precision, round(sum(hit) / sum(expected), 6) AS recall FROM s""")
def eval_report(spark, d):
    from ..operators.evals import report

    return report(_case_scores(spark, d))


@query("j19_batch_results", """
    WITH b AS (SELECT DISTINCT cluster_id FROM quotes), n AS (SELECT cluster_id, CAST(count(DISTINCT item_id) AS INT) AS version FROM quotes WHERE claim_id IS NOT NULL GROUP BY 1),
    s AS (SELECT cluster_id, CAST(count(DISTINCT item_id) AS INT) AS v FROM quotes WHERE claim_id <> 'c1' GROUP BY 1)
    SELECT b.cluster_id, CASE WHEN version IS NULL THEN 'not pending' WHEN v IS NULL THEN 'not submitted' WHEN v <> version THEN 'another version' ELSE 'accept' END AS disposition FROM b LEFT JOIN n USING (cluster_id) LEFT JOIN s USING (cluster_id)""")
def batch_results(spark, d):
    from ..operators.evals import collect_batch

    q = table(spark, d, "quotes")
    size = lambda df, name: df.groupBy("cluster_id").agg(F.countDistinct("item_id").cast("int").alias(name))
    return collect_batch(q.select("cluster_id").distinct(), size(q.where("claim_id IS NOT NULL"), "version"), size(q.where("claim_id <> 'c1'"), "cluster_version"))


@query("g20_judgment_report", """
    WITH k AS (SELECT DISTINCT a || '-' || b AS pair_id FROM pairs), x AS (SELECT CASE WHEN k.pair_id IS NULL THEN 'no such pair' WHEN same_story IS NULL THEN 'no answer' WHEN coalesce(trim(model), '') = '' THEN 'no model' WHEN reason IS NULL THEN 'reason too short or long' ELSE 'valid' END AS outcome
      FROM judgments j LEFT JOIN k ON j.pair_id = k.pair_id) SELECT outcome, count(*) AS n FROM x GROUP BY 1""")
def judgment_report(spark, d):
    from ..operators.judging import checked_judgments
    from .rows import BACKENDS

    known = table(spark, d, "pairs").select(F.concat("a", F.lit("-"), "b").alias("pair_id"))
    j = checked_judgments(table(spark, d, "judgments"), known, BACKENDS)
    return j.groupBy(F.coalesce("problem", F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
