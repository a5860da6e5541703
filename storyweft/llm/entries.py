"""Registered queries of the training-data problems and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grouping, history, leakage, lookalikes, neighbours, spans, tokens, truncation


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    links = grouping.match_links(_t(spark, d, "pairs"), _t(spark, d, "judgments"))
    return grouping.connected_groups(links)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeated_entries(_t(spark, d, "items"), _t(spark, d, "incoming"))


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    return history.entry_coverage(_t(spark, d, "items"), _t(spark, d, "incoming"), looks=False)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(_t(spark, d, "vectors"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_looking(_t(spark, d, "items"), _t(spark, d, "quotes"))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.text_forms(_t(spark, d, "items"), _t(spark, d, "quotes")).select("field", "record_id", "value", "form")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_items(_t(spark, d, "items"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(_t(spark, d, "items"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(_t(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode_ids(tokens.encode_texts(_t(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(_t(spark, d, "documents"), _t(spark, d, "golden_items"))


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(_t(spark, d, "documents"), _t(spark, d, "golden_items"), max_substitutions=1)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(_t(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_coverage": p2_coverage,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_found": p7_found,
    "p7_near": p7_near,
    "p8_found": p8_found,
}

SQL = {
    "p1_found": """
        WITH RECURSIVE links AS (
          SELECT DISTINCT least(x, y) AS u, greatest(x, y) AS v FROM (
            SELECT lower(trim(a)) AS x, lower(trim(b)) AS y FROM pairs WHERE score >= 0.80 AND NOT isnan(score)
            UNION ALL
            SELECT lower(trim(item_id_a)), lower(trim(item_id_b)) FROM judgments WHERE same_story
          ) WHERE x <> y AND x <> '' AND y <> ''),
        sym AS (SELECT u AS s, v AS t FROM links UNION ALL SELECT v, u FROM links),
        reach(s, t) AS (SELECT s, t FROM sym UNION SELECT r.s, e.t FROM reach r JOIN sym e ON r.t = e.s)
        SELECT least(s, min(t)) AS group_id, s AS item_id FROM reach GROUP BY s""",
    "p2_coverage": r"""
        WITH r AS (SELECT entry_id, batch_no, outlet, title, lede FROM incoming WHERE entry_id IS NOT NULL AND batch_no IS NOT NULL UNION ALL SELECT NULL, NULL, outlet, title, lede FROM items),
        n AS (SELECT row_number() OVER () AS id, * FROM r),
        t AS (SELECT id, entry_id, batch_no, outlet, kind, list_filter(regexp_split_to_array(regexp_replace(array_to_string(list_filter(regexp_split_to_array(lower(coalesce(x, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> ''), ' '),
            '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'), ' +'), lambda w: w <> '') AS ws
          FROM (SELECT *, 'title' AS kind, title AS x FROM n UNION ALL SELECT *, 'lede', lede FROM n)),
        s AS (SELECT *, list_filter(range(1, len(ws) + 1), lambda i: i = 1 OR ((unicode(ws[i]) + length(ws[i])) % 2 = 1 AND (unicode(ws[i - 1]) + length(ws[i - 1])) % 2 = 0)) AS st, sum(len(ws)) OVER (PARTITION BY id) AS size FROM t),
        p AS (SELECT id, entry_id, batch_no, outlet, kind, unnest(list_transform(range(1, len(st) + 1), lambda k: struct_pack(p := array_to_string(ws[st[k]:coalesce(st[k + 1], len(ws) + 1) - 1], ' '), w := coalesce(st[k + 1], len(ws) + 1) - st[k]))) AS q FROM s
          UNION ALL SELECT id, entry_id, batch_no, outlet, kind || ' word', unnest(list_transform(ws, lambda w: struct_pack(p := w, w := CAST(1 AS BIGINT)))) FROM s WHERE size < 16),
        d AS (SELECT DISTINCT id, entry_id, batch_no, coalesce(outlet, '') AS outlet, kind, q.p AS p, q.w AS w FROM p),
        k AS (SELECT outlet, kind, p, w, bool_or(entry_id IS NULL) AS old, min(batch_no) AS first FROM d GROUP BY ALL)
        SELECT entry_id, CAST(sum(w) AS BIGINT) AS words, CAST(sum(CASE WHEN old OR first < batch_no THEN w ELSE 0 END) AS BIGINT) AS covered FROM d JOIN k USING (outlet, kind, p, w) WHERE entry_id IS NOT NULL GROUP BY entry_id""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_found": r"""
        WITH w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws
          FROM documents WHERE text IS NOT NULL),
        g AS (
          SELECT golden_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws
          FROM golden_items WHERE text IS NOT NULL),
        runs AS (
          SELECT doc_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS run FROM w WHERE len(ws) >= 13),
        passages AS (
          SELECT golden_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS run FROM g WHERE len(ws) >= 13)
        SELECT DISTINCT doc_id, golden_id FROM runs JOIN passages USING (run)""",
    "p7_near": r"""
        WITH w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
        g AS (
          SELECT golden_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM golden_items WHERE text IS NOT NULL),
        a AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: ws[i:i + 12])) AS r FROM w WHERE len(ws) >= 13),
        b AS (SELECT golden_id, unnest(list_transform(range(1, len(ws) - 11), lambda i: ws[i:i + 12])) AS r FROM g WHERE len(ws) >= 13),
        x AS (SELECT doc_id, r, 1 AS half, array_to_string(r[1:6], ' ') AS k FROM a UNION ALL SELECT doc_id, r, 2, array_to_string(r[8:13], ' ') FROM a),
        y AS (SELECT golden_id, r, 1 AS half, array_to_string(r[1:6], ' ') AS k FROM b UNION ALL SELECT golden_id, r, 2, array_to_string(r[8:13], ' ') FROM b)
        SELECT DISTINCT doc_id, golden_id FROM x JOIN y USING (half, k) WHERE len(list_filter(range(1, 14), lambda i: x.r[i] <> y.r[i])) <= 1""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
