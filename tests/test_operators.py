import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyweft.operators import clusters, components, contract, dedupe, feeds, judging, marts, metrics, pairs, sampling

GROUPS = {"a": (0.95, 4), "b": (0.88, 3), "c": (0.85, 2), "d": (0.85, 3), "e": (0.72, 2), "f": (0.50, 2)}


def topic_set():
    """30 items whose cosine is s within a group and 0 across; group d is of one outlet."""
    rows, axis = [], 0
    names = [(g, i) for g, (_, n) in GROUPS.items() for i in range(n)] + [("s", i) for i in range(14)]
    dims = len(names) + len(GROUPS)
    for k, (g, i) in enumerate(names):
        s = GROUPS[g][0] if g in GROUPS else 0.0
        v = np.zeros(dims)
        if g in GROUPS:
            v[len(names) + list(GROUPS).index(g)] = np.sqrt(s)
        v[k] = np.sqrt(1 - s)
        outlet = "one" if g == "d" else f"outlet{i}"
        rows.append((f"{g}{i}", "m", outlet, f"2026-01-0{1 + i % 9}T00:00:00Z", v.tolist()))
        axis += 1
    return rows


@pytest.fixture(scope="module")
def topics(spark):
    return spark.createDataFrame(topic_set(), "item_id string, model_id string, outlet string, published string, vector array<double>")


@pytest.fixture(scope="module")
def scored(spark, topics):
    return pairs.score_pairs(pairs.comparable(topics.select("item_id", "model_id", "vector")), 0.30, block_rows=7).cache()


def test_pair_scan(topics, scored):
    r = pairs.route(scored, 0.65, 0.80, 0.30)
    assert r.where("linked").count() == 13 and r.where("borderline").count() == 1 and r.where("sample").count() == 15
    assert sorted({x.score for x in scored.collect()}) == [0.5, 0.72, 0.85, 0.88, 0.95]


def test_kernel_is_the_join(topics, scored):
    both = pairs.score_pairs_sql(pairs.comparable(topics.select("item_id", "model_id", "vector")), 0.30)
    assert {tuple(x) for x in both.collect()} == {tuple(x) for x in scored.collect()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_copy_no_vector(spark, topics):
    plan = plan_of(pairs.score_pairs(pairs.comparable(topics.select("item_id", "model_id", "vector")), 0.30, block_rows=3))
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Broadcast" not in plan


def test_blocks_miss_no_pair_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = [f"{rng.integers(1 << 40):x}é{i}" for i in range(300)]
    scores = np.round(np.einsum("ik,jk->ij", x, x), 6)
    floor = float(np.sort(scores[np.triu_indices(300, 1)])[-2000])
    true = {(m, *sorted((ids[i], ids[j])), scores[i, j]) for i in range(300) for j in range(i) for m in "mn" if scores[i, j] >= floor and (m == "m" or i < 40)}
    df = spark.createDataFrame([(m, ids[i], x[i].tolist()) for i in range(300) for m in "mn" if m == "m" or i < 40], "model_id string, item_id string, unit array<double>").repartition(3)
    for block_rows in (11, 64, 1000):
        got = [tuple(r) for r in pairs.score_pairs(df, floor, block_rows=block_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == true


def test_pairs_without_a_score(spark):
    df = spark.createDataFrame([("a", "m", [float("inf"), 1.0]), ("b", "m", [1.0, 0.0]), ("c", "m", [0.0, 1.0])], "item_id string, model_id string, vector array<double>")
    rows = pairs.comparable(df)
    assert pairs.score_pairs(rows, 0.5).collect() == []
    assert {(r.a, r.b) for r in pairs.score_pairs(rows, 0.5, nan=True).collect()} == {(r.a, r.b) for r in pairs.score_pairs_sql(rows, 0.5).collect()} == {("a", "b"), ("a", "c")}


def test_bad_vectors(spark):
    df = spark.createDataFrame([("a", "m", [1.0, 0.0]), ("a", "m", [1.0, 0.0]), ("b", "m", [1.0, 0.0]), ("c", "m", [0.0, 0.0]), ("d", "m", [1.0]), ("e", "m", None), ("f", "m", [float("nan"), 1.0])], "item_id string, model_id string, vector array<double>")
    assert [tuple(r) for r in pairs.score_pairs(pairs.comparable(df), 0.5).collect()] == [("m", "a", "b", 1.0)]
    assert pairs.score_pairs(pairs.comparable(df.limit(0)), 0.5).collect() == []


def test_components(spark):
    links = spark.createDataFrame([("c", "a"), ("d", "c"), ("a", "c"), ("b", "b"), (None, "a")], "u string, v string")
    nodes = spark.createDataFrame([("d",), ("c",), ("b",), ("a",), ("e",)], "item_id string")
    assert {tuple(r) for r in components.components(links, nodes).collect()} == {("a", "a"), ("c", "a"), ("d", "a"), ("b", "b"), ("e", "e")}
    assert components.components(links.limit(0)).collect() == []


def links_of(scored, tau=0.80):
    return scored.where(F.col("score") >= tau).select(F.col("a").alias("u"), F.col("b").alias("v"))


def test_new_and_dropped_clusters(topics, scored):
    g = clusters.group_items(topics, links_of(scored))
    fates = {r.fate: r.n for r in clusters.component_sizes(g).groupBy("fate").agg(F.count("*").alias("n")).collect()}
    assert fates == {"kept": 3, "single_item": 18, "single_outlet": 1}
    assert {r.anchor for r in clusters.new_clusters(g).collect()} == {"a0", "b0", "c0"}


def test_state_machine(spark, topics, scored):
    none_c = spark.createDataFrame([], "cluster_id string, version int, status string, anchor string, anchor_published string")
    none_m = spark.createDataFrame([], "cluster_id string, item_id string, outlet string, published string")
    first, first_members = clusters.update_clusters(topics, links_of(scored), none_c, none_m)
    assert first.cache().where("state = 'new'").count() == 3
    stored = first.select("cluster_id", "version", F.lit("analyzed").alias("status"), "anchor", "anchor_published")
    members = first_members.join(topics.select("item_id", "outlet", "published"), "item_id").cache()

    def after(items, links):
        rows, own = clusters.update_clusters(items, links, stored, members)
        ids = {}
        for r in own.collect():
            ids.setdefault(r.cluster_id, []).append(r.item_id)
        return rows, {r.anchor: (r, sorted(ids[r.cluster_id])) for r in rows.collect()}

    again = clusters.update_clusters(topics, links_of(scored), stored, members)[0]
    assert {(r.state, r.version, r.status) for r in again.collect()} == {("same", 1, "analyzed")}
    # membership never shrinks: without any link the stored clusters stay as they are
    alone = clusters.update_clusters(topics.limit(0), links_of(scored).limit(0), stored, members)[0]
    assert {(r.state, r.version) for r in alone.collect()} == {("same", 1)}
    # a bridge joins two stories: the earlier anchor lives on, the other is superseded and keeps its items
    bridge = links_of(scored).unionByName(spark.createDataFrame([("a0", "b0")], "u string, v string"))
    _, merged = after(topics, bridge)
    (a, a_ids), (b, b_ids) = merged["a0"], merged["b0"]
    assert a.version == 2 and a.status == "pending" and len(a_ids) == a["size"] == 7
    assert b.status == "superseded" and b.superseded_by == a.cluster_id and b_ids == ["b0", "b1", "b2"]
    late = links_of(scored).unionByName(spark.createDataFrame([("c0", "e0")], "u string, v string"))
    c, c_ids = after(topics, late)[1]["c0"]
    assert c.version == 2 and c_ids == ["c0", "c1", "e0"]


def test_colliding_ids(spark):
    made = spark.createDataFrame([("x", "c1", "k1", "2026-01-01T", 2, 2), ("x", "c2", "k2", "2026-01-02T", 2, 2), ("y", "c3", "k3", "2026-01-02T", 2, 2)], "cluster_id string, component string, anchor string, anchor_published string, size int, outlets int")
    out = {r.anchor: r.cluster_id for r in clusters.separate_ids(made, spark.createDataFrame([("y",)], "cluster_id string")).collect()}
    assert out["k1"] == "x" and out["k2"] not in ("x", "y") and out["k3"] != "y" and len(set(out.values())) == 3


def test_latest(spark):
    rows = [("a", "2", "1", "t", "l", "u", "o"), ("a", "3", "1", "new", "l", "u", "o"), ("a", "1", "9", "t", "l", "u", "o"), (None, "9", "9", "t", "l", "u", "o")]
    df = spark.createDataFrame(rows, "id string, fetched string, published string, title string, lede string, url string, outlet string")
    assert [r.title for r in dedupe.latest_by_id(df).collect()] == ["new"]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "score double, same_story boolean").withColumn("p", F.col("score"))


def test_metrics(spark):
    t = [(0.90, True), (0.80, True), (0.75, False), (0.70, True), (0.68, False)]
    table = {r.score: r for r in metrics.tune_table(labelled(spark, t + [(None, True), (float("nan"), True), (0.5, None)])).collect()}
    assert (table[0.90].tp, table[0.90].fp, table[0.90].fn) == (1, 0, 2) and (table[0.68].tp, table[0.68].fp, table[0.68].precision, table[0.68].recall) == (3, 2, 0.6, 1.0)
    for rows, auc in (([(0.9, True), (0.1, False)], 1.0), ([(0.1, True), (0.9, False)], 0.0), ([(0.5, True), (0.5, False)], 0.5), ([(0.5, True)], 0.5), ([], 0.5)):
        assert metrics.roc_auc(labelled(spark, rows)).first().auc == auc
    s = metrics.separation(labelled(spark, [(0.90, True), (0.85, True), (0.80, False), (0.75, True), (0.60, False)]).where("score <> 0.75 or true")).first()
    assert (s.tau, s.highest_false, s.separable) == (0.85, 0.80, False) and s.unreachable == 1
    tie = metrics.separation(labelled(spark, [(0.8, True), (0.8, False)])).first()
    assert tie.recall == 0.0 and tie.tau is None
    cut = [(0.95, True)] * 4 + [(0.6, False)]
    assert metrics.pick_cutoff(labelled(spark, cut), [0.5, 0.7, 0.9], 0.9).first().cutoff == 0.7
    assert metrics.pick_cutoff(labelled(spark, [(0.6, False)]), [0.5], 0.9).first().cutoff is None
    tr = metrics.triage(labelled(spark, [(0.95, True), (0.92, False), (0.50, True), (0.05, True)]), 0.1, 0.9).first()
    assert (tr.n_no, tr.n_middle, tr.n_yes, tr.matches_lost, tr.wrong_links) == (1, 1, 2, 1, 1)
    pre = metrics.prefilter(labelled(spark, [(0.05, True), (0.02, False)]), 0.1, 0.0).first()
    assert (pre.dropped, pre.matches_lost, pre.matches) == (2, 1, 1)
    rng = random.Random(1)
    many = [(round(rng.random(), 2), rng.random() < 0.4) for _ in range(500)]
    y, n = [s for s, t in many if t], [s for s, t in many if not t]
    want = sum((a > b) + (a == b) / 2 for a in y for b in n) / (len(y) * len(n))
    assert abs(metrics.roc_auc(labelled(spark, many)).first().auc - want) < 1e-6


def test_sampling(spark):
    p = spark.createDataFrame([(f"p{i:03}", "x", "y" if i % 5 else "x", 0.3 + i / 150) for i in range(100)], "pair_id string, outlet_a string, outlet_b string, score double")
    some = p.limit(7)
    out = sampling.label_sample(p, some, 0.3, 0.05, 5)
    assert out.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 5
    assert not {r.pair_id for r in out.collect()} & {r.pair_id for r in some.collect()} and out.where("outlet_a = outlet_b").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_allocation_is_greedy(spark, seed):
    rng = random.Random(seed)
    bands = [(float(b), rng.randrange(10), rng.randrange(8)) for b in range(5)]
    budget = rng.randrange(25)
    have, take = {b: h for b, h, _ in bands}, {b: 0 for b, _, _ in bands}
    for _ in range(budget):
        free = [b for b, _, n in bands if take[b] < n]
        if free:
            b = min(free, key=lambda b: (have[b] + take[b], -b))
            take[b] += 1
    got = {r.band: r.take for r in sampling.allocate(spark.createDataFrame(bands, "band double, have int, available int"), budget).collect()} if budget else {}
    assert got == {b: n for b, n in take.items() if n}


def test_numbering(spark):
    from storyweft.operators.ranking import numbered

    rng = random.Random(2)
    rows = [(rng.choice("xy"), rng.choice([0.5, 0.5004, 0.9, 0.1]), f"{rng.randrange(10**6):06}") for _ in range(400)]
    for descending in (True, False):
        got = {(r.g, r.t): (r.k, r.n) for r in numbered(spark.createDataFrame(rows, "g string, s double, t string"), "g", "s", "t", "k", descending, count="n").collect()}
        for g in "xy":
            own = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[1] if descending else r[1], r[2]))
            assert all(got[(g, r[2])] == (i, len(own)) for i, r in enumerate(own, 1))


def test_quotes_and_analyses(spark):
    items = spark.createDataFrame([("i", "o", "A title  here", "A lede."), ("n", "o", None, None)], "id string, outlet string, title string, lede string")
    q = spark.createDataFrame([(1, "i", "o", "title here"), (2, "i", "x", "title"), (3, "z", "o", "t"), (4, "i", "o", "here A lede"), (5, "i", "o", "none"), (6, "i", "o", None), (7, "n", "o", "x")], "k int, item_id string, outlet string, quote string")
    got = {r.k: r.problem for r in contract.quote_problems(q, items).collect()}
    assert got == {1: None, 2: "outlet differs", 3: "item unknown", 4: "across title and lede", 5: "not verbatim", 6: "not verbatim", 7: "not verbatim"}


H40 = "0123456789abcdef0123456789abcdef01234567"


def analysis(**changes):
    q = {"outlet": "o", "item_id": H40, "quote": "title here"}
    a = {
        "cluster_id": "2026-01-05-0a1b2c", "cluster_version": 1, "backend": "api", "model": "m", "generated_at": "2026-01-05T00:00:00Z", "headline": "H", "summary": "S",
        "claims": [{"id": "c1", "statement": "x", "sources": [q]}], "agreement": "full",
        "discrepancies": [{"kind": "number", "severity": "low", "explanation": "e", "quotes": [q, {**q, "outlet": "p"}], "claim_ids": ["c1"]}],
    }
    return json.dumps({k: v for k, v in (a | changes).items() if v is not None})


def test_analysis_format(spark):
    q = {"outlet": "o", "item_id": H40, "quote": "title here"}
    odd = {"kind": "nonsense", "severity": "low", "explanation": "", "quotes": [q]}
    cases = {
        "good": (analysis(), set()),
        "broken": ("{broken", {"document: unreadable"}),
        "null": (None, {"document: unreadable"}),
        "list": ("[]", {"document: type"}),
        "extra": (analysis(extra=1), {"document: unknown field"}),
        "missing": (analysis(agreement=None), {"document: agreement is missing"}),
        "enum": (analysis(agreement="some", backend="other"), {"agreement: enum", "backend: enum"}),
        "ids": (analysis(cluster_id="c", cluster_version=0, model=""), {"cluster_id: pattern", "cluster_version: minimum", "model: minLength"}),
        "types": (analysis(cluster_version="1", headline=5), {"cluster_version: type", "headline: type"}),
        "long": (analysis(headline="h" * 121, summary="s" * 601, notes="n" * 501), {"headline: maxLength", "summary: maxLength", "notes: maxLength"}),
        "many": (analysis(claims=[{"id": f"c{n}", "statement": "x", "sources": [q]} for n in range(21)], discrepancies=[]), {"claims: maxItems"}),
        "claims": (analysis(claims=[{"id": "d1", "statement": "", "sources": [], "more": 1}]), {"claims/id: pattern", "claims/statement: minLength", "claims/sources: minItems", "claims: unknown field"}),
        "odd": (analysis(discrepancies=[odd]), {"discrepancies/kind: enum", "discrepancies/explanation: minLength", "discrepancies/quotes: minItems"}),
        "quote": (analysis(claims=[{"id": "c1", "statement": "x", "sources": [{"outlet": "", "item_id": "i", "quote": "ab"}]}]), {"claims/sources/outlet: minLength", "claims/sources/item_id: pattern", "claims/sources/quote: minLength"}),
        "words": (analysis(headline="a " * 16, summary="b " * 81), {"headline: over 15 words", "summary: over 80 words"}),
        "twice": (analysis(claims=[{"id": "c1", "statement": "x", "sources": [q]}] * 2), {"claims: id twice"}),
        "unknown": (analysis(discrepancies=[{"kind": "number", "severity": "low", "explanation": "e", "quotes": [q, q], "claim_ids": ["c9"]}]), {"discrepancies: unknown claim", "discrepancies: one outlet"}),
    }
    raw = spark.createDataFrame([(k, t, 1) for k, (t, _) in cases.items()], "cluster_id string, text string, problem int")
    got = {k: set() for k in cases}
    for r in contract.schema_problems(raw.drop("problem")).collect():
        got[r.cluster_id].add(r.problem)
    assert got == {k: want for k, (_, want) in cases.items()}
    assert contract.schema_problems(raw.limit(0)).count() == 0


def test_validation_against_clusters(spark):
    c = "2026-01-05-0a1b2"
    files = [(c + "c", analysis()), (c + "d", analysis(cluster_id=c + "e")), (c + "e", analysis(cluster_id=c + "e")), (c + "f", analysis(cluster_id=c + "f")), (c + "0", analysis(cluster_id=c + "0", cluster_version=2)), (c + "1", "{")]
    raw = spark.createDataFrame(files, "file_id string, text string")
    known = spark.createDataFrame([(c + "c", 1, "pending"), (c + "d", 1, "pending"), (c + "e", 1, "superseded"), (c + "0", 1, "pending")], "cluster_id string, version int, status string")
    members = spark.createDataFrame([(c + x, H40) for x in "cde0"], "cluster_id string, item_id string")
    items = spark.createDataFrame([(H40, "o", "A title  here", None)], "id string, outlet string, title string, lede string")
    got = {}
    for r in contract.validate(raw, known, members, items).collect():
        got.setdefault(r.file_id[-1], set()).add(r.problem)
    both = {"quotes: outlet differs"}  # the second quote names outlet p
    assert got == {
        "c": both, "d": both | {"cluster: another id"}, "e": both | {"cluster: superseded"}, "f": {"cluster: no cluster file", "quotes: item is not in cluster"}, "0": both | {"cluster: another version"},
        "1": {"document: unreadable"},
    }
    assert {r.file_id[-1]: r.outcome for r in contract.publishable(raw, known, members, items).collect()} == {"c": "invalid", "d": "invalid", "e": "stale", "f": "invalid", "0": "stale", "1": "invalid"}


def test_parsed_analyses(spark):
    raw = spark.createDataFrame([(analysis(),), ("{broken",), (None,)], "text string")
    parsed = contract.parse_analyses(raw).where("readable").select("parsed.*")
    assert contract.flat_quotes(parsed).count() == 3
    known = spark.createDataFrame([("2026-01-05-0a1b2c", 2, "pending")], "cluster_id string, version int, status string")
    assert contract.cluster_problems(parsed, known).first().disposition == "stale"
    problems = spark.createDataFrame([("2026-01-05-0a1b2c", "x")], "cluster_id string, problem string")
    good, bad = contract.split_valid(parsed, problems, "cluster_id")
    assert good.count() == 0 and bad.count() == 1


def test_labelling_order(spark):
    rows = [("a", 0.79), ("b", 0.78), ("c", 0.58), ("d", 0.2), ("e", 3.0), ("f", 0.70)]
    got = {r.pair_id: (r.bucket, r.turn, r.place) for r in sampling.labelling_order(spark.createDataFrame(rows, "pair_id string, score double"), 0.57, 0.80, 8).collect()}
    # scores outside the band go to its ends; the slices take turns, from the lowest
    assert got == {"c": (0, 1, 1), "f": (4, 1, 2), "e": (7, 1, 3), "d": (0, 2, 4), "a": (7, 2, 5), "b": (7, 3, 6)}


def test_page_of_the_queue(spark):
    rows = [("a-b", "a", "b", "o", "o", 0.79), ("c-d", "c", "d", "o", "p", 0.60), ("e-f", "e", "f", "o", "p", 0.58), ("g-h", "g", "h", "o", "p", 0.9), ("i-i", "i", "i", "o", "p", 0.9)]
    p = spark.createDataFrame(rows, "pair_id string, a string, b string, outlet_a string, outlet_b string, score double")
    done = spark.createDataFrame([("g-h",)], "pair_id string")
    assert {r.pair_id for r in sampling.queue_page(p, done, 2).collect()} == {"c-d", "e-f"}
    assert {r.pair_id for r in sampling.queue_page(p, done, 3).collect()} == {"c-d", "e-f", "a-b"}
    assert sampling.queue_page(p, done, -1).count() == 0


def test_front_page(spark):
    m = spark.createDataFrame([(s, o, f"2026-01-0{d}T00:00:00Z", o) for s, d, n in (("s1", 1, 2), ("s2", 2, 2), ("s3", 2, 3), ("s4", 2, 2)) for o in "xyz"[:n]], "story string, outlet string, published string, item_id string")
    d = spark.createDataFrame([("s2", "low"), ("s2", "high"), ("s4", "medium"), ("s1", "odd")], "story string, severity string")
    rows = marts.front_page(marts.story_table(m, d), 2).collect()
    assert [(r.story, r.place, r.severity) for r in rows] == [("s3", 1, 0), ("s2", 2, 3), ("s4", 3, 2), ("s1", 4, 0)]
    assert [r.story for r in marts.front_page(marts.story_table(m), 1).collect()] == ["s3", "s4", "s2"]


def test_labellable(spark):
    df = spark.createDataFrame([("a", "x", "y", None, None), ("b", "x", "x", None, None), ("c", "x", "y", "list", None), ("d", None, "y", None, None)], "pair_id string, oa string, ob string, ca string, cb string")
    rule = judging.is_labellable(F.col("oa"), F.col("ob"), F.col("ca"), F.col("cb"))
    assert {r.pair_id for r in judging.labelling_pool(df, df, rule).collect()} == {"a", "d"}
    labels = spark.createDataFrame([("a", False, "1"), ("a", True, "2"), ("z", True, "1")], "pair_id string, same_story boolean, at string")
    pairs_, counts = judging.labelled_pairs(labels, df, [F.col("at").desc()])
    assert [(r.pair_id, r.same_story) for r in pairs_.collect()] == [("a", True)] and tuple(counts.first()) == (1, 1)


def test_tags_are_plain_text(spark):
    df = spark.createDataFrame([(["<b>AI</b>  &amp; more", "R&D", "", None, "<i></i>"],), ([],), (None,)], "tags array<string>")
    from storyweft.functions.text import clean_tags

    assert [r[0] for r in df.select(clean_tags(F.col("tags"))).collect()] == [["AI & more", "R&D"], [], None]


def test_judging(spark):
    j = "pair_id string, item_id_a string, item_id_b string, same_story boolean, judged_at string"
    human = spark.createDataFrame([("a-b", "a", "b", True, "1"), ("a-b", "a", "b", False, "2"), ("c-d", "c", "d", True, "1")], j)
    judged = spark.createDataFrame([("a-b", "a", "b", True, "1"), ("e-f", "f", "e", True, "1"), ("g-h", "g", "h", False, "1")], j)
    links = {tuple(r) for r in judging.accepted_links(human, judged, [F.col("judged_at").desc()]).collect()}
    assert links == {("c", "d", "human"), ("e", "f", "judge")}


def test_outlet_stats(spark):
    m = [("s1", "verge", "1"), ("s1", "ars", "2"), ("s2", "verge", "3"), ("s2", "ars", "3"), ("s3", "verge", "2"), ("s3", "wired", "5")]
    d = [("s1", "verge"), ("s1", "verge"), ("s2", "verge"), ("s1", "ars"), ("s3", "other"), ("s2", "ars")]
    rows = {r.outlet: (r.stories, r.discrepancy_stories, r.first_stories) for r in marts.outlet_stats(spark.createDataFrame(m, "story string, outlet string, published string"), spark.createDataFrame(d, "story string, outlet string")).collect()}
    assert rows == {"verge": (3, 2, 3), "ars": (2, 2, 1), "wired": (1, 0, 0)}


def test_feed_measure(spark):
    e = [("o", "https://x/?utm_source=a", "T one two", "T one two.", "2026-01-01T00:00:00Z"), ("o", "https://x/?ref=", "U", "a b c d", "2026-01-01T06:00:00Z"), ("o", "https://x/", "V", None, "2026-01-02T00:00:00Z"), ("p", None, None, None, None)]
    df = spark.createDataFrame(e, "outlet string, link string, title string, lede string, published string")
    r = {x.outlet: x for x in feeds.measure(df, "2026-01-03T00:00:00Z").collect()}
    assert (r["o"].median_lede_words, r["o"].max_lede_words, r["o"].equal_title, r["o"].tracking, r["o"].gap_hours, r["o"].age_hours) == (3, 4, 1, 1, 18.0, 24.0)
    assert r["p"].gap_hours is None and r["p"].age_hours is None
    assert {x.outlet: x.reasons for x in feeds.gates(feeds.measure(df, "2026-01-03T00:00:00Z")).collect()} == {"o": ["no lede"], "p": ["no lede", "stale"]}


def test_broken_links(spark):
    pages = spark.createDataFrame([("/a", '<a href="/b">'), ("/b", '<a href="/c#x"> <a href="https://z/">')], "path string, html string")
    assert [tuple(r) for r in marts.broken_links(pages).collect()] == [("/b", "/c")]
