import pytest
from pyspark.sql import functions as F

from storyweft.llm import history

ITEMS = "id string, outlet string, url string, title string, lede string, row int, batch_no string, h int"
ENTRIES = "entry_id long, batch_no int, outlet string, link string, title string, lede string, row string, content int"
LEDE = "The council of the old town voted twelve to four to repair the harbour wall before the storms of winter arrive."


def run(spark, items, entries):
    i = spark.createDataFrame([(x[0], x[1], x[2], x[3], x[4], 1, "b", 2) for x in items], ITEMS)
    e = spark.createDataFrame([(*x, "r", 3) for x in entries], ENTRIES)
    return {r.entry_id for r in history.repeated_entries(i, e).collect()}


NAMES = [
    ("https://www.x.example/2026/01/05/some-title", "http://WWW.x.example:80//2026/01/05/Some%2DTitle/?utm_source=a#c", True),
    ("https://x.example/tech/1000105/a-title", "https://m.x.example/science/1000105/other-words/amp", True),
    ("https://x.example/story.php?id=7&sec=a", "https://x.example/story.php?sec=b&id=7&amp=1", True),
    ("https://x.example/story.php?id=7&sec=a", "https://x.example/story.php?id=71&sec=a", False),
    ("https://x.example/news/articles/4b105e61683o", "https://amp.x.example/news/articles/4b105e61683o;jsessionid=AB12", True),
    ("https://x.example/2026/01/05/some-title", "https://x.example/2026/01/06/some-title", False),
    ("https://x.example/2026/01/05/some-title", "https://x.example/2026/01/05/some-title/index.html", True),
    ("https://x.example/about", "https://x.example/other", False),
]


def test_names(spark):
    df = spark.createDataFrame([(k, "o", u) for k, (a, b, _) in enumerate(NAMES) for u in (a, b)], "k int, outlet string, url string")
    same = {r.k: r.n == 1 for r in history.with_article_name(df, "outlet", "url").groupBy("k").agg(F.countDistinct("name").alias("n")).collect()}
    assert same == {k: x[2] for k, x in enumerate(NAMES)}


def test_null_addresses_have_no_name(spark):
    df = history.with_article_name(spark.createDataFrame([("o", None), ("o", " "), (None, "https://www.x.example/a/123456/b")], "outlet string, url string"), "outlet", "url")
    assert [r.name for r in df.collect()] == [None, None, "x.example|n123456"]


def test_batches(spark):
    items = [("i", "o", "https://x.example/a/1000001/t", "Council to repair the harbour wall", LEDE), (None, None, None, None, None)]
    entries = [
        (1, 1, "o", "https://x.example/b/1000001/u", "Another title", None),  # known address
        (2, 1, "o", "https://x.example/a/1000002/t", "UPDATED: Council to repair the harbour wall", LEDE.replace("old", "very old")),  # known text, edited
        (3, 1, "o", "https://x.example/a/1000003/t", "Council to repair the harbour wall the follow-up", "A year later the work has hardly begun and the money is spent, said the mayor on Monday."),  # follow-up
        (4, 1, "p", "https://y.example/a/1000001/t", "Council to repair the harbour wall", LEDE),  # another outlet
        (5, 1, "o", None, "Council to repair the harbour wall", LEDE),  # no link
        (6, 2, "o", "https://x.example/a/1000009/t", "New thing", "First telling of the new thing in town, which nobody had expected to see so soon."),
        (7, 2, "o", "https://x.example/a/1000010/t", "New thing", "First telling of the new thing in town, which nobody had expected to see so soon."),  # same batch, later
        (8, 3, "o", "https://x.example/z/1000009/t", None, None),  # address of an earlier batch
        (9, 1, "o", "https://x.example/z/1000010/t", None, ""),  # earlier than what it would repeat
        (10, 4, None, "https://z.example/a/1000001/t", None, None),
        (11, 4, "o", "https://x.example/q/2000001/t", "", LEDE * 400),
    ]
    assert run(spark, items, entries) == {1, 2, 7, 8} | {7}


def test_order_within_a_batch_is_by_id(spark):
    e = [(2, 1, "o", "https://x.example/a/1000009/t", "t", "l"), (1, 1, "o", "https://x.example/b/1000009/t", "u", "m"), (1, 1, "o", "https://x.example/b/1000009/t", "u", "m")]
    assert run(spark, [], e) == {2}


def test_empty(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [("i", "o", "https://x.example/a/1000001/t", "t", "l")], []) == set()


def test_hot_copies(spark):
    e = [(n, 1 + n % 3, "o", f"https://x.example/a/{3000000 + n}/t", "The very same news of all", LEDE) for n in range(1, 200)]
    assert run(spark, [], e) == set(range(1, 200)) - {3}


OTHER = "https://x.example/a/2000001/t"
EIGHT = "Council votes to repair harbour wall before winter"


EDITED = [
    ("Council to repair the harbour wall", "Council to rebuild the harbour wall", LEDE),  # a middle word
    (EIGHT, "Council votes to mend harbour wall before spring", LEDE),  # two words of eight
    (EIGHT, "Breaking news: " + EIGHT + " | Outlet", LEDE),  # words before and after
    (EIGHT, EIGHT, LEDE.replace("council", "board").replace("winter", "autumn").replace("harbour", "harbor")),
    (EIGHT, EIGHT.replace("repair", "mend"), LEDE.replace("council", "board").replace("winter", "autumn").replace("harbour", "harbor")),
]


def test_edits_at_any_place(spark):
    # an outlet a case, so that all are one run
    old = [("i", f"o{k}", "https://x.example/a/1000001/t", a, LEDE) for k, (a, _, _) in enumerate(EDITED)]
    new = [(k, 1, f"o{k}", OTHER, b, lede) for k, (_, b, lede) in enumerate(EDITED)]
    assert run(spark, old, new) == set(range(len(EDITED)))
    within = [(10 * k + 1, 1, f"o{k}", "https://x.example/a/1000001/t", a, LEDE) for k, (a, _, _) in enumerate(EDITED)]
    assert run(spark, [], within + [(10 * k + 2, 1, f"o{k}", OTHER, b, lede) for k, (_, b, lede) in enumerate(EDITED)]) == {10 * k + 2 for k in range(len(EDITED))}


BARE = [
    ("Council to repair the harbour wall", "Council to repair the harbor wall", None, True),
    ("Council to repair the harbour wall", "Council sells the old town hall", "", False),
    ("Harbour wall repaired", "Harbour wall repaird", None, True),
    ("Harbour repaired", "Harbour sold", "Read more", False),
    ("市議会は港の防波堤を修理することを決めた", "市議会が港の防波堤を修理することを決めた", None, True),
    ("市議会は港の防波堤を修理することを決めた", "町の図書館は来年の春に新しく開館する予定", None, False),
]


def test_short_or_missing_ledes(spark):
    old = [("i", f"o{k}", "https://x.example/a/1000001/t", a, lede) for k, (a, _, lede, _) in enumerate(BARE)]
    assert run(spark, old, [(k, 1, f"o{k}", OTHER, b, lede) for k, (_, b, lede, _) in enumerate(BARE)]) == {k for k, x in enumerate(BARE) if x[3]}


def frames(spark, items, entries):
    i = spark.createDataFrame([(x[0], x[1], x[2], x[3], x[4], 1, "b", 2) for x in items], ITEMS)
    return i, spark.createDataFrame([(*x, "r", 3) for x in entries], ENTRIES)


NEWS = [(n, 1 + n % 3, "o", f"https://x.example/a/{4000000 + n}/t", f"Number {n} of the news of all", LEDE.replace("twelve", str(n))) for n in range(1, 30)]


def test_a_history_is_opened_again(spark, tmp_path):
    folder = f"file://{tmp_path}/known"
    items = [("i", "o", "https://x.example/a/1000001/t", "Council to repair the harbour wall", LEDE)]
    i, e = frames(spark, items, [(1, 1, "o", "https://x.example/b/1000001/u", "t", None), (2, 1, "o", "https://x.example/b/1000002/u", "Port of the north closes", None)])
    assert {r.entry_id for r in history.repeated_entries(i, e, folder).collect()} == {1}
    # a later session has the folder only
    again = history.ArticleHistory(spark, folder)
    _, more = frames(spark, [], [(3, 2, "o", "https://x.example/c/1000002/u", "q", None), (4, 2, "o", "https://x.example/c/1000004/u", "Council to repair the harbour wall", LEDE + " Now.")])
    assert {r.entry_id for r in history.check_entries(again, more).collect()} == {3, 4}
    rows = again.known().count(), again.pieces().count()
    # the same batch once more: the same answer, nothing added
    assert {r.entry_id for r in history.check_entries(again, more).collect()} == {3, 4}
    assert rows == (again.known().count(), again.pieces().count())
    again.compact()
    assert rows == (again.known().count(), again.pieces().count())
    again.close()
    third = history.ArticleHistory(spark, folder)
    assert rows == (third.known().count(), third.pieces().count())
    third.close()


def test_nothing_is_kept_twice(spark, tmp_path):
    folder = f"file://{tmp_path}/known"
    e = [(n, 1 + n % 3, "o", "https://x.example/a/3000000/t", "The very same news of all", LEDE) for n in range(1, 40)]
    i, e = frames(spark, [], e + [(100 + n, 4, None, None, None, None) for n in range(3)])
    assert history.repeated_entries(i, e, folder).count() == 38
    h = history.ArticleHistory(spark, folder)
    assert h.known().count() == h.known().select("h").distinct().count() == 2
    assert h.pieces().count() == h.pieces().distinct().count()
    h.close()


def test_coverage(spark):
    i, e = frames(spark, [("i", "o", None, "Council to repair the harbour wall before the winter of the year", LEDE)], [
        (1, 1, "o", None, "Council to repair the harbour wall before the winter of the year", LEDE), (2, 1, "p", None, "Council to repair the harbour wall before the winter of the year", LEDE), (3, 2, "o", None, None, None),
        (4, 2, "o", None, "Council to repair the harbour wall before the winter of the year", "Nobody had expected such a thing in a place where money never was there for any of it, said a fisherman."),
    ])
    rows = {r.entry_id: (r.covered, r.words) for r in history.entry_coverage(i, e).collect()}
    assert rows[1][0] == rows[1][1] and rows[2][0] == 0 and 3 not in rows
    assert 0 < rows[4][0] < rows[4][1]


def test_brute_force(spark):
    """Against a comparison of all pairs by the same rule, without pieces."""
    edited = [(100 + n, 4, "o", f"https://x.example/z/{5000000 + n}/t", t + " again", l.replace("old", "very old").replace("winter", "autumn")) for n, _, _, _, t, l in NEWS[:10]]
    other = [(200 + n, 5, "o", f"https://x.example/y/{6000000 + n}/t", f"Story {n} has another title", f"Line {n} of what a ship and {n * 11} crates of fish meant for a town by the sea and for all the people in it.") for n in range(10)]
    rows = NEWS + edited + other
    _, e = frames(spark, [], rows)
    r = history.entry_records(e).select("batch_no", "row", "title", "lede")
    a, b = r.alias("a"), r.alias("b")
    same = a.join(b, ((F.col("b.batch_no") < F.col("a.batch_no")) | ((F.col("b.batch_no") == F.col("a.batch_no")) & (F.col("b.row") < F.col("a.row"))))).where(history._same_text("a", "b"))
    assert run(spark, [], rows) == {x[0] for x in same.select("a.row").distinct().collect()}


def test_a_batch_goes_through_the_pieces_once(spark, monkeypatch):
    h = history.ArticleHistory(spark)
    i, e = frames(spark, [("i", "o", "https://x.example/a/1000001/t", EIGHT, LEDE)], [(1, 1, "o", OTHER, EIGHT, LEDE + " Now.")])
    h.take(h.work.stage(history.item_records(i), "items"), 0)
    read, pieces = [], h.pieces
    monkeypatch.setattr(h, "pieces", lambda: read.append(1) or pieces())
    assert [r.entry_id for r in history.check_entries(h, e).collect()] == [1]
    assert len(read) == 1
    h.close()


def by_rule(text):
    out = []
    for k, w in enumerate(words := text.split()):
        mark = lambda x: (ord(x[0]) + len(x)) % 2 == 1
        if k == 0 or mark(w) and not mark(words[k - 1]):
            out.append([])
        out[-1].append(w)
    return [" ".join(p) for p in out]


def test_pieces_begin_at_marked_words(spark):
    texts = ["", "one", "council to repair the harbour wall before winter", "écoles à paris élèves ñu", "новый план города на зиму", "市 議 会 は 港 の 防", "𝔞b 😀 𠀀c de f 𠀀 x", "", "a b c d e f g h aa bb cc dd", "last"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    assert {r.k: r.p for r in df.select("k", history._cut("t").alias("p")).collect()} == {k: by_rule(t) for k, t in enumerate(texts)}
    # a batch that is a slice, and one without rows
    assert history._cut.func(history.pa.array(texts)[3:7]).to_pylist() == [by_rule(t) for t in texts[3:7]]
    assert history._cut.func(history.pa.array([], "string")).to_pylist() == []


def test_words_without_patterns_are_those_of_the_patterns(spark):
    chars = [*range(1, 0x250), *range(0x370, 0x400), *range(0x2000, 0x2100), 0xE01, 0x5E02, 0x4E00, 0x1F600]
    texts = [None, "", " ", *(f"{chr(c)}A{chr(c)} {chr(c)}{chr(c)}b{chr(c)}c {chr(c)}" for c in chars), "a\u2014B \u2018c\u2019, \u201cD\u201d\u2026", "\u00c9t\u00e9 \u00d7 \u00c0 \u00bd", "..", "x  .  y"]
    df = spark.createDataFrame([(k, "o", t, t) for k, t in enumerate(texts)], "k int, outlet string, title string, lede string").coalesce(1)
    for looks in (True, False):
        want = {r.k: r.p for r in history._plain(df, {"p": "title"}, looks).select("k", "p").collect()}
        rows = history.with_pieces(df, looks).select("k", "plain_t", "plain_l").collect()
        assert {r.k: r.plain_t for r in rows} == want == {r.k: r.plain_l for r in rows}
    # a batch that is a slice, and one without rows
    some = history.pa.array(["Title, one", "", "\u00c9t\u00e9 - x", None, " B"])
    assert history._worded.func(some)[1:].to_pylist() == history._worded.func(some[1:]).to_pylist()
    assert [x["words"] for x in history._worded.func(some).to_pylist()] == ["title one", "", "\u00e9t\u00e9 x", "", "b"]
    assert history._worded.func(some[:0]).to_pylist() == []


def test_few_texts_go_through_the_patterns(spark):
    df = spark.createDataFrame([("Plain", False), ("Caf\u00e9 \u2014 \u201cnew\u201d", False), ("so\u00adft", True), ("\u0440ort", True), ("\u5e02", True)], "t string, wide boolean")
    assert [r.w for r in df.select(F.col("t").rlike(history._WIDE).alias("w")).collect()] == [r.wide for r in df.collect()]


def test_a_piece_is_found_in_all_its_parts(spark):
    h = history.ArticleHistory(spark)
    # contents of one title lie in several parts of its pieces
    items = [("i", "o", f"https://x.example/a/{1000000 + n}/t", EIGHT, LEDE.replace("twelve", f"word{n}")) for n in range(20)]
    i, e = frames(spark, items, [(1, 1, "o", OTHER, EIGHT, "Something else that nobody knew.")])
    h.take(h.work.stage(history.item_records(i), "items"), 0)
    assert h.pieces().columns == ["k", "c"]
    records = h.work.stage(history.entry_records(e), "entries")
    met = h.met(records).collect()
    assert len({r.k for r in met if r.k ^ (r.c % 4) == r.h}) > 1 and all(r.k ^ (r.c % 4) == r.h for r in met)
    assert {r.many for r in h.covered(records, h.met(records)).collect()} == {19}
    h.close()


def test_a_history_of_another_format_is_refused(spark, tmp_path):
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "000000001.json").write_text('{"buckets": 8, "spread": 4, "appends": 0, "generation": 0, "version": 1}')
    with pytest.raises(ValueError, match="format"):
        history.ArticleHistory(spark, f"file://{tmp_path}")
