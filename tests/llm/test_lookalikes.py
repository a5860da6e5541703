from storyweft.llm import lookalikes
from storyweft.workspace import Workspace

ITEMS = "id string, outlet string, title string, lede string, published string, fetched string, form string, look int"
QUOTES = "quote_id long, item_id string, quote string, outlet string, value string"


def item(i, title, lede=None):
    return (i, "o", title, lede, "2026-01-01T00:00:00Z", "2026-01-01T00:00:00Z", "f", 1)


def run(spark, items, quotes=()):
    i, q = spark.createDataFrame(list(items), ITEMS), spark.createDataFrame(list(quotes), QUOTES)
    return {tuple(r) for r in lookalikes.same_looking(i, q).collect()}


def test_fold():
    assert lookalikes.fold_text("Ａ　ﬁ​ne  x é ") == "A fine x é"
    assert lookalikes.fold_text("…²½™") == "…²½™"


def test_column_fold_is_the_same(spark):
    texts = ["plain", "", "  a  b ", "Ｆｕｌｌ　ｗｉｄｔｈ！", "ö ­﻿x", "ﬃ ﬆ", "ｶﾞ", "🛰️ fine", "한하", "Å Ω", None, "x" * 50000, "\ttab\nline"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lookalikes.fold(lookalikes.F.col("t")).alias("f"))
    for r in df.collect():
        assert r.f == (None if r.t is None else lookalikes.fold_text(r.t))


def test_titles(spark):
    items = [
        item("a", "The court agreed"), item("b", "The court agreed"), item("c", "Тhe cоurt аgreed"), item("d", "the court agreed"), item("e", "The cóurt agreed"),
        item("f", "same"), item("g", "same"), item("f", "same"), item("h", None), item("i", ""), item("j", "Новости о суде"), item("k", "Новости о суде"), item(None, "The  court agreed"),
    ]
    assert run(spark, items) == {("title", x) for x in "abcjk"}


def test_two_spellings_support_each_other(spark):
    assert run(spark, [item("a", "Wоrdish one"), item("b", "Wordіsh one")]) == {("title", "a"), ("title", "b")}


def test_quotes(spark):
    items = [item("a", "Café opens", "It will finish in May."), item("a", "Café opens", "It will finish in May.")]
    quotes = [(1, "a", "Café", "o", "v"), (2, "a", "will ﬁnish", "o", "v"), (3, "a", "will finish", "o", "v"), (4, "a", "will Finish", "o", "v"), (5, "x", "Café", "o", "v"), (6, "a", None, "o", "v"), (7, "a", "", "o", "v"),
              (8, "a", "opens It", "o", "v"), (2, "a", "will ﬁnish", "o", "v"), (None, "a", "will ﬁnish", "o", "v"), (9, None, "will ﬁnish", "o", "v"), (10, "a", "​", "o", "v")]
    assert run(spark, items, quotes) == {("quote", "1"), ("quote", "2")}


def test_script_of_a_token_decides(spark):
    work = Workspace(spark, "t")
    df = spark.createDataFrame([(1, "модем и датчик"), (2, "мoдем и дaтчик"), (3, "A сору of it"), (4, "a copy of it")], "k int, value string")
    forms = {r.k: r.form for r in lookalikes.one_form(lookalikes.folded_stage(df, ["k"], "value", work), ["k"], "value", work).collect()}
    assert forms[2] == forms[1] == "модем и датчик" and forms[3] == "A copy of it"


def test_empty(spark):
    assert run(spark, []) == set()


def test_dominant_script(spark):
    items = [
        item("a", "рoса и мороз утром"), item("b", "роса и мороз утром"),  # one Latin o in a Cyrillic word whose letters all have Latin twins
        item("c", "Уear end"), item("d", "Year end"), item("e", "a νote"), item("f", "a vote"),
        item("g", "the ԝһоle story"), item("h", "the whole story"), item("i", "𝐌𝐚𝐭𝐡 letters"), item("j", "Math letters"),
        item("k", "օpen door"), item("l", "open door"), item("m", "ᎢᎻe end of it"), item("n", "THe end of it"),
        item("o", "λόγος"), item("p", "logos"), item("q", "мир"), item("r", "mир"),  # r has no twin for m in the corpus' words
    ]
    assert run(spark, items) == {("title", x) for x in "abcdefghijklmn"}


def test_targets(spark):
    df = spark.createDataFrame([("рoса", False), ("Тhe", False), ("ο", True), ("ο", False), ("word", True), ("жo", False), ("", True)], "p string, l boolean")
    got = [[t["target"] for t in r[0]] for r in df.select(lookalikes._targets(lookalikes.F.col("p"), lookalikes.F.col("l"))).collect()]
    assert got == [["роса", "poca"], ["The", "Тһе"], ["o"], [], [], ["жо"], []]
