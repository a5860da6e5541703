import random

import pytest

from storyweft.llm import grouping

PAIRS = "a string, b string, outlet_a string, outlet_b string, score double, n int, u string"
JUDGED = "pair_id string, item_id_a string, item_id_b string, same_story boolean, s int"


def union_find(links):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {(top(x), x) for x in up}


def groups(spark, links):
    df = spark.createDataFrame(links, "u string, v string")
    return {tuple(r) for r in grouping.connected_groups(df).select("group_id", "item_id").collect()}


@pytest.mark.parametrize("kind", ["random", "chain", "star and chain", "giant"])
def test_against_union_find(spark, kind):
    rng = random.Random(3)
    if kind == "random":
        links = [(f"{rng.randrange(400):04}", f"{rng.randrange(400):04}") for _ in range(260)]
    elif kind == "chain":
        ids = [f"{i:05}" for i in range(300)]
        rng.shuffle(ids)
        links = list(zip(ids, ids[1:]))
    elif kind == "star and chain":
        links = [("hub", f"leaf{i}") for i in range(200)] + [(f"t{i:03}", f"t{i + 1:03}") for i in range(60)] + [("leaf7", "t000")] + [("x", "y")]
    else:
        links = [(f"{rng.randrange(300):04}", f"{rng.randrange(300):04}") for _ in range(500)] + [(f"z{i}", f"z{i}b") for i in range(20)]
    links = [(min(a, b), max(a, b)) for a, b in links if a != b]
    assert groups(spark, links) == union_find(links)


def test_dirty_rows(spark):
    pairs = spark.createDataFrame(
        [("A ", "b", None, "o", 0.9, 1, "x"), ("b", "c", "o", "o", float("nan"), 1, "x"), ("b", "d", "o", "o", None, 1, "x"), ("e", "e", "o", "o", 1.0, 1, "x"), ("f", None, "o", "o", 1.0, 1, "x"),
         ("g", "h", "o", "o", 0.79, 1, "x"), ("g", "h", "o", "o", 0.8, 1, "x"), (" ", "h", "o", "o", 0.95, 1, "x"), ("a", "b", "o", "o", 0.9, 1, "x")],
        PAIRS,
    )
    judged = spark.createDataFrame([("p", "C", "b", True, 1), ("p", "c", "b", None, 1), ("q", "g", "z", False, 1), ("r", None, "z", True, 1)], JUDGED)
    found = grouping.connected_groups(grouping.match_links(pairs, judged))
    assert {tuple(r) for r in found.collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("g", "g"), ("g", "h")}


def test_empty(spark):
    links = grouping.match_links(spark.createDataFrame([], PAIRS), spark.createDataFrame([], JUDGED))
    assert grouping.connected_groups(links).collect() == []
