import random

import pytest

from storyweft.llm import spans

SCHEMA = "doc_id long, text string, pos int, h long, around string"


def brute(docs, size):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - size + 1):
            where.setdefault(t[i : i + size], set()).add(d)
    out = set()
    for d, t in docs:
        at = None
        for i in range(len(t or "") - size + 1):
            if len(where[t[i : i + size]]) > 1:
                if at is None:
                    at = [i, i + size]
                elif i <= at[1]:
                    at[1] = i + size
                else:
                    out.add((d, *at))
                    at = [i, i + size]
        if at:
            out.add((d, *at))
    return out


def run(spark, docs, size, **kw):
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in docs], SCHEMA)
    return {tuple(r) for r in spans.shared_spans(df, size, **kw).select("doc_id", "span_start", "span_end").collect()}


def corpus(seed, marks):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefgh  " + marks) for _ in range(900))
    docs = []
    for d in range(40):
        text = "".join(rng.choice("ijklmnop  " + marks) for _ in range(rng.randrange(300)))
        for _ in range(rng.randrange(3)):
            a = rng.randrange(len(base))
            at = rng.randrange(len(text) + 1)
            text = text[:at] + base[a : a + rng.randrange(120)] + text[at:]
        docs.append((d, text))
    return docs


@pytest.mark.parametrize("marks", [". \n", "", "。🛰"])
@pytest.mark.parametrize("limit", [10_000, 2])
def test_against_brute_force(spark, marks, limit):
    docs = corpus(len(marks), marks)
    assert run(spark, docs, 40, group_limit=limit) == brute(docs, 40)


def test_edges(spark):
    footer = "The same footer stands here. It is quite long, and it closes many texts of this source."
    docs = [(1, None), (2, ""), (3, footer), (4, footer), (5, "Own text. " + footer), (6, "short"), (7, "q" * 30000), (8, "q" * 100), (9, footer + " " + footer)]
    expected = brute(docs, 60)
    assert run(spark, docs + [(3, footer), (None, footer)], 60) == expected
    assert run(spark, docs, 60, group_limit=1) == expected
    assert run(spark, [], 60) == set()


def test_repeats_within_one_text_are_not_shared(spark):
    text = "A sentence that comes again and again here. "
    assert run(spark, [(1, text * 9), (2, "Something else altogether, of some length. " * 3)], 80) == set()
