import random

from storyweft.llm import leakage

DOCS, GOLD = "doc_id long, text string, seed int, mask int", "golden_id long, text string, checked boolean, source string"


def brute(docs, golden, span=13, slack=0):
    words = lambda t: [w.lower() for w in leakage.WORDS.findall(t or "")]
    out = set()
    for d, t in docs:
        dw = words(t)
        for g, u in golden:
            gw = words(u)
            for i in range(len(gw) - span + 1):
                for j in range(len(dw) - span + 1):
                    if sum(a != b for a, b in zip(gw[i : i + span], dw[j : j + span])) <= slack:
                        out.add((d, g))
    return out


def run(spark, docs, golden, **kw):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], DOCS)
    g = spark.createDataFrame([(i, t, True, "s") for i, t in golden], GOLD)
    return {tuple(r) for r in leakage.leaked_passages(d, g, **kw).select("doc_id", "golden_id").collect()}


def corpus():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    golden = [(g, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 40)))) for g in range(25)]
    docs = []
    for d in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
        if d % 2:
            gw = golden[d % 25][1].split()
            at = rng.randrange(len(words) + 1)
            words[at:at] = gw[: rng.randrange(10, 16)]
        docs.append((d, ("\n" if d % 3 else ", ").join(words).title()))
    return docs, golden


def test_against_brute_force(spark):
    docs, golden = corpus()
    assert run(spark, docs, golden) == brute(docs, golden)
    # a table of seeds that is full lets every window through
    assert run(spark, docs, golden, filter_bits=64) == brute(docs, golden)


def test_one_substitution(spark):
    docs, golden = corpus()
    edited = [(d, t.replace("W7", "Other", 1)) for d, t in docs]
    assert run(spark, edited, golden, max_substitutions=1) == brute(edited, golden, slack=1)


def test_edges(spark):
    long = " ".join(f"word{i}" for i in range(30))
    docs = [(1, None), (2, ""), (3, long), (3, long), (4, long.upper().replace(" ", " - ")), (5, "y " * 20000 + long), (None, long)]
    golden = [(7, long), (7, long), (8, None), (9, "too short"), (None, long)]
    assert run(spark, docs, golden) == {(3, 7), (4, 7), (5, 7)}
    assert run(spark, [], golden) == set() and run(spark, docs, []) == set()


def test_two_substitutions(spark):
    docs, golden = corpus()
    edited = [(d, t.replace("W7", "Other").replace("W11", "Odd")) for d, t in docs]
    assert run(spark, edited, golden, max_substitutions=2) == brute(edited, golden, slack=2)


def test_masks_cover_every_choice_of_places():
    from itertools import combinations

    for span, k in ((13, 1), (13, 2), (5, 3), (8, 2)):
        masks = leakage.seed_masks(span, k)
        assert all(any(all(m[p] == "0" for p in gone) for m in masks) for gone in combinations(range(span), k))
        assert all("1" in m for m in masks)
