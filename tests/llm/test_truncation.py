import random

from storyweft.llm import truncation

SCHEMA = "id string, outlet string, lede string, fetched string, published string, text string, word int, source string"
NAMES = ["Mira", "Torven", "Halden", "Brisk", "Olden", "Farrow", "Quist", "Senna"]
VERBS = ["repair", "measure", "replace", "review", "publish", "finance"]
NOUNS = ["harbour", "turbine", "archive", "railway", "printer", "festival", "library"]


def sentence(rng):
    return f"{rng.choice(NAMES)} and {rng.choice(NAMES)} agreed on {rng.choice(['Monday', 'Friday'])} to {rng.choice(VERBS)} the {rng.choice(NOUNS)} in {rng.choice(NAMES)} before the end of {rng.choice(['May', 'June'])}."


def corpus(n=1500):
    rng = random.Random(4)
    rows, cut = [], set()
    for i in range(n):
        outlet = f"o{i % 4}"
        text = " ".join(sentence(rng) for _ in range(rng.randrange(1, 4)))
        if outlet == "o3":
            who = " and ".join(rng.choice(NAMES) for _ in range(rng.randrange(1, 4)))
            text = f"What {who} plan for the {rng.choice(NOUNS)} and the {rng.choice(NOUNS)} of {rng.choice(NAMES)}{rng.choice(['', ' Bay', 'stad'])} in {rng.choice(['May', 'June'])}"
        elif outlet == "o0" and len(text) > 120:
            text = text[:120].rstrip()
            if not text.endswith("."):
                cut.add(str(i))
        elif rng.random() < 0.15:
            at = rng.randrange(20, len(text) - 8)
            text = text[:at].rstrip() + rng.choice(["", "…", " [...]", "... Continue reading", " (more)"])
            if "." not in text[at - 2 : at]:
                cut.add(str(i))
        rows.append((str(i), outlet, text, "f", "p", "t", 1, "s"))
    return rows, cut


def run(spark, rows):
    return {r.item_id for r in truncation.truncated_items(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_held_out_accuracy(spark):
    rows, cut = corpus()
    found = run(spark, rows)
    hit = len(found & cut)
    assert hit / max(1, len(found)) > 0.95 and hit / len(cut) > 0.95, (hit, len(found), len(cut))


def test_edges(spark):
    rows, _ = corpus(400)
    rows += [("null", "o1", None, "f", "p", "t", 1, "s"), ("empty", "o1", "", "f", "p", "t", 1, "s"), ("blank", None, "  \n", "f", "p", "t", 1, "s"), (None, "o1", "Mira agr", "f", "p", "t", 1, "s"),
             ("nosource", None, "Mira and Torven agreed on Friday to rep", "f", "p", "t", 1, "s"), ("long", "o1", sentence(random.Random(1)) * 2000, "f", "p", "t", 1, "s")]
    found = run(spark, rows + rows[:20])
    assert "nosource" in found and not found & {"null", "empty", "blank", None, "long"}


def test_nothing_to_learn_from(spark):
    assert run(spark, []) == set()
    assert run(spark, [("a", "o", "cut of", "f", "p", "t", 1, "s")]) == set()


def test_rates(spark):
    rows = [("a", "o", "Whole.", "f", "p", "t", 1, "s"), ("b", "o", None, "f", "p", "t", 1, "s")]
    r = truncation.truncation_rates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(x.outlet, x["items"], x.truncated, x.share) for x in r] == [("o", 2, 0, 0.0)]
