import random
from array import array

import pytest

from storyweft.llm import tokens

tiktoken = pytest.importorskip("tiktoken")
PATH = f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def ranks():
    return tokens.parse_ranks(tokens.load_ranks(PATH))


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("own", pat_str=tokens.SPLIT, mergeable_ranks=ranks, special_tokens={})


def ids(encoder, text):
    out = array("i")
    encoder.extend(out, text)
    return list(out)


def test_random_texts(ranks, known):
    encoder = tokens.Encoder(ranks)
    rng = random.Random(5)
    letters = "ab cdE's\n\t  éß漢字🛰️​　123,.!?-'xyz<|endoftext|>"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(50)))
        assert ids(encoder, text) == known.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 3000, " " * 500 + "x", "ab" * 2000, "\n" * 50 + " y", "x  y   z", " lead", "trail ", "antidisestablishmentarianism" * 40])
def test_long_and_odd(ranks, known, text):
    assert ids(tokens.Encoder(ranks), text) == known.encode_ordinary(text)


def test_transducer_emits_early(ranks):
    machine = tokens.MergeTransducer(ranks)
    state, settled, most = machine.start, 0, 0
    for i, b in enumerate(b"internationalisation and " * 40):
        state, out = machine.step(state, b)
        settled += sum(len(machine.bytes_of[t]) for t in out)
        most = max(most, i + 1 - settled)
    assert most <= 2 * machine.longest


def test_frame_round_trip(spark):
    texts = ["Héllo  wörld 🛰️", "", None, "x" * 20000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "ids?", i) for i, t in enumerate(texts)], "doc_id long, text string, ids string, keys int")
    made = tokens.encode_texts(docs)
    assert made.columns == ["doc_id", "ids"]
    rows = {r.doc_id: r.ids for r in made.collect()}
    assert rows[1] == rows[2] == [] and len(rows) == 6
    back = {r.doc_id: r.text for r in tokens.decode_ids(made).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_decoder_holds_unfinished_characters(ranks):
    reader = tokens.Utf8Reader(ranks)
    parts = [ranks[bytes([b])] for b in "🛰".encode()]
    assert reader.read(parts) == "🛰" and reader.read(parts[:2]) == "�"


def test_empty_table(spark):
    assert tokens.encode_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
