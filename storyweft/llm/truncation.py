"""Problem 5: texts cut off by a limit or in transfer.

Nobody labels cut texts, so the labels are made: values that are whole are cut
at random places, with and without signs of omission. A logistic regression on
hashed features of the closing characters, the punctuation and the distance to
the source's limit is fitted on these and scores every record.

Corpus statistics (how often a word stands inside a text, before a full stop, or
last; how long the texts of a source get, and whether they pile up at a length)
are taken over all records. Only the fitting uses a sample, bounded by
``sample_rows``.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from .lookalikes import fold

#: Signs and words of omission at the end of a text.
OMISSIONS = re.compile(
    r"\s*(?:(?:…|\.\.\.)?\s*(?:read more|continue reading|read on|more)\s*(?:…|\.\.\.|»|→)?|\(more\)|\[more\]|…?\s*\[\+\d+ chars\]"
    r"|\[(?:…|\.\.\.|&#8230;|&hellip;)\]|\((?:…|\.\.\.)\)|&#8230;|&hellip;|…|\.\.\.)$",
    re.IGNORECASE,
)
#: The signs put after artificial cuts.
SIGNS = ("", "", "", "…", " …", "...", " [...]", " […]", " [&#8230;]", " (more)", "… Read more", "... Continue reading", "… [+84 chars]")
_BLANKS = " \t\n\r\x0b\x0c "
_BITS = 16
#: Fewer words than this are never a limit: short texts differ too little in length.
LEAST_WORDS = 20
#: Open-ended texts a source must have before they can be its style.
STYLE_TEXTS = 20
_CLOSERS = ")]}\"'”’»›"


def _split_sign(text: str) -> tuple[str, bool]:
    """Text without signs of omission, and whether there were any."""
    text = "".join(c for c in text if unicodedata.category(c) != "Cf").strip()
    found = OMISSIONS.search(text)
    # a bare word is no sign unless dots stand before it; dots behind it are
    if found and found.group().strip()[:1].isalpha():
        found = re.search(r"\s*(?:…|\.\.\.)$", text)
    return (text[: found.start()].rstrip(), True) if found else (text, False)


def _end_class(base: str) -> str:
    """Kind of the last character, behind closing signs and symbols."""
    body = base
    while body and (unicodedata.category(body[-1]) in ("So", "Sk", "Mn", "Cf") and body[-1] != "�"):
        body = body[:-1].rstrip()
    symbol = "s" if len(body) < len(base) else ""
    closed = body.rstrip(_CLOSERS)
    quote = "q" if len(closed) < len(body) else ""
    c = unicodedata.normalize("NFKC", closed[-1:]) or "0"
    kind = c if c in ".!?,;:-–—" else "w" if c.isalpha() else "d" if c.isdigit() else "。" if c in "。！？" else "o"
    return symbol + quote + kind


def _step(n: float) -> int:
    return int(np.log2(n + 1))


def _features(text: str, raw: str, inner: float, stop: float, last: float, chars: float, words: float, bytes_: float, open_style: bool, piled: bool) -> list[str]:
    """Names of the features that hold for one text."""
    base, sign = _split_sign(text)
    end = _end_class(base)
    tokens = base.split()
    tail = tokens[-1] if tokens else ""
    loose = end[-1] not in ".!?。" or bool(re.search(r"\d\.$", tail))
    at_limit = abs(len(raw) - chars) <= 1 or abs(len(raw.encode("utf-8", "replace")) - bytes_) <= 2 or (words >= LEAST_WORDS and len(raw.split()) == words)
    shape = " ".join("N" if re.match(r"[\d,.%$]+$", w) else "X" if i and w[:1].isupper() else w.lower() for i, w in enumerate(tokens[:3]))
    sentences = min(2, len(re.findall(r"[.!?][)”\"']*\s", base)))
    style = f"{int(open_style)}{int(sign)}{int(loose)}"
    out = [
        f"end {end} {style}",
        f"style {style}",
        f"limit {int(at_limit and piled)} {style} {end}",
        f"sentences {sentences} {style}",
        f"short {min(len(tokens), 12)} {style}",
        f"unclosed {int(base.count('“') > base.count('”'))}{int(base.count('(') > base.count(')'))} {int(loose)}",
    ]
    if loose:
        word = tail.strip("".join(_CLOSERS) + "“‘(,;:-").lower()
        out += [
            f"word {word} {int(open_style)}",
            f"inner {min(_step(inner), 8)} {style}",
            f"stop {_step(1000 * stop / (inner + 1))} {min(_step(inner), 5)} {style}",
            f"last {min(_step(last), 6)} {_step(1000 * last / (inner + last + 1))} {style}",
            f"tail {tail[-3:].lower()} {style}",
            f"two {' '.join(tokens[-2:-1]).lower()} {int(open_style)}",
            f"opening {' '.join(shape.split()[:2])} {style}",
            f"opening {' '.join(shape.split()[:1])} {sentences} {style}",
            f"case {int(tail[:1].isupper())}{int(tail[-1:].isalpha())} {min(_step(inner), 2)} {style}",
            f"numdot {int(bool(re.search(r'[0-9]\.$', tail)))}",
        ]
    return out


def _hashed(features: list[str]) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "replace")) & ((1 << _BITS) - 1) for f in features]


_COLUMNS = ["inner", "stop", "last", "chars", "words", "bytes", "open_style", "piled"]


def _rows_of(pdf: pd.DataFrame, text: str) -> list[list[int]]:
    stats = [pdf[c].fillna(0).tolist() for c in _COLUMNS]
    return [_hashed(_features(t, r, *s)) for t, r, *s in zip(pdf[text], pdf["raw"], *stats)]


def _cut(text: str, seed: int, chars: float) -> str | None:
    """``text`` cut inside a word or a sentence; None where that can't be done."""
    rng = np.random.default_rng(seed)
    if len(text) < 12:
        return None
    for _ in range(8):
        at = int(min(chars, len(text) - 1)) if rng.random() < 0.15 else int(rng.integers(8, len(text)))
        if rng.random() < 0.5:
            at = text.rfind(" ", 0, at)
        base = text[:at].rstrip()
        if len(base) < 6:
            continue
        if _end_class(base)[-1] in ".!?。" and not (base[-1] == "." and text[len(base) : len(base) + 1].isdigit()):
            continue
        if at >= len(text.rstrip(_CLOSERS + ".!? ")):
            continue
        sign = SIGNS[int(rng.integers(len(SIGNS)))]
        # a multi-byte character halved in transfer
        if not sign and rng.random() < 0.04:
            base = text[:at] + "�"
        return base + sign
    return None


def fit_logistic(rows: list[list[int]], labels: np.ndarray, epochs: int = 150, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Weights of a logistic regression on hashed 0/1 features (Adagrad, full batch); the last is the bias."""
    size = (1 << _BITS) + 1
    cols = np.array([c for r in rows for c in (*r, size - 1)], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    w, seen = np.zeros(size), np.full(size, 1e-8)
    weight = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9)) / len(rows)
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[cols], len(rows)), -30, 30)))
        g = np.bincount(cols, ((p - labels) * weight)[owner], size) + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def _last_word(text: Column) -> Column:
    """Last run without blanks, stripped of punctuation, without signs of omission."""
    base = F.regexp_replace(text, r"(?i)\s*(\(more\)|(…|\.\.\.)\s*(read more|continue reading)|…?\s*\[\+\d+ chars\]|\[(…|\.\.\.|&#8230;)\]|…|\.\.\.)\s*$", "")
    return _core(F.element_at(F.split(F.rtrim(base), r"\s+"), -1))


def _core(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}�]+$", ""))


def _word_counts(texts: DataFrame) -> DataFrame:
    """``word, inner, stop, last``: occurrences within texts, of these before a full stop, and at an open end."""
    words = texts.select(F.posexplode(F.split(F.btrim("text"), r"\s+")).alias("i", "w"), F.size(F.split(F.btrim("text"), r"\s+")).alias("n"))
    raw = words.groupBy("w", (F.col("i") == F.col("n") - 1).alias("end")).count()
    stop = F.col("w").rlike(r"[.!?][)”\"']*$")
    return raw.groupBy(_core(F.col("w")).alias("word")).agg(
        F.sum(F.when(~F.col("end"), F.col("count")).otherwise(0)).alias("inner"),
        F.sum(F.when(~F.col("end") & stop, F.col("count")).otherwise(0)).alias("stop"),
        F.sum(F.when(F.col("end") & ~stop, F.col("count")).otherwise(0)).alias("last"),
    )


def _closed(text: Column) -> Column:
    """Ends with a full stop or the like, or with a symbol."""
    return text.rlike(r"([.!?。][)”\"'»]*|[\p{So}&&[^\x{FFFD}]])\s*$") & ~text.rlike(r"(…|\.\.\.|\[\.\.\.\])\s*$")


def _source_stats(texts: DataFrame) -> DataFrame:
    """Of each source: the length in characters, words and bytes that open-ended texts reach; whether they pile up there; whether open ends are its style."""
    open_ = ~_closed(F.col("text")) & ~F.col("text").rlike(r"(?i)(…|\.\.\.|[\])]|more|reading)\s*$")
    sized = texts.select(
        "source", open_.alias("open"), F.length("raw").alias("c"), F.octet_length("raw").alias("b"), F.size(F.split(F.btrim("raw"), r"\s+")).alias("w")
    )
    # a limit shows as a length near the longest at which open ends pile up; a few odd texts may be longer
    high = lambda c: F.percentile_approx(F.when(F.col("open"), F.col(c)), F.lit(0.95), F.lit(1000)).alias(c)
    top = sized.groupBy("source").agg(high("c"), high("w"), high("b"), F.count(F.lit(1)).alias("n"), F.sum(F.col("open").cast("int")).alias("opens"))
    top = top.select("source", F.col("c").alias("chars"), F.col("w").alias("words"), F.col("b").alias("bytes"), "n", "opens")
    at = lambda c, limit, slack: F.sum((F.col("open") & F.col(c).between(F.col(limit) - slack, F.col(limit))).cast("int"))
    sums = sized.join(top, "source").groupBy("source", "chars", "words", "bytes", "n", "opens").agg(
        at("c", "chars", 1).alias("pc"), F.when(F.col("words") >= LEAST_WORDS, at("w", "words", 0)).otherwise(0).alias("pw"), at("b", "bytes", 2).alias("pb")
    )
    most = F.greatest("pc", "pw", "pb")
    piled = most >= F.greatest(F.lit(3), F.col("opens") * 0.3)
    # a style shows in many texts: a fair share without a pile, or nearly all of them and no pile of most
    style = ((F.col("opens") >= F.col("n") * 0.3) & ~piled) | ((F.col("opens") >= F.col("n") * 0.8) & (most < F.col("opens") * 0.6))
    style = style & (F.col("opens") >= STYLE_TEXTS)
    return sums.select("source", "chars", "words", "bytes", (piled & ~style).alias("piled"), style.alias("open_style"))


def score_truncation(records: DataFrame, key: str, text: str, source: str, sample_rows: int = 12_000, seed: int = 5) -> DataFrame:
    """``(key, source, cut_score)`` of every record with a text: the chance that it was cut.

    NULL, empty and blank texts and NULL keys are left out. A NULL source is a source.
    ``sample_rows`` bounds the whole records that are cut for fitting. Without any
    whole record nothing can be learned, and every score is 0. A source whose texts
    are all open-ended and all of nearly one length is taken to have a limit there.
    """
    spark = records.sparkSession
    work = Workspace(spark, "truncation")
    texts = records.where(F.col(key).isNotNull() & (F.btrim(text, F.lit(_BLANKS)) != "")).select(
        F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("raw"), fold(F.col(text)).alias("text")
    )
    texts = work.stage(texts, "texts")
    sources = work.stage(_source_stats(texts), "sources")
    counts = work.stage(_word_counts(texts), "words")

    def described(df: DataFrame) -> DataFrame:
        return df.withColumn("word", _last_word(F.col("text"))).join(sources, "source", "left").join(counts, "word", "left")

    # whole: closed, or open where that is the source's style, or an address that ends many texts
    signed = F.col("text").rlike(r"(?i)(…|\.\.\.|[\])]|more|reading|�)\s*$")
    address = F.col("text").rlike(r"https?://\S+$") & (F.col("last") >= 5)
    whole = _closed(F.col("text")) | (F.col("open_style") & ~signed) | address
    picked = (
        described(texts).where(whole).withColumn("o", F.xxhash64("key", F.lit(seed))).orderBy("o", "key", "text").limit(sample_rows).select("o", "source", "text", "raw", "chars")
    )

    def labelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for o, s, t, r, c in zip(f["o"], f["source"], f["text"], f["raw"], f["chars"].fillna(10**6)):
                out.append((s, t, r, 0))
                for k in (1, 2):
                    cut = _cut(t, (o + k) & 0xFFFFFFFFFFFF, c)
                    if cut:
                        out.append((s, cut, cut, 1))
            yield pd.DataFrame(out, columns=["source", "text", "raw", "label"])

    made = picked.mapInPandas(labelled, "source string, text string, raw string, label int")

    train = described(made).select("text", "raw", "label", *_COLUMNS).toPandas()
    if len(train) and train["label"].nunique() == 2:
        weights = fit_logistic(_rows_of(train, "text"), train["label"].to_numpy(float))
    else:
        weights = np.zeros((1 << _BITS) + 1)
        weights[-1] = -30.0
    shipped = spark.sparkContext.broadcast(weights.astype(np.float32))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shipped.value
        for f in frames:
            z = np.array([w[r].sum() + w[-1] for r in _rows_of(f, "text")], float)
            yield pd.DataFrame({"key": f["key"], "source": f["source"], "cut_score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    kind = texts.schema["key"].dataType.simpleString()
    scored = described(texts).select("key", "source", "text", "raw", *_COLUMNS).mapInPandas(score, f"key {kind}, source string, cut_score double")
    return scored.select(F.col("key").alias(key), F.col("source").alias(source), "cut_score")


def truncated_items(items: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(item_id)`` of items whose lede was cut; the newest row of an id counts."""
    return score_truncation(_newest(items), "id", "lede", "outlet").where(F.col("cut_score") >= threshold).select(F.col("id").alias("item_id"))


def truncation_rates(items: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``(outlet, items, truncated, share)`` over all items of each outlet, those without a lede included."""
    newest = _newest(items)
    cut = score_truncation(newest, "id", "lede", "outlet").where(F.col("cut_score") >= threshold).select("id", F.lit(1).alias("cut"))
    joined = newest.join(cut, "id", "left")
    return joined.groupBy("outlet").agg(
        F.count(F.lit(1)).alias("items"), F.count("cut").alias("truncated"), F.round(F.count("cut") / F.count(F.lit(1)), 6).alias("share")
    )


def _newest(items: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("outlet", "lede"), F.struct("fetched", "published", "lede", "outlet"))
    return items.where(F.col("id").isNotNull()).groupBy("id").agg(newest.alias("x")).select("id", "x.outlet", "x.lede")
