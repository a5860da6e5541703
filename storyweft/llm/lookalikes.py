"""Problem 4: text that looks the same in different characters.

One form of each value is made in three steps. Folding: characters without width
go, every space becomes one blank, full-width and half-width forms, letters of
mathematical alphabets and ligatures become plain, accents are composed.
Script-aware repair: of each token of letters of several scripts the letters are
counted by script; look-alikes are replaced by those of the dominant script, or
failing that of the next, where the result is a word of the corpus. A token that is
all look-alikes is mixed too where it stands in a value of another script. Comparing:
values of one form that are different strings look the same.

Folding stays in the JVM for values whose characters need no composition; only
the others pass through an Arrow function.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..workspace import Workspace

#: Letters drawn like Latin ones, by script, each with its Latin letter.
CYRILLIC, CYRILLIC_AS = "аеорсухіјѕһԁԛԝѵгӏАВЕКМНОРСТУХІЈЅԌԚԜѴӀҮ", "aeopcyxijshdqwvrlABEKMHOPCTYXIJSGQWVIY"
GREEK, GREEK_AS = "οαγινρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "oayivpuABEZHIKMNOPTYXC"
ARMENIAN, ARMENIAN_AS = "օսհոցզյՕՏԼ", "ouhngqjOSL"
CHEROKEE, CHEROKEE_AS = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᎩᏃ", "ABCDEGHJKLMPRSTVWYZ"


@lru_cache(1)
def _plain_table() -> dict[int, str]:
    """Code point -> what it is folded to, from the character database."""
    table: dict[int, str] = {}
    for cp in range(0x110000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if cp < 0x20 or kind == "Zs" or kind in ("Zl", "Zp") or cp == 0x85:
            if c != " ":
                table[cp] = " "
        elif kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            table[cp] = ""
        elif unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")) or 0xFB00 <= cp <= 0xFB06 or (kind[0] == "L" and unicodedata.decomposition(c).startswith("<font>")):
            table[cp] = unicodedata.normalize("NFKC", c)
    return table


def fold_text(text: str) -> str:
    """Folded form of one value."""
    out = unicodedata.normalize("NFC", text.translate(_plain_table()))
    return " ".join(p for p in out.split(" ") if p)


@F.pandas_udf(StringType())
def _fold_py(values: pd.Series) -> pd.Series:
    return values.map(lambda t: None if t is None else fold_text(t))


@F.pandas_udf(StringType())
def _compose_py(values: pd.Series) -> pd.Series:
    return values.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: Ranges that composition never changes and whose folding is one replacement a character.
_INERT = (
    (0x00, 0x2FF), (0x370, 0x373), (0x375, 0x37D), (0x37F, 0x386), (0x388, 0x482), (0x48A, 0x52F), (0x1E00, 0x1EFF),
    (0x2002, 0x2064), (0x20A0, 0x20BF), (0x2100, 0x2125), (0x3000, 0x3029), (0x3041, 0x3096), (0x309B, 0x30FF),
    (0x4E00, 0x9FFF), (0xFB00, 0xFB06), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF01, 0xFF60), (0xFFFD, 0xFFFD), (0x1F300, 0x1FAFF),
)
_SIMPLE = "^[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _INERT) + "]*$"


def fold(c: Column) -> Column:
    """``fold_text`` as a column; NULL stays NULL."""
    table = {k: v for k, v in _plain_table().items() if k < 0x10000}
    one = {k: v for k, v in table.items() if len(v) == 1}
    gone = [k for k, v in table.items() if not v]
    source = "".join(map(chr, one)) + "".join(map(chr, gone))
    # as many bytes as characters: ASCII; most values end here without a pattern over all of them
    tidy = ~(F.contains(c, F.lit("  ")) | c.startswith(" ") | c.endswith(" "))
    ascii_only = (F.octet_length(c) == F.length(c)) & tidy & ~c.rlike(r"[\x00-\x1F\x7F]")
    simple = c.rlike(_SIMPLE)
    folded = F.translate(c, source, "".join(one.values()))
    for cp in range(0xFB00, 0xFB07):
        folded = F.replace(folded, F.lit(chr(cp)), F.lit(table[cp]))
    folded = F.btrim(F.regexp_replace(folded, " {2,}", " "))
    # only values that need it are sent to Python
    other = _fold_py(F.when(~simple, c))
    return F.when(ascii_only, c).when(simple, folded).otherwise(other)


_LETTERS = r"[\p{L}\p{M}]+"
_PIECES = r"([\p{L}\p{M}]+|[^\p{L}\p{M}]+)"
_NOT_LETTERS = r"[^\p{L}\p{M}]+"
#: Scripts that share letters with Latin, in the order in which they are tried when as many letters of a token are of each.
_SCRIPTS = {"Cyrillic": (CYRILLIC, CYRILLIC_AS), "Greek": (GREEK, GREEK_AS), "Armenian": (ARMENIAN, ARMENIAN_AS), "Cherokee": (CHEROKEE, CHEROKEE_AS)}
_FOREIGN = "[" + "".join(rf"\p{{Is{s}}}" for s in _SCRIPTS) + "]"
_TWINS = ("".join(x for x, _ in _SCRIPTS.values()), "".join(y for _, y in _SCRIPTS.values()))


def as_latin(c: Column) -> Column:
    """Look-alike letters as Latin ones, wherever they stand."""
    return F.when(c.rlike(_FOREIGN), F.translate(c, *_TWINS)).otherwise(c)


def _as_script(c: Column, script: str) -> Column:
    """Letters of other scripts as those of ``script`` that look like them; letters without a twin stay."""
    own, latin = _SCRIPTS[script]
    back = {y: x for x, y in reversed(list(zip(own, latin)))}
    pairs = [(x, back[y]) for x, y in zip(*_TWINS) if y in back and x not in own] + list(back.items())
    return F.translate(c, "".join(x for x, _ in pairs), "".join(y for _, y in pairs))


def _letters(c: Column, script: str) -> Column:
    return F.length(F.regexp_replace(c, rf"[^\p{{Is{script}}}]", ""))


def _targets(piece: Column, latin_value: Column) -> Column:
    """What a token may stand for, best first: ``(n, s, target)`` in each script that all its letters have twins in.

    Only tokens of two scripts or more have any, and tokens of look-alikes in a value of
    Latin words.
    """
    counts = {"Latin": _letters(piece, "Latin")} | {s: _letters(piece, s) for s in _SCRIPTS}
    several = sum(((n > 0).cast("int") for n in counts.values()), F.lit(0)) > 1
    out = []
    for k, (script, n) in enumerate(counts.items()):
        target = as_latin(piece) if script == "Latin" else _as_script(piece, script)
        others = "".join(rf"\p{{Is{x}}}" for x in counts if x != script)
        fits = several & (n > 0) if script != "Latin" else (several & (n > 0)) | (latin_value & ~several & piece.rlike(_FOREIGN))
        out.append(F.when(fits & ~target.rlike(f"[{others}]"), F.struct((-n).alias("n"), F.lit(k).alias("s"), target.alias("target"))))
    return F.array_sort(F.array_compact(F.array(*out)))


def folded_stage(values: DataFrame, keys: list[str], text: str, work: Workspace) -> DataFrame:
    """``values`` written once with ``alt``, the folded text where it differs, and ``odd``, whether it holds foreign letters."""
    folded = values.select(*keys, text, fold(F.col(text)).alias("_f"))
    return work.stage(folded.select(*keys, text, F.when(F.col("_f") != F.col(text), F.col("_f")).alias("alt"), F.col("_f").rlike(_FOREIGN).alias("odd")), "folded")


def one_form(folded: DataFrame, keys: list[str], text: str, work: Workspace) -> DataFrame:
    """``keys, text, form`` of a folded stage: each text in the one consistent form.

    ``keys`` name a row; several texts under one key are mended apart. The vocabulary
    is that of all the texts. NULL stays NULL, an empty text stays empty.
    """
    now = F.coalesce("alt", text)
    odd = work.stage(folded.where("odd").select(*keys, text, now.alias("_folded"), F.xxhash64(text).alias("_v")), "odd")
    words = F.regexp_extract_all("_folded", F.lit(f"({_LETTERS})"), F.lit(1))
    latin_words = F.size(F.filter(words, lambda w: w.rlike(r"\p{IsLatin}")))
    own_words = F.size(F.filter(words, lambda w: as_latin(w).rlike(_FOREIGN)))
    pieces = odd.withColumn("_latin", latin_words >= own_words).select(
        *keys, "_v", "_latin", F.posexplode(F.regexp_extract_all("_folded", F.lit(_PIECES), F.lit(1))).alias("_pos", "piece")
    )
    mixed = pieces.where(F.col("piece").rlike(_FOREIGN)).select("_latin", "piece").distinct()
    mixed = mixed.select("_latin", "piece", F.posexplode(_targets(F.col("piece"), F.col("_latin"))).alias("_n", "_t")).select("_latin", "piece", "_n", F.col("_t.target").alias("target"))
    marked = F.col("target").rlike(r"\p{M}")
    mixed = work.stage(mixed.withColumn("target", F.when(marked, _compose_py(F.when(marked, F.col("target")))).otherwise(F.col("target"))), "mixed")
    # vocabulary: words as they stand in the texts, and results on which several spellings agree
    agreed = mixed.groupBy("target").agg(F.countDistinct("piece").alias("n")).where("n > 1").select("target")
    known = folded.select(F.explode(F.split(now, _NOT_LETTERS)).alias("target")).distinct().unionByName(agreed)
    repairs = mixed.join(known, "target", "left_semi").groupBy("_latin", "piece").agg(F.min_by("target", "_n").alias("target"))
    mended = (
        pieces.join(repairs, ["_latin", "piece"], "left")
        .groupBy(*keys, "_v")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("target", "piece").alias("s")))).alias("l"))
        .select(*keys, "_v", F.array_join(F.transform(F.array_distinct("l"), lambda x: x["s"]), "").alias("form"))
    )
    repaired = work.stage(odd.dropDuplicates([*keys, "_v"]).join(mended, [*keys, "_v"]).select(*keys, text, "form"), "repaired")
    return folded.where(~F.coalesce("odd", F.lit(False))).select(*keys, text, now.alias("form")).unionByName(repaired)


def text_values(items: DataFrame, quotes: DataFrame) -> DataFrame:
    """``(field, record_id, item_id, value)`` of titles, ledes and quotes; NULL ids, NULL and empty values are left out."""
    of_items = items.where(F.col("id").isNotNull()).select(
        F.col("id").alias("item_id"),
        F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("value")), F.struct(F.lit("lede").alias("field"), F.col("lede").alias("value")))).alias("x"),
    ).select("x.field", F.col("item_id").alias("record_id"), "item_id", "x.value")
    of_quotes = quotes.where(F.col("quote_id").isNotNull()).select(
        F.lit("quote").alias("field"), F.col("quote_id").cast("string").alias("record_id"), "item_id", F.col("quote").alias("value")
    )
    return of_items.unionByName(of_quotes).where(F.col("value") != "")


KEYS = ["field", "record_id", "item_id"]


def text_forms(items: DataFrame, quotes: DataFrame) -> DataFrame:
    """``(field, record_id, item_id, value, form)`` of every title, lede and quote."""
    work = Workspace(items.sparkSession, "forms")
    return one_form(folded_stage(text_values(items, quotes), KEYS, "value", work), KEYS, "value", work)


def same_looking(items: DataFrame, quotes: DataFrame) -> DataFrame:
    """``(field, record_id)`` of values that look like another item's value, or like a stretch of their item, in other characters.

    Titles and ledes: another id has a different string of the same form; every row of
    an id counts. Quotes: the quote occurs in neither title nor lede as it is, but its
    form is in the form of one of them. NULL and empty values, unknown items and NULL
    ids give no row. Repeated rows count once.
    """
    work = Workspace(items.sparkSession, "looks")
    forms = one_form(folded_stage(text_values(items, quotes), KEYS, "value", work), KEYS, "value", work)
    own = forms.where((F.col("field") != "quote") & (F.col("form") != "")).select("field", "record_id", F.unhex(F.md5("form")).alias("look"), F.xxhash64("value").alias("v"))
    own = work.stage(own, "own")
    # where a form has two strings and two ids, every id has another's different string
    twice = (
        own.groupBy("field", "look")
        .agg(F.min("v").alias("v1"), F.max("v").alias("v2"), F.min("record_id").alias("r1"), F.max("record_id").alias("r2"))
        .where((F.col("v1") != F.col("v2")) & (F.col("r1") != F.col("r2")))
    )
    alike = own.join(twice.select("field", "look"), ["field", "look"], "left_semi").select("field", "record_id")

    of_item = forms.where(F.col("field") != "quote").select("item_id", F.col("value").alias("whole"), F.when(F.col("form") != F.col("value"), F.col("form")).alias("whole_form"))
    quoted = forms.where((F.col("field") == "quote") & (F.col("form") != "")).select("record_id", "item_id", "value", "form")
    found = (
        quoted.join(of_item, "item_id")
        .groupBy("record_id", "item_id", F.xxhash64("value").alias("v"))
        .agg(F.max(F.contains("whole", "value")).alias("verbatim"), F.max(F.contains(F.coalesce("whole_form", "whole"), F.col("form"))).alias("looks"))
        .where(F.col("looks") & ~F.col("verbatim"))
        .select(F.lit("quote").alias("field"), "record_id")
    )
    return alike.unionByName(found).distinct()
