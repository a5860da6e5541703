"""String functions on columns. NULL in, NULL out, unless a docstring says otherwise."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space in Java's regular expressions.
SPACE = r"(?U)\s+"


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda t: None if t is None else html.unescape(t))


def squeeze(c: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.btrim(F.regexp_replace(c, SPACE, " "))


def plain_text(markup: Column) -> Column:
    """Tags replaced by a blank, then entities resolved, then white space squeezed.

    In this order an escaped tag stays as text. Only values with an ``&`` go
    through Python.
    """
    bare = F.regexp_replace(markup, "<[^>]+>", " ")
    coded = F.contains(bare, F.lit("&"))
    return squeeze(F.when(coded, _unescape(F.when(coded, bare))).otherwise(bare))


def lede_of(summary: Column, description: Column, content: Column) -> Column:
    """Plain text of the first that is neither NULL nor empty; '' if there is none."""
    return plain_text(F.coalesce(F.nullif(summary, F.lit("")), F.nullif(description, F.lit("")), content, F.lit("")))


def words(c: Column) -> Column:
    """Runs without white space; an empty list for an empty text."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` words, joined by single blanks."""
    return F.array_join(F.slice(words(c), 1, n), " ")


def word_count(c: Column) -> Column:
    """Number of words; 0 for an empty text, NULL for NULL."""
    return F.when(c.isNotNull(), F.size(words(c)))


def author_name(raw: Column) -> Column:
    """Display name of ``address (Name)``; other names stay; empty gives NULL."""
    name = F.regexp_extract(raw, r"^\S+@\S+\s*\((.+)\)$", 1)
    return F.when(name != "", name).otherwise(F.nullif(raw, F.lit("")))


def clean_tags(tags: Column) -> Column:
    """Tags as plain text, without markup and entities; empty ones dropped, in their order."""
    bare = F.transform(tags, lambda t: F.regexp_replace(t, "<[^>]+>", " "))
    # a Python function takes no list element by element, so the tags pass through it as one text
    joined = F.array_join(bare, "\0")
    coded = F.contains(joined, F.lit("&"))
    resolved = F.when(coded, F.split(_unescape(F.when(coded, joined)), "\0")).otherwise(bare)
    return F.filter(F.transform(resolved, squeeze), lambda t: t.isNotNull() & (t != ""))


def folded_words(c: Column) -> Column:
    """Lower case with squeezed white space."""
    return F.lower(squeeze(c))


def slugify(c: Column) -> Column:
    """Lower-case letters and digits joined by single hyphens."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def embed_text(title: Column, lede: Column) -> Column:
    """Title and lede as one text; a NULL part counts as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(lede, F.lit("")))


def pair_question(*parts: Column) -> Column:
    """JSON of what a judge is shown of a pair; the score isn't among it."""
    return F.to_json(F.struct(*parts))
