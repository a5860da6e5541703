"""Vectors, scores and bands."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Vector of length 1; the zero vector stays zero."""
    # bound by a list of one: a norm that stands within the function would be worked out for every element
    return F.element_at(F.transform(F.array(F.sqrt(dot(v, v))), lambda norm: F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))), 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 where either vector is zero."""
    norm = lambda v: F.sqrt(dot(v, v))
    safe = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot(a, b) / (safe(norm(a)) * safe(norm(b)))


def hash_vector(text: Column, dim: int = 8) -> Column:
    """Reproducible vector of a text: 4-byte words of its sha256, as numbers in [-1, 1)."""
    digest = F.sha2(text, 256)
    word = lambda i: F.conv(F.substring(digest, 8 * (i % 8) + 1, 8), 16, 10).cast("double")
    return F.array(*[word(i) / F.lit(4294967296.0) * 2 - 1 for i in range(dim)])


def sample_bucket(score: Column, floor: float, width: float) -> Column:
    """Bucket of the score rounded to 6 places, from ``floor`` up; scores outside go to the first or last."""
    n = max(1, math.ceil((1 - floor) / width))
    at = F.floor((F.round(score, 6) - F.lit(floor)) / F.lit(width)).cast("int")
    return F.least(F.greatest(at, F.lit(0)), F.lit(n - 1))


def spread_bucket(score: Column, low: Column, high: Column, n: int = 8) -> Column:
    """One of ``n`` equal parts of [low, high]; 0 if all scores are alike."""
    at = F.floor((score - low) / (high - low) * n).cast("int")
    return F.when(high <= low, 0).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)))


def band(score: Column, edges: list[float]) -> Column:
    """Lower edge of the band; ``edges`` descend, scores below all of them are in band 0."""
    out = F.when(score >= edges[0], F.lit(edges[0]))
    for e in edges[1:]:
        out = out.when(score >= e, F.lit(e))
    return out.otherwise(F.lit(0.0))


def verdict(p: Column, yes: float = 0.9, no: float = 0.1) -> Column:
    """TRUE, FALSE, or NULL between the two."""
    return F.when(p >= yes, True).when(p < no, False)


def rate(n: Column, d: Column) -> Column:
    """Share; 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def rate_or_null(n: Column, d: Column) -> Column:
    """Share; NULL where there is nothing to divide by."""
    return F.try_divide(n, d)
