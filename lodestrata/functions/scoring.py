"""Scoring functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: BM25 and fusion constants (fixed values).
K1, B, RRF_K, IDF_FLOOR = 1.5, 0.75, 60, 0.25
DECAY, HALF_LIFE_DAYS = 0.693, 30.0


def bm25(idf: Column, tf: Column, length: Column, average: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length / average))


def idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def decay(days: Column) -> Column:
    return F.exp(-DECAY * days / HALF_LIFE_DAYS)


def heat(hits: Column, days_since_hit: Column, days_since_created: Column) -> Column:
    """Usage and freshness in one figure, four places."""
    return F.round(0.7 * hits * decay(days_since_hit) + 0.3 * decay(days_since_created), 4)


def sigmoid(z: Column) -> Column:
    """The logistic function, without overflow at either end."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


#: Bonus for each distinct query token found in the content (fixed value).
COVERAGE = 1.5


def lucene_bm25(n: Column, df: Column, tf: Column, length: Column, average: Column) -> Column:
    """BM25 as search engines on inverted indexes score it: the idf is never negative, and tf is not scaled by k1 + 1."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + K1 * ((1 - B) + B * length / average))


def zero_failure_bound(n: Column, confidence: float = 0.95) -> Column:
    """Least success rate that n trials without a failure show."""
    return F.when(n > 0, F.pow(F.lit(1 - confidence), 1.0 / n)).otherwise(0.0)


def normal_rect(x0: Column, y0: Column, x1: Column, y1: Column, dpi: float | None = None) -> Column:
    """A rectangle with its lesser corner first; pixels at ``dpi`` become points."""
    k = 72.0 / dpi if dpi else 1.0
    return F.struct((F.least(x0, x1) * k).alias("x0"), (F.least(y0, y1) * k).alias("y0"), (F.greatest(x0, x1) * k).alias("x1"), (F.greatest(y0, y1) * k).alias("y1"))
