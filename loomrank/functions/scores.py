"""Weights and numeric functions of the scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scores.
BM25_K1, BM25_B = 1.5, 0.75
LISTED_WEIGHT = 0.3
SATURATION = 12.0
FLOOR, CEILING, BLEND = 0.35, 0.80, 0.7
RRF = 60
CATEGORY_WEIGHTS = {"technical": 35, "experience": 40, "domain": 25}
IMPORTANCE = {"must": 2.0, "preferred": 1.0}
CREDIT = {"direct": 1.0, "transferable": 0.6, "missing": 0.0, "unknown": 0.0, "conflict": 0.0}
PREFERENCE_POINTS, RECENCY_POINTS, CONFLICT_CAP = 10, 10, 20
HALF_LIFE, RECENCY_FLOOR, RECENCY_UNKNOWN = 24.0, 0.4, 0.7
LOCAL_POINTS = {"relevance": 55.0, "recency": 15.0, "skill_overlap": 25.0, "preferences": 10.0}
ATTRIBUTED_CREDIT, LISTED_CREDIT = 0.75, 0.5
POOL, NEAR_TIE = 150, 3.0


def lookup(key: Column, table: dict, default: float = 0.0) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def recency_weight(months: Column) -> Column:
    """Two-year half-life above a floor; unknown ages keep a neutral weight."""
    return F.coalesce(F.round(RECENCY_FLOOR + (1 - RECENCY_FLOOR) * F.pow(F.lit(0.5), months / HALF_LIFE), 4), F.lit(RECENCY_UNKNOWN))


def saturated(score: Column) -> Column:
    return score / (score + SATURATION)


def clipped(x: Column) -> Column:
    """x between 0 and 1; null stays null, which ``least`` and ``greatest`` alone would pass over."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def calibrated(similarity: Column) -> Column:
    return clipped((similarity - FLOOR) / (CEILING - FLOOR))


def relevance(lexical: Column, semantic: Column) -> Column:
    """Calibrated similarity blended with saturated BM25; BM25 alone where there is no similarity."""
    lex = saturated(lexical)
    return F.round(F.when(semantic.isNull(), lex).otherwise(BLEND * calibrated(semantic) + (1 - BLEND) * lex), 6)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector at length 1; a vector of nothing stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12)))
