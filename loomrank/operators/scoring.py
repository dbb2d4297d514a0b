"""Scores of a document from its criteria, or from retrieval alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions import scores as S


def coverage(criteria: DataFrame, key: str) -> DataFrame:
    """Weighted credit and weight by category, must-haves apart, and the recency of what supports the score."""
    w, c = S.lookup(F.col("importance"), S.IMPORTANCE, 1.0), S.lookup(F.col("status"), S.CREDIT)
    core = F.col("category").isin(list(S.CATEGORY_WEIGHTS))
    must = core & (F.col("importance") == "must")
    shown = F.col("status").isin("direct", "transferable") & F.col("recency").isNotNull()
    aggs = []
    for name in S.CATEGORY_WEIGHTS:
        here = F.col("category") == name
        aggs += [F.sum(F.when(here, w * c)).alias(f"{name}_credit"), F.sum(F.when(here, w)).alias(f"{name}_weight")]
    aggs += [
        # the hair added before rounding lifts exact halves off the edge, where engines part
        F.round(F.sum(F.when(must, w * c)) / F.sum(F.when(must, w)) + 1e-9, 6).alias("must_have_coverage"),
        F.count(F.when(F.col("importance") == "must", 1)).alias("must_have_count"),
        F.round(F.sum(F.when(shown, w * F.col("recency"))) / F.sum(F.when(shown, w)) + 1e-9, 6).alias("evidence_recency"),
        F.max(((F.col("category") == "eligibility") & (F.col("status") == "conflict")).cast("int")).alias("conflict"),
    ]
    return criteria.groupBy(key).agg(*aggs)


def score_criteria(criteria: DataFrame, key: str) -> DataFrame:
    """``coverage`` with ``score``: categories share the points left by recency, renormalised over those present; a conflict caps it."""
    df = coverage(criteria, key)
    present = sum((F.when(F.col(f"{n}_weight") > 0, F.lit(p)).otherwise(0) for n, p in S.CATEGORY_WEIGHTS.items()), F.lit(0))
    budget = 100 - F.when(F.col("evidence_recency").isNotNull(), S.RECENCY_POINTS).otherwise(0)
    parts = [F.when(F.col(f"{n}_weight") > 0, budget * p / F.col("present") * F.col(f"{n}_credit") / F.col(f"{n}_weight")).otherwise(0.0) for n, p in S.CATEGORY_WEIGHTS.items()]
    df = df.withColumn("present", present)
    # the hair added before rounding lifts exact halves off the edge, where engines part
    raw = sum(parts, F.coalesce(S.RECENCY_POINTS * F.col("evidence_recency"), F.lit(0.0)))
    return df.withColumn("raw", raw).withColumn("score", F.round(F.when(F.col("conflict") == 1, F.least("raw", F.lit(float(S.CONFLICT_CAP)))).otherwise(F.col("raw")) + 1e-9, 4)).drop("raw", "present")


def score_local(df: DataFrame, relevance: Column, recency: Column, overlap: Column, preference: Column) -> DataFrame:
    """``df`` with ``score``: points of relevance, recency, skill overlap and preferences over the components that exist."""
    rel = S.clipped(relevance)
    values = {"relevance": rel, "recency": S.clipped(recency) * rel, "skill_overlap": overlap, "preferences": preference}
    budget = sum((F.when(v.isNotNull(), S.LOCAL_POINTS[n]).otherwise(0.0) for n, v in values.items()), F.lit(0.0))
    total = sum((F.coalesce(100 * S.LOCAL_POINTS[n] / F.col("__b") * v, F.lit(0.0)) for n, v in values.items()), F.lit(0.0))
    return df.withColumn("__b", budget).withColumn("score", F.round(total, 4)).drop("__b")


def preference_fraction(checks: list[Column]) -> Column:
    """Share of the stated preferences that are met; null if none is stated."""
    return sum((F.when(c, 1.0).otherwise(0.0) for c in checks), F.lit(0.0)) / len(checks) if checks else F.lit(None).cast("double")


def overlap_credit(skills: Column, demonstrated: list[str], attributed: list[str], listed: list[str]) -> Column:
    """Mean credit of a document's skills by the strongest tier in which the profile has them; null without skills."""
    tier = lambda s: F.when(s.isin(demonstrated), 1.0).when(s.isin(attributed), S.ATTRIBUTED_CREDIT).when(s.isin(listed), S.LISTED_CREDIT).otherwise(0.0)
    return F.when(F.size(skills) > 0, F.aggregate(F.transform(skills, tier), F.lit(0.0), lambda a, x: a + x) / F.size(skills))
