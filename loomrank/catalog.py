"""Names of the queries, their DataFrames and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.functions import scores as S
from loomrank.operators import retrieval as R
from loomrank.operators import scoring
from loomrank.plans import boardpages, crawl, drafts, evidence, matching, postings, profiles, records, streams, unicode

PLANS = (matching, records, postings, profiles, crawl, boardpages, streams, evidence, drafts, unicode)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for plan in PLANS for k, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for plan in PLANS for k, sql in plan.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str, limit: int = 100) -> DataFrame:
    """The whole ranking: filter, BM25, similarity, fusion, local score, top rows."""
    docs = matching.read(spark, sf_dir, "documents").where("coalesce(text, '') <> ''")
    lexical = R.bm25(docs, "doc_id", F.col("text"), matching.weighted_query_terms(spark, sf_dir))
    semantic = matching.similarity(spark, sf_dir)
    labelled = docs.select("doc_id", "source", "lang", (F.col("doc_id") % 10).alias("owner")).join(lexical, "doc_id", "left").join(semantic, "owner", "left")
    fused = R.reciprocal_rank_fusion(labelled, "doc_id", "score", "semantic").withColumnRenamed("score", "lexical")
    preference = scoring.preference_fraction([F.col("lang") == "en"])
    out = scoring.score_local(fused, S.relevance(F.coalesce("lexical", F.lit(0.0)), F.col("semantic")), F.col("recency"), F.lit(None).cast("double"), preference)
    return out.orderBy(F.col("score").desc(), F.lower("source"), "doc_id").limit(limit).select("doc_id", "lexical", "semantic", "recency", "r_lex", "r_sem", "fused", "score")
