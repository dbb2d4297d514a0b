"""Texts that travel as what they are made from."""

from loomrank.operators import evidence as V
from loomrank.plans import evidence as P
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def shuffled(df):
    """The plan beneath the first exchanges."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("Exchange") :]


def test_payloads_are_the_same_and_no_text_is_shuffled(spark):
    plain = V.evidence_payloads(*P.built(spark, SF)).select("rid", F.length("payload").cast("long").alias("chars"), F.sha2("payload", 256).alias("hash"))
    late = P.evidence_payloads(spark, SF)
    assert late.count() == plain.count() > 0 and late.exceptAll(plain).isEmpty()
    assert "repeat(evidence" in shuffled(plain) and "repeat(evidence" not in shuffled(late)


def test_rerank_query_takes_the_text_only_where_the_headline_is_blank(spark):
    p = spark.createDataFrame([(1, " ", "x" * 5000), (2, None, "y" * 5000), (3, "H", "z" * 5000), (4, "", None), (5, " ", "w" * 9)], "rid long, headline string, text string")
    e = spark.createDataFrame([(5, 1, "T", "", "", ["a"], ["b"])], "rid long, place long, title string, organization string, summary string, highlights array<string>, technologies array<string>")
    df = V.rerank_queries(p, e)
    got = {r.rid: r.query for r in df.collect()}
    assert got == {1: "x" * 1200, 2: "y" * 1200, 3: "H", 4: "", 5: "T\na\nb"}
    assert "substring(text" in shuffled(df)
