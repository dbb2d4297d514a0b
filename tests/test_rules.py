"""Golden cases of text, deadline, term and scoring rules."""

import random

import pytest
from pyspark.sql import functions as F

from loomrank.functions import scores as S
from loomrank.functions import text as T
from loomrank.operators import eligibility, retrieval, rules, scoring
from loomrank.sources import html


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("value", "state"), [("2031-05-03", "passed"), ("2031-05-04", "open"), ("May 4, 2031", "open"), ("4-May-2031", "open"), ("May 4, 2031 7:59 AM", "passed"), ("May 4th, 2031 at 8:01 AM (EDT)", "open"), ("2031-05-04T11:59:00Z", "passed"), ("2031-05-04T12:01:00Z", "open"), ("2031-05-04T14:30:00+02:00", "open"), ("2031-05-04 07:59:59", "passed"), ("2031-05-04T08:01", "open"), ("20310504", "passed"), ("20310505", "open"), ("20310504T0801", "open"), ("2031-05-04T11:59:59.5+00:00", "passed"), ("2031-05-04 08:01:00-04:00", "open"), ("2031-05-04T13:59+0200", "passed"), ("2031-02-30T09:00:00", "unread"), (" ", "blank"), ("by the end of spring", "unread")])
def test_deadlines(spark, value, state):
    assert one(spark, eligibility.deadline_state(F.col("v"), "2031-05-04 08:00:00", "America/Toronto"), v=value) == state


@pytest.mark.parametrize(("text", "months"), [("Two six-month rotations; then a 3 month one.", [6]), ("Stay nine months or 12 months\nor 15 months.", [9, 12, 15]), ("A 36 month lease", None), ("Bring tea.", None)])
def test_terms(spark, text, months):
    assert one(spark, T.term_months(F.col("v")), v=text) == months


@pytest.mark.parametrize(("text", "found"), [("Candidates must be permanent residents", "must be permanent residents"), ("Citizens only", "Citizens only"), ("A citizen of the world is not required", None), ("Must be a citizen or have a study visa; or international students", "Must be a citizen"), ("must hold citizenship or a work permit", None), ("Joined with the Student Work Placement Program", "programme"), (None, None)])
def test_restrictions(spark, text, found):
    assert one(spark, eligibility.restriction(F.array(F.coalesce(F.col("v"), F.lit("")))), v=text) == found


def test_term_limit():
    assert [eligibility.term_limit(p, s) for p, s in ((None, [4, 8]), (6, [8]), (0, [8]), (True, [8]), ("6", []), (None, []))] == [8, 6, None, 8, None, None]


def test_tokens_and_mentions(spark):
    assert one(spark, T.tokens(F.col("v")), v="We use C++, node.js and 2024 Straße!") == ["use", "c++", "node.js", "strasse"]
    assert one(spark, T.mentions(F.col("v"), "go"), v="going to GO.") is True
    assert one(spark, T.mentions(F.col("v"), "go"), v="going") is False
    assert one(spark, T.csv_guard(F.col("v")), v=" =1+1") == "' =1+1"


@pytest.mark.parametrize(("status", "score"), [("direct", 100.0), ("transferable", 60.0), ("missing", 0.0), ("unknown", 0.0)])
def test_single_criterion(spark, status, score):
    df = spark.createDataFrame([(1, "technical", "must", status, None)], "id long, category string, importance string, status string, recency double")
    assert scoring.score_criteria(df, "id").first().score == pytest.approx(score, abs=1e-3)


def test_conflict_caps(spark):
    df = spark.createDataFrame([(1, "technical", "must", "direct", None), (1, "eligibility", "must", "conflict", None)], "id long, category string, importance string, status string, recency double")
    assert scoring.score_criteria(df, "id").first().score == pytest.approx(20, abs=1e-3)


def test_recency_and_sigmoid(spark):
    assert one(spark, S.recency_weight(F.col("v")), v=24.0) == 0.7
    assert one(spark, S.sigmoid(F.col("v")), v=1e9) == pytest.approx(1)
    assert one(spark, S.clipped(F.lit(None).cast("double")), v=0.0) is None


def test_dense_short_text_beats_long(spark):
    docs = spark.createDataFrame([(1, "python queue"), (2, "python queue " + " ".join(f"filler{i}" for i in range(200))), (3, None)], "id long, text string")
    query = spark.createDataFrame([("python", 1.0), ("queue", 1.0)], "term string, weight double")
    got = {r.id: r.score for r in retrieval.bm25(docs, "id", F.col("text"), query).collect()}
    assert set(got) == {1, 2} and got[1] > got[2]


def test_global_rank_is_a_permutation(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    rows = retrieval.global_rank(df, "r", F.col("v").desc(), F.col("id").asc()).orderBy("r").collect()
    assert [r.r for r in rows] == list(range(1, 1001)) and [(-r.v, r.id) for r in rows] == sorted((-r.v, r.id) for r in rows)


def test_merge_keeps_what_a_blank_would_overwrite(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, ""), (1, 3, None), (2, 1, "")], "id long, seq long, v string")
    assert {r.id: r.v for r in rules.upsert(df, "id", ["seq"], ["v"]).collect()} == {1: "a", 2: None}


def test_labelled_values(spark):
    page = "<table><tr><th>Job Title:</th><td>A <b>B</b></td></tr></table><dl><dt>Location</dt><dd>X</dd></dl>"
    rows = html.labelled_values(spark.createDataFrame([(1, page)], "id long, html string"), "id", F.col("html")).collect()
    assert {(r.label, r.value) for r in rows} == {("jobtitle", "A B"), ("location", "X")}


def test_latest_before_equals_a_scan(spark):
    rng = random.Random(5)
    rows = [(i, 0 if rng.random() < 0.7 else rng.randint(1, 3), rng.randint(0, 40), rng.random() < 0.2) for i in range(400)] + [(900, None, 3, True), (901, 0, None, True), (902, 0, 5, None), (903, 3, 41, False), (904, None, 9, False), (905, 0, None, False)]
    df = spark.createDataFrame(rows, "v long, k int, t int, s boolean")
    got = {r.v: r.latest for r in rules.latest_before(df, "k", "t", F.floor(F.col("t") / 7), F.col("s"), "v").collect()}
    want = {}
    for v, k, t, s in rows:
        best = max(((t2, v2) for v2, k2, t2, s2 in rows if s2 and k is not None and k2 == k and t2 is not None and t is not None and t2 <= t), default=None)
        want[v] = best[1] if best else None
    assert got == want


def test_latest_before_of_nothing(spark):
    df = spark.createDataFrame([], "v long, k int, t int, s boolean")
    assert rules.latest_before(df, "k", "t", F.col("t"), F.col("s"), "v").count() == 0
