"""Work that must not run in the one task that reads a small file, and rules that were written out many times over."""

from pyspark.sql import functions as F

from loomrank.functions import skills as K
from loomrank.functions import text as T
from loomrank.operators import profile as R
from loomrank.plans import inputs, profiles

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_profiles_are_dealt_out_before_any_pattern(spark):
    assert inputs.profiles(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for query in (profiles.profile_lines, profiles.availabilities, profiles.skill_mentions):
        below = plan_of(query(spark, SF)).split("RepartitionByExpression")
        # nothing is asked of the texts where the table is read
        assert len(below) == 2 and "Sam Example" not in below[1]


def test_a_heading_is_made_bare_once(spark):
    text = plan_of(spark.range(1).select(F.col("id").cast("string").alias("line")).select(R.heading_kind(F.col("line")).alias("kind")))
    assert text.count("#{1,6}") == 1


def test_aliases_by_letter_are_those_by_name(spark):
    names = sorted(K.NAME_OF, key=len, reverse=True)
    plain = rf"(?<!{K.EDGE})(?=((?:" + "|".join(f"\\Q{a}\\E" for a in names) + rf")(?!{K.EDGE})))"
    texts = [*names, *(f"x{a}" for a in names), *(f"{a}s" for a in names), *(f"{a}, {b}/{a}" for a, b in zip(names, names[7:])), "c/c++ c++ c, c++ node.js.x react.jsx rest apis restful"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(plain), F.lit(1)).alias("a"), F.regexp_extract_all("t", F.lit(K.ANY_ALIAS), F.lit(1)).alias("b")).collect()
    assert [r.t for r in rows if r.a != r.b] == [] and any(len(r.a) > 2 for r in rows)


def test_texts_without_a_spelled_number_spare_the_patterns(spark):
    texts = ["An Eight-month or SIXTEEN week term", "one month, two  terms; phone months", "someone month", "no number", "", None, "ten – weeks, Twelve term\x00 so­ft"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.digits_for_words(F.col("t")).alias("d"), T.clean_unicode(F.col("t")).alias("c")).collect()
    assert [r.d for r in got] == ["An 8-month or 16 week term", "1 month, 2  terms; phone months", "someone month", "no number", "", None, "10 – weeks, 12 term\x00 so­ft"]
    assert got[-1].c == "ten – weeks, Twelve term  soft"
