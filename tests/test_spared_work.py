"""Work that rules and streams are spared, with the results that they had."""

from loomrank.functions import skills as K
from loomrank.functions import text as T
from loomrank.operators import drafts as D
from loomrank.operators import eligibility as E
from loomrank.operators import profile as R
from loomrank.operators import retrieval as R0
from loomrank.plans import drafts, inputs, matching, postings, streams
from loomrank.streaming.reuse import REUSE_SECONDS, Reuse, ends
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_split_is_that_of_merged_postings_and_shuffles_no_text(spark):
    rules = (inputs.NOW, inputs.ZONE, postings.KEYWORDS, 8)
    df = postings.rendered(spark, SF)
    one = E.merged_duplicates(df)
    ruled = E.split_postings(one, *rules).select("pos", "reason", "warning")
    again = df.join(one.select("key", "first_pos"), "key").where("pos > first_pos").select("pos", F.lit("duplicate"), F.lit(""))
    got = postings.posting_split(spark, SF)
    assert got.exceptAll(ruled.unionAll(again)).isEmpty() and got.count() == df.count()
    grouped = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line]
    assert grouped and not any("description" in line for line in grouped)


def test_a_terms_sentence_is_looked_for_once(spark):
    plan = postings.term_facts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Work Term Duration:\\s") == 1


def test_months_are_named_where_there_are_any(spark):
    texts = ["4 month", "04-months", "00 month", "25 month", "25 month or 4 - month", "124 month", "x4 month", "24\n– MONTH", "0 month 1month", "month 5", "", None, "99 months 24 months", "1 2 month"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.names_months(F.col("t")).alias("a"), (F.size(T.months_of(F.col("t"))) > 0).alias("b")).collect()
    assert [r.t for r in rows if bool(r.a) != bool(r.b and r.t is not None)] == [] and sum(bool(r.a) for r in rows) == 7


def test_restrictions_behind_addresses_and_marks_are_found(spark):
    texts = ["PRhttps://x.example/a only", "Must have PR:status", "open only to Permanent:Residents", "see https://x.example/SWPP now", "U.S. citizens only", "PRO only, must have PROSE", "Student Work Placement Programme", "国。PR only", "nothing", None, ""]
    got = [r.r for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.restriction(F.array("t")).alias("r")).collect()]
    assert got == ["PR only", "Must have PR status", "open only to Permanent Residents", None, "US citizens only", None, "programme", "PR only", None, None, None]


def test_aliases_are_looked_for_once_and_places_kept(spark):
    p = inputs.profiles(spark, SF)
    got = R.mentions_in(p)
    plain = p.select("rid", R.laid_out(F.col("text")).alias("laid")).select("rid", F.inline_outer(K.mentions_of(F.col("laid")))).where("canonical is not null")
    assert got.exceptAll(plain).isEmpty() and got.count() == plain.count() > 0
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_a_models_technologies_come_without_the_rules(spark):
    p, answers = drafts.profiles(spark, SF)
    blocks = R.blocks_of(p)
    whole = D.assembled(p, blocks, answers, drafts.YEAR, drafts.MONTH)[1].where("by_model").select("rid", "block", F.explode("technologies").alias("name"))
    alone = D.modelled(p, blocks, answers).where("by_model").select("rid", "block", F.explode("technologies").alias("name"))
    assert alone.exceptAll(whole).isEmpty() and alone.count() == whole.count() > 0


def test_reuse_takes_rows_one_by_one():
    class Kept:
        value, timers = None, []
        getValueState = lambda self, *_: self
        get = lambda self: self.value
        update = lambda self, v: setattr(self, "value", v)
        registerTimer = lambda self, at: self.timers.append(at)
        deleteTimer = lambda self, at: self.timers.remove(at)

    kept, day = Kept(), REUSE_SECONDS * 1_000_000
    reuse = Reuse()
    reuse.init(kept)
    row = lambda seq, kind, came, read_at=None: Row(id="a", seq=seq, kind=kind, came=came, read_at=read_at, body=f"b{seq}")
    got = list(reuse.handleInputRows(("a",), iter([row(4, "listing", day + 4), row(2, "detail", 5, 5), row(3, "listing", day + 4), row(1, "listing", 1)]), None))
    assert [(r.seq, r.outcome, r.body) for r in got] == [(1, "to read", None), (3, "reused", "b2"), (4, "reused", "b2")]
    list(reuse.handleInputRows(("a",), iter([row(5, "detail", 5, 2_000_000), row(6, "detail", 5, None)]), None))
    assert tuple(kept.value) == (2_000_000, "b5") and kept.timers == [ends(2_000_000)]


def test_a_task_counts_the_items_of_so_many_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta beta delta"), (3, "nothing here"), (4, None), (5, "alpha"), (5, "beta delta"), (None, "gamma"), (6, "Gamma, alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha"), (7, "beta"), (8, "beta"), (8, "delta"), (9, "gamma"), (3, "epsilon")], "item_id long, term string")
    monkeypatch.setattr(R0, "DEALT", 1)
    got = R0.most_shared(docs, items)
    # one exchange, by document alone, before any term is counted
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and f", {docs.count()}), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 7, 2), (2, 8, 2), (5, 7, 2), (None, 9, 1), (6, 7, 1)], key=repr)


def test_a_streams_part_is_one_file_made_by_all_tasks(spark, tmp_path):
    task = F.udf(lambda _: TaskContext.get().partitionId(), "int")
    df = spark.range(0, 80, 1, 4).select("id", task("id").alias("task"))
    streams.replayed(df, "id", f"file://{tmp_path}", parts=2)
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 2
    got = spark.read.parquet(f"file://{tmp_path}/in")
    assert got.count() == 80 and got.select("task").distinct().count() == 4
