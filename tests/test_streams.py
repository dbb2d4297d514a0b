"""Streams: what a restart, a repeated batch, a failed replacement and a bad row may not change."""

import pytest
from pyspark.sql import functions as F

from loomrank.functions import text as T
from loomrank.operators import board as B
from loomrank.streaming import crawl as K
from loomrank.streaming import details as D
from loomrank.streaming import reuse as R
from loomrank.streaming.levels import LevelledTable

READING = "id string, seq long, at string, kind string, status string, stamp string, body string"


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize(
    ("text", "moment"),
    [("2026-03-09T09:15:00Z", "2026-03-09 09:15:00"), ("2026-03-09 09:15+02:00", "2026-03-09 07:15:00"), ("20260309T0915-0530", "2026-03-09 14:45:00"), ("2026-03-09T09:15:00.5+00:00", "2026-03-09 09:15:00.5"), ("2026-03-09T09Z", "2026-03-09 09:00:00"), ("2026-03-09T09:15:00", None), ("2026-03-09", None), ("2026-13-09T09:15:00Z", None), ("soon", None), ("", None)],
)
def test_moments(spark, text, moment):
    got = spark.createDataFrame([(text,)], "t string").select(T.iso_instant(F.col("t")).cast("string")).first()[0]
    assert got == moment


def test_reuse_over_a_restart(spark, tmp_path):
    def put(*rows):
        spark.createDataFrame(list(rows), READING).withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        schema = spark.createDataFrame([], READING).withColumn("at", F.to_timestamp("at")).schema
        R.run_reuse(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"file://{tmp_path}")

    listing = lambda i, n, at: (i, n, at, "listing", None, None, None)
    detail = lambda i, n, at, stamp, status="complete": (i, n, at, "detail", status, stamp, f"b{n}")
    put(listing("a", 1, "2026-01-01 00:00:00"), detail("a", 2, "2026-01-01 00:00:10", "2026-01-01T00:00:10Z"), detail("naive", 3, "2026-01-01 00:00:10", "2026-01-01T00:00:10"), detail("future", 4, "2026-01-01 00:00:10", "2026-01-01T00:00:11Z"), detail("failed", 5, "2026-01-01 00:00:10", "2026-01-01T00:00:10Z", "failed"))
    run()
    # out of order within one batch, and at the very end of the day
    put(listing("a", 8, "2026-01-02 00:00:10"), listing("a", 7, "2026-01-02 00:00:09"), *[listing(i, 9, "2026-01-02 00:00:09") for i in ("naive", "future", "failed", "new")])
    run()
    # a reused detail is no younger for it; a new one with an early stamp counts from that
    put(detail("a", 10, "2026-01-02 12:00:00", "2026-01-01T13:00:00Z"), listing("a", 11, "2026-01-02 12:59:59"), listing("a", 12, "2026-01-02 13:00:00"))
    run()
    run()
    got = {(r.id, r.seq): (r.outcome, r.body) for r in R.read_outcomes(spark, f"file://{tmp_path}").collect()}
    assert got.pop(("a", 7)) == ("reused", "b2") and got.pop(("a", 11)) == ("reused", "b10")
    assert set(got) == {("a", 1), ("a", 8), ("a", 12), *[(i, 9) for i in ("naive", "future", "failed", "new")]} and set(got.values()) == {("to read", None)}


def test_a_hundred_batches(spark, tmp_path):
    """Files that a read opens stay bounded, and the table equals the merge of all rows at once."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        hundred_batches(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def hundred_batches(spark, tmp_path):
    table = K.board_table(spark, f"file://{tmp_path}", buckets=2, fan=5)
    every = []
    for n in range(100):
        rows = [(f"J{(n * 7 + i) % 23}", n * 10 + i, *(f"{c}{n}" if (n + i + j) % 3 else "" for j, c in enumerate(B.FIELDS)), None if i else n % 2 == 0, {"k": f"v{n}" if n % 4 else "", "detail_status": "complete" if (n + i) % 9 == 0 else "failed", **({"detail_collected_at": f"t{n}"} if n % 5 == 0 else {})}) for i in range(3)]
        every += rows
        df = spark.createDataFrame(rows, f"id string, seq long, {', '.join(f'{c} string' for c in B.FIELDS)}, is_open boolean, metadata map<string,string>")
        assert table.append(K.board_states(df.coalesce(1)), n)
        assert not n or not table.append(K.board_states(df), n - 1)  # a repeated batch changes nothing
    assert len(table.runs()) <= 4 * 3 and len(table.rows(table.runs()).inputFiles()) <= 2 * 4 * 3
    assert len(list((tmp_path / "runs").iterdir())) <= 4 * 3 + 15 and len(table.manifests.numbers()) <= 2
    whole = spark.createDataFrame(every, df.schema)
    cols = ["id", *B.FIELDS, "is_open", F.col("metadata")["k"].alias("k"), "detail_status", "detail_collected_at", "first_seen", "last_seen"]
    key = lambda df: sorted(map(repr, df.select(*cols).collect()))
    assert key(K.read_board(table)) == key(B.merge_board(whole))
    one = table.lookup("J5")
    assert key(K.board_of(one)) == key(B.merge_board(whole.where("id = 'J5'")))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "(bucket" in plan and "EqualTo(id,J5)" in plan


def test_replacement(spark, tmp_path):
    table = LevelledTable(spark, f"file://{tmp_path}", ["id"], {"v": "max"}, "id string, v long")
    frame = lambda *rows: spark.createDataFrame(list(rows), "id string, v long")
    table.append(frame(("a", 1), ("b", 2), (None, 3)), 0)
    began = table.version()
    bad = frame(("c", 9)).withColumn("v", F.when(F.col("id") == "c", F.raise_error(F.lit("broken")).cast("long")))
    with pytest.raises(Exception, match="broken"):
        table.replace(bad)
    assert rows_of(table.read().where("id is not null"), "id", "v") == [("a", 1), ("b", 2)] and table.read().count() == 3
    table.replace(frame(("c", 9), ("c", 4)))
    assert rows_of(table.read(), "id", "v") == [("c", 9)]
    assert table.read(began).count() == 3  # who began before the switch still reads what was
    assert table.append(frame(("c", 10)), 1) and rows_of(table.read(), "id", "v") == [("c", 10)]
    table.append(frame(), 2)
    assert rows_of(table.read(), "id", "v") == [("c", 10)]


def test_details_are_tried_three_times(spark):
    asked = []
    targets = spark.createDataFrame([("ok", "t", "x"), ("late", "t", "x"), ("never", "t", "x"), ("long", "t", "x"), ("long, no place", "t", ""), ("cut", "t", None), ("untitled", "", "x")], "id string, title string, location string")

    def read(df, attempt):
        asked.append(sorted(r.id for r in df.select("id").collect()))
        far = '{"location": "' + "far " * 300 + '", "title": "new"}'
        p = F.when(F.col("id") == "ok", '{"title": "new"}').when(F.col("id") == "late", F.lit('{"title": "new"}') if attempt == 2 else F.lit(None)).when(F.col("id").startswith("long"), far).when(F.col("id") == "cut", '{"title": ').when(F.col("id") == "untitled", '{"location": "y"}')
        return df.withColumn("payload", p)

    got = {r.id: (r.outcome, r.tries, r.issue, r.title, r.location, r.from_listing) for r in D.collected(targets, read).collect()}
    assert got["ok"] == ("complete", 1, "", "new", "x", False) and got["late"] == ("complete", 2, "", "new", "x", False)
    assert got["long"] == ("complete", 3, "wrong: location", "new", "x", True) and got["long, no place"][:3] == ("dead", 3, "wrong: location")
    assert got["never"][:3] == ("dead", 3, "not loaded") and got["cut"][:3] == ("dead", 3, "not JSON") and got["untitled"][:3] == ("dead", 3, "wrong: title")
    assert len(got) == 7 and len(asked) == 3 and asked[1] == sorted(set(got) - {"ok"}) and "late" not in asked[2]
    assert D.collected(targets.limit(0), read).count() == 0


def test_a_crawl_retires_only_with_proof(spark, tmp_path):
    schema = f"page long, id string, seq long, {', '.join(f'{c} string' for c in B.FIELDS)}, is_open boolean, metadata map<string,string>, reused boolean, expected long, last boolean, warning string"
    table = K.board_table(spark, f"file://{tmp_path}/board")

    def crawl(n, ids, expected, last=True, warning="", status="complete"):
        rows = [(0, i, n * 100 + j, *[f"{c}{n}" for c in B.FIELDS], True, {"detail_status": status}, False, None, False, "") for j, i in enumerate(ids)]
        rows.append((0, None, n * 100 + 99, *[""] * len(B.FIELDS), None, None, False, expected, last, warning))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
        told = K.run_crawl(spark.readStream.schema(schema).parquet(f"{tmp_path}/in{n}"), table, n, f"file://{tmp_path}/checkpoint{n}")
        return told, {r.id for r in K.read_board(table).where("on_board").collect()}

    assert crawl(1, "abc", 3)[1] == set("abc")
    assert crawl(2, "ab", 3)[1] == set("abc")  # one is missing
    assert crawl(3, "ab", 2, warning="?")[1] == set("abc")
    assert crawl(4, "ab", 2, last=False)[1] == set("abc")
    assert crawl(5, "abd", 3, status="pending")[1] == set("abc") | {"d"}
    told, left = crawl(6, "aab", 2)  # one stands on two pages
    assert left == set("ab") and told["jobs"] == told["complete"] == 2 and told["pages"] == 1
    assert K.read_board(table).count() == 4
