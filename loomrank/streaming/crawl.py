"""A crawl of the board as a stream of pages: each posting once, details reused or read, the board merged batch by batch, and
what the crawl didn't see retired in the batch that proves it complete."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomrank.operators.board import FIELDS
from loomrank.streaming.levels import LevelledTable

VALUE = "struct<seq: long, v: string>"
TEXTS = [*FIELDS, "stamp"]
SCHEMA = f"id string, k string, {', '.join(f'{c} {VALUE}' for c in TEXTS)}, is_open struct<seq: long, v: boolean>, first_status {VALUE}, complete_at {VALUE}, v {VALUE}, first_seen long, last_seen long, complete int, crawl long"
HOW = {c: "max" for c in [*TEXTS, "is_open", "v", "last_seen", "complete", "crawl"]} | {c: "min" for c in ["first_status", "complete_at", "first_seen"]}
#: Keys of the metadata that say how a detail stands.
STATE_KEYS = ["detail_status", "detail_collected_at"]


def board_table(spark: SparkSession, folder: str, buckets: int = 8, fan: int = 8) -> LevelledTable:
    """The board as mergeable states: a row an id, and one an id and key of its metadata (``k`` is empty in the former)."""
    return LevelledTable(spark, folder, ["id", "k"], HOW, SCHEMA, buckets, fan)


def board_states(rows: DataFrame, crawl: Column | None = None) -> DataFrame:
    """``rows(id, seq, FIELDS, is_open, metadata)`` as states, one or more rows each; merging them is all that an upsert does."""
    seen = lambda v, given: F.when(given, F.struct(F.col("seq").cast("long").alias("seq"), v.alias("v")))
    status, stamp = (F.element_at("metadata", F.lit(k)) for k in STATE_KEYS)
    cols = {c: seen(F.col(c).cast("string"), F.coalesce(F.col(c), F.lit("")) != "") for c in FIELDS}
    cols |= {"stamp": seen(stamp, stamp.isNotNull()), "is_open": seen(F.col("is_open"), F.col("is_open").isNotNull()), "first_status": seen(F.coalesce(status, F.lit("pending")), F.lit(True))}
    cols |= {"complete_at": seen(stamp, (status == "complete") & stamp.isNotNull()), "first_seen": F.col("seq"), "last_seen": F.col("seq"), "complete": (status == "complete").cast("int"), "crawl": F.lit(None) if crawl is None else crawl}
    kinds = {f.name: f.dataType for f in rows.sparkSession.createDataFrame([], SCHEMA).schema.fields}
    own = rows.select("id", F.lit("").alias("k"), *[cols[c].cast(t).alias(c) if c in cols else F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in ("id", "k")])
    pairs = rows.select("id", "seq", F.explode("metadata").alias("k", "text")).where((F.col("text") != "") & ~F.col("k").isin(STATE_KEYS) & (F.col("k") != ""))
    of_key = pairs.select("id", "k", *[(F.struct(F.col("seq").cast("long").alias("seq"), F.col("text").alias("v")) if c == "v" else F.lit(None)).cast(t).alias(c) for c, t in kinds.items() if c not in ("id", "k")])
    return own.unionByName(of_key)


def board_of(states: DataFrame, complete: int = 0) -> DataFrame:
    """Postings out of merged states; ``on_board`` is false where the last complete crawl ``complete`` and all after it didn't see the id."""
    own = states.where("k = ''")
    values = states.where("k <> ''").groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.col("v.v").alias("v"))))).alias("metadata"))
    text = [F.coalesce(F.col(f"{c}.v"), F.lit("")).alias(c) for c in FIELDS]
    state = F.when(F.col("complete") == 1, "complete").otherwise(F.col("first_status.v")).alias("detail_status")
    own = own.select("id", *text, F.col("is_open.v").alias("is_open"), state, F.coalesce("complete_at.v", "stamp.v").alias("detail_collected_at"), "first_seen", "last_seen", (F.coalesce("crawl", F.lit(0)) >= complete).alias("on_board"))
    return own.join(values, "id", "left")


def run_merge(rows: DataFrame, table: LevelledTable, checkpoint: str) -> None:
    """Merge a stream of readings into the board; each batch is one run of the table."""

    def put(batch: DataFrame, number: int) -> None:
        with taken(batch, table, number) as rows:
            table.append(board_states(rows), number)

    rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@contextmanager
def taken(batch: DataFrame, table: LevelledTable, number: int) -> Iterator[DataFrame]:
    """A batch written once, for what follows looks at it more than once and a stream's own state must not be worked out twice."""
    path = f"{table.folder}/taken/{number}"
    batch.write.mode("overwrite").parquet(path)
    yield batch.sparkSession.read.schema(batch.schema).parquet(path)
    table.manifests.files.delete(path)


def run_crawl(pages: DataFrame, table: LevelledTable, crawl: int, checkpoint: str) -> dict:
    """Take in crawl number ``crawl`` (from 1) and return its counters.

    ``pages(page, id, seq, FIELDS, is_open, metadata, reused, expected, last, warning)`` is a stream with a row a posting;
    a row without an id tells of a page alone (how many postings the board says it has, whether no page follows, what went
    wrong). A posting that stands on several pages counts once. Counters are observed while a batch is written, in the same pass;
    they and the batch take effect together, by the table's manifest. The crawl is complete once a last page came,
    all that the board said were seen, each has its detail and nothing was wrong; the batch that shows it retires the rest of
    the board. A crawl that ends otherwise retires nothing.
    """
    once = pages.withColumn("key", F.coalesce("id", F.concat(F.lit("\n"), F.col("page").cast("string")))).dropDuplicates(["key"])
    status = F.coalesce(F.element_at("metadata", F.lit("detail_status")), F.lit("pending"))
    posting = F.col("id").isNotNull()
    counted = {"jobs": F.count_if(posting), "complete": F.count_if(posting & (status == "complete")), "failed": F.count_if(posting & (status == "failed")), "skipped": F.count_if(posting & (status == "skipped")), "reused": F.count_if(posting & F.col("reused")), "pages": F.count_if(~posting), "warnings": F.count_if(F.col("warning") != "")}
    ranges = {"ends": F.max(F.col("last").cast("int")), "least": F.min("expected"), "most": F.max("expected")}

    def put(batch: DataFrame, number: int) -> None:
        seen = Observation(f"crawl-{crawl}-{number}")
        watched = batch.observe(seen, *[v.alias(k) for k, v in (counted | ranges).items()])

        def tell(before: dict) -> dict:
            got = seen.get
            old = before.get("counters", {}) if before.get("crawl") == crawl else {}
            now = {k: old.get(k, 0) + (got.get(k) or 0) for k in counted}
            now["ends"] = max(old.get("ends", 0), got.get("ends") or 0)
            bounds = [x for x in (old.get("least"), old.get("most"), got.get("least"), got.get("most")) if x is not None]
            now |= {"least": min(bounds, default=None), "most": max(bounds, default=None)}
            # a number that changed in between is no proof of anything
            proof = now["ends"] and now["least"] == now["most"] == now["jobs"] == now["complete"] and not now["warnings"]
            return {"crawl": crawl, "counters": now} | ({"retired_by": crawl} if proof else {})

        with taken(watched, table, number) as rows:
            table.append(board_states(rows.where(posting), F.lit(crawl).cast("long")), batches_before + number, tell)

    # batch numbers of a checkpoint begin at 0: those of earlier crawls lie before them
    _, now = table.manifests.last()
    batches_before = now.get("base", 0) if now.get("crawl") == crawl else now.get("batch", -1) + 1
    if now.get("crawl") != crawl:
        table.switch(table.version(), now | {"crawl": crawl, "base": batches_before, "counters": {}, "gone": [], "levels": now.get("levels", [[]])})
    once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table.manifests.last()[1].get("counters", {})


def read_board(table: LevelledTable) -> DataFrame:
    return board_of(table.read(), table.manifests.last()[1].get("retired_by", 0))
