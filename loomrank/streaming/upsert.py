"""Incremental ingestion: a stream of records merged batch by batch into a table of the latest non-blank values."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "loomrank-stream")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` from the shared folder: what was read once is not read again, whatever becomes of an executor."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest_parts(df: DataFrame, key: str, seq: list[str], columns: list[str]) -> DataFrame:
    """Mergeable state by key: for each column the latest non-blank value with its sequence."""
    s = F.struct(*seq)
    return df.groupBy(key).agg(*[F.max(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct(s.alias("s"), F.col(c).alias("v")))).alias(c) for c in columns], F.min(seq[0]).alias("first_seen"), F.max(seq[0]).alias("last_seen"))


def merged(states: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return states.groupBy(key).agg(*[F.max(c).alias(c) for c in columns], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def run_upsert(rows: DataFrame, key: str, seq: list[str], columns: list[str], folder: str) -> None:
    """Run the stream over all that is there; each batch appends its states, keyed by batch, so a repeated batch overwrites itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        latest_parts(batch, key, seq, columns).write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")

    rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def read_upsert(spark: SparkSession, key: str, columns: list[str], folder: str) -> DataFrame:
    states = merged(spark.read.parquet(f"{folder}/state").drop("batch"), key, columns)
    return states.select(key, *[F.col(f"{c}.v").alias(c) for c in columns], "first_seen", "last_seen")


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder = shared_folder(spark)
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 4).parquet(sf_dir)
    rows = events.select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("status"), F.when(F.col("event_id") % 3 != 0, F.round("value", 6)).alias("latency"))
    run_upsert(rows, "user_id", ["ts", "event_id"], ["status", "latency"], folder)
    return read_upsert(spark, "user_id", ["status", "latency"], folder)


def run_distinct(rows: DataFrame, key: str, folder: str) -> None:
    """Append each key of a stream once, however often and in whichever batch it comes."""
    rows.dropDuplicates([key]).writeStream.format("parquet").option("path", f"{folder}/seen").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the event stream, each once."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    folder = shared_folder(spark)
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    run_distinct(events.select("user_id"), "user_id", folder)
    return spark.read.schema("user_id long").parquet(f"{folder}/seen")


class Progress(StreamingQueryListener):
    """State and counts of running queries, for who polls them."""

    def __init__(self):
        self.states: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.states[str(event.id)] = {"state": "running", "rows": 0, "batches": 0}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        s = self.states.setdefault(str(p.id), {"state": "running", "rows": 0, "batches": 0})
        s["rows"] += p.numInputRows
        s["batches"] += 1

    def onQueryIdle(self, event) -> None:
        self.states.setdefault(str(event.id), {"rows": 0, "batches": 0})["state"] = "idle"

    def onQueryTerminated(self, event) -> None:
        self.states.setdefault(str(event.id), {"rows": 0, "batches": 0})["state"] = "failed" if event.exception else "completed"
