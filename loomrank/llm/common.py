"""Helpers shared by the training-data operators: written intermediate tables, bounded Arrow batches, components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch and its bytes at most (a longer row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; a temporary folder only in local mode without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "loomrank-shared")
    return f"{base.rstrip('/')}/loomrank-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a recomputation-free cut that outlives lost executors.

    The returned frame carries its folder in ``loomrank_path`` so that a caller can delete it once it is spent.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.loomrank_path = path
    return out


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, behind as many underscores as none of the frame's columns has."""
    taken, mark = {c.lower() for c in df.columns}, "__"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def release(spark: SparkSession) -> None:
    """Let go of what finished jobs left: Spark deletes shuffle files once the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches.

    The bounds are settings of the session, for they hold when the frame is run; they are only ever lowered.
    """
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != f"{BATCH_BYTES}b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def held_out(doc_id):
    """True for documents that no label may be learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def is_held_out(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs, null-free): rows ``(node, root)``, root the least node reachable.

    Alternating large-star and small-star rounds. Every round is two grouped minima, combined before the
    shuffle, and two equi-joins against one row a node, so a node with a third of all links is a splittable
    skewed join side and never one group in memory. Each round is written to the shared folder, so lineage
    stays one round long. No edges give no rows.
    """
    spark = edges.sparkSession
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        then = materialise(small.where("u <> v").distinct())
        delete_path(spark, now.loomrank_path)
        now = then
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
