"""A keyed table of mergeable states that takes in batch after batch and is compacted in levels.

Each batch is one run: a folder with a folder a key bucket, sorted by key. When a level has FAN runs they are merged into one
of the next level, so the table of n batches has at most FAN - 1 runs a level and log(n) levels. A manifest names the
runs that are live; a new one is written whole and takes effect by a rename, so a reader sees one state or the other, and a
batch that is repeated after a failure is known by its number and left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of a level that are merged into one of the next; key buckets.
FAN, BUCKETS = 8, 8


class Files:
    """The few calls on Hadoop's file system that a manifest needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark._jvm
        path = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a file that nobody sees before it is whole; a name that is taken is an error."""
        part = self.path(f"{name}.part")
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.rename(part, self.path(name)):
            raise FileExistsError(name)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Manifests:
    """Numbered descriptions of a table in a folder; the highest number is what holds."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder, self.files = f"{folder}/manifests", Files(spark, folder)

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(self.folder) if n.endswith(".json"))

    def last(self) -> tuple[int, dict]:
        n = self.numbers()
        return (n[-1], json.loads(self.files.read(f"{self.folder}/{n[-1]:08d}.json"))) if n else (0, {})

    def at(self, number: int) -> dict:
        return json.loads(self.files.read(f"{self.folder}/{number:08d}.json"))

    def put(self, number: int, what: dict) -> None:
        self.files.put(f"{self.folder}/{number:08d}.json", json.dumps(what, sort_keys=True))

    def forget(self, before: int) -> None:
        for n in self.numbers():
            if n < before:
                self.files.delete(f"{self.folder}/{n:08d}.json")


class LevelledTable:
    """``keys`` and mergeable columns: ``how`` says of each which of ``max``, ``min`` and ``sum`` merges two states.

    One writer appends at a time; readers need no lock. A replaced run stays until the manifest after next, so that a reader
    who began before a merge can end.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], how: dict[str, str], schema: str, buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.folder, self.keys, self.how, self.schema = spark, folder, keys, how, schema
        self.buckets, self.fan, self.manifests = buckets, fan, Manifests(spark, folder)

    def bucket(self, key: Column | None = None) -> Column:
        """By the first key, so that all rows of one lie together."""
        return F.pmod(F.xxhash64(F.col(self.keys[0]) if key is None else key), F.lit(self.buckets)).cast("int")

    def merged(self, states: DataFrame) -> DataFrame:
        """One row a key: aggregates that combine before the shuffle, so a key with a third of all rows is no burden."""
        return states.groupBy(*self.keys).agg(*[getattr(F, how)(c).alias(c) for c, how in self.how.items()])

    def write(self, name: str, states: DataFrame) -> None:
        """A run: one file a bucket, sorted by key, with bloom filters for lookups."""
        rows = states.withColumn("bucket", self.bucket()).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", *self.keys)
        rows.write.mode("overwrite").partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{self.keys[0]}", "true").parquet(f"{self.folder}/runs/{name}")

    def rows(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        return reduce(DataFrame.unionByName, [self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder}/runs/{n}") for n in names])

    def append(self, batch: DataFrame, number: int, more: Callable[[dict], dict] | None = None) -> bool:
        """Take in the states of batch ``number``; False if that batch is in already.

        ``more`` is asked, once the batch is written, what else the manifest shall say, given what it said.
        """
        version, now = self.manifests.last()
        if number <= now.get("batch", -1):
            return False
        levels = [list(x) for x in now.get("levels", [])] or [[]]
        name = f"b{number:08d}"
        self.write(name, self.merged(batch))
        levels[0].append(name)
        gone = []
        for i in range(len(levels)):
            if len(levels[i]) >= self.fan:
                name = f"{levels[i][-1].split('-')[0]}-{i + 1}"
                self.write(name, self.merged(self.rows(levels[i])))
                if i + 1 == len(levels):
                    levels.append([])
                levels[i + 1].append(name)
                gone += levels[i]
                levels[i] = []
        self.switch(version, now | (more(now) if more else {}) | {"batch": number, "levels": levels, "gone": gone})
        return True

    def replace(self, rows: DataFrame, more: dict | None = None) -> None:
        """Make ``rows`` (states) the whole table. Until the last step the old table holds, and it holds for good if one before fails."""
        version, now = self.manifests.last()
        name = f"r{version + 1:08d}"
        self.write(name, self.merged(rows))
        old = [n for level in now.get("levels", []) for n in level]
        self.switch(version, now | (more or {}) | {"levels": [[], [name]], "gone": old})

    def switch(self, version: int, what: dict) -> None:
        self.manifests.put(version + 1, what)
        before = self.manifests.at(version) if version else {}
        for old in before.get("gone", []):
            self.manifests.files.delete(f"{self.folder}/runs/{old}")
        self.manifests.forget(version)

    def version(self) -> int:
        return self.manifests.last()[0]

    def runs(self, version: int | None = None) -> list[str]:
        what = self.manifests.last()[1] if version is None else self.manifests.at(version)
        return [n for level in what.get("levels", []) for n in level]

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is, or as the version said that a reader began with (the last one or the one before)."""
        return self.merged(self.rows(self.runs(version)))

    def lookup(self, key) -> DataFrame:
        """The rows of one first key: of each run one bucket is opened, and of that what statistics and bloom filter let through."""
        kind = self.spark.createDataFrame([], self.schema).schema[self.keys[0]].dataType
        at = self.spark.range(1).select(self.bucket(F.lit(key).cast(kind))).first()[0]
        return self.merged(self.rows(self.runs()).where((F.col("bucket") == at) & (F.col(self.keys[0]) == key)))
