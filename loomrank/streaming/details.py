"""Reading of details: up to three times each, with one sink for those that came out and one for those that never did."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.streaming.upsert import written

#: Fixed value: readings of a detail at most.
TRIES = 3
#: The longest that a field of a posting may be.
LONGEST = {"id": 200, "title": 1000, "company": 1000, "location": 1000, "description": 100_000, "requirements": 50_000, "deadline": 200, "url": 4000, "status": 200}
DETAIL = "struct<title: string, company: string, location: string, description: string, requirements: string, deadline: string, status: string>"


def wrong_fields(job: Column, fields: list[str]) -> Column:
    """Names of the fields of a posting that break its rules: none but the title must be there, each has a longest length."""
    bad = [F.when(F.length(F.coalesce(job[f], F.lit(""))) > LONGEST[f], F.lit(f)) for f in fields]
    return F.array_compact(F.array(*[F.when(F.coalesce(job["title"], F.lit("")) == "", F.lit("title")), *bad]))


def collected(targets: DataFrame, read: Callable[[DataFrame, int], DataFrame], tries: int = TRIES) -> DataFrame:
    """``targets(id, ...listing fields)`` with ``outcome, tries, issue, from_listing`` and the listing fields overlaid by the detail's.

    ``read(targets, attempt)`` adds ``payload``, the detail as JSON; null where it didn't load. A detail that doesn't load,
    isn't JSON or breaks a rule is read again, ``tries`` times in all; what is left then is ``dead`` with the last issue, and stops
    none of the others. If at the last reading the location alone is wrong, the listing's stands in for it. Each attempt is
    one pass over what is left and is written before it is judged, so a reader with side effects is asked once a row and attempt.
    """
    fields = [c for c in targets.columns if c in LONGEST and c not in ("id", "url")]
    left, parts = targets, []
    for attempt in range(1, tries + 1):
        got = written(read(left, attempt).select(*[F.col(c) for c in targets.columns], "payload"))
        detail = F.from_json("payload", DETAIL, {"mode": "PERMISSIVE"})
        # a text that isn't JSON gives a struct of nulls: told apart by what try_parse_json says
        parsed = got.withColumn("json", F.try_parse_json("payload").isNotNull()).withColumn("d", detail)
        over = {c: F.coalesce(F.nullif(F.col(f"d.{c}"), F.lit("")), F.col(c)) for c in fields}
        merged = parsed.withColumn("job", F.struct(*[v.alias(c) for c, v in over.items()])).withColumn("bad", wrong_fields(F.col("job"), fields))
        rescued = (F.lit(attempt) == tries) & (F.col("bad") == F.array(F.lit("location"))) & (F.coalesce("location", F.lit("")) != "") if "location" in fields else F.lit(False)
        issue = F.when(F.col("payload").isNull(), "not loaded").when(~F.col("json"), "not JSON").when(F.size("bad") > 0, F.concat(F.lit("wrong: "), F.array_join("bad", ", "))).otherwise("")
        merged = merged.withColumn("issue", issue).withColumn("from_listing", F.coalesce(rescued, F.lit(False)) & F.col("json"))
        good = (F.col("issue") == "") | F.col("from_listing")
        value = lambda c: F.when(F.col("from_listing") & F.lit(c == "location"), F.col(c)).otherwise(F.col(f"job.{c}"))
        told = [F.lit(attempt).alias("tries"), "issue", "from_listing"]
        parts.append(merged.where(good).select(*[value(c).alias(c) if c in fields else F.col(c) for c in targets.columns], F.lit("complete").alias("outcome"), *told))
        left = merged.where(~good)
        if attempt == tries:
            parts.append(left.select(*targets.columns, F.lit("dead").alias("outcome"), *told))
        left = left.select(*targets.columns)
    return reduce(DataFrame.unionByName, parts)


def run_details(targets: DataFrame, read: Callable[[DataFrame, int], DataFrame], folder: str) -> None:
    """Collect a stream of ``targets``: outcomes go to ``folder``/complete and ``folder``/dead, by batch, so a repeated batch overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        out = written(collected(written(batch), read))
        for outcome in ("complete", "dead"):
            out.where(F.col("outcome") == outcome).drop("outcome").write.mode("overwrite").parquet(f"{folder}/{outcome}/batch={number}")

    targets.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def read_details(spark: SparkSession, folder: str) -> DataFrame:
    """Both sinks as one table with ``outcome``."""
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/{o}").drop("batch").withColumn("outcome", F.lit(o)) for o in ("complete", "dead")])
