"""Exclusion rules, deduplication, merging and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrank.functions.text import WORD, collapse

# States that close a posting.
CLOSED = ["closed", "expired", "cancelled", "canceled", "filled", "archived", "applications closed", "posting closed"]
# Layouts of deadlines, with a time and without.
TIMED = ["MMM d, yyyy h:mm a", "MMMM d, yyyy h:mm a", "MMM d, yyyy H:mm", "MMMM d, yyyy H:mm", "yyyy-MM-dd h:mm a", "yyyy/MM/dd H:mm", "MM/dd/yyyy h:mm a", "d MMM yyyy H:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss"]
DATED = ["MMM d, yyyy", "MMMM d, yyyy", "yyyy/MM/dd", "d MMM yyyy", "d-MMM-yyyy", "yyyy-MM-dd"]


def split_by_reason(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``df`` with ``reason``: the first rule that holds, empty for rows that stay."""
    reason = F.lit("")
    for name, holds in reversed(rules):
        reason = F.when(F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)


def offending_clause(text: Column, demand: str, waiver: str) -> Column:
    """The first clause that makes a demand and doesn't waive it; null if none does."""
    clauses = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?i)[\n;.!?。；]+|\bbut\b"), lambda c: collapse(F.replace(c, F.lit(":"), F.lit(" "))))
    return F.get(F.filter(clauses, lambda c: c.rlike(demand) & ~c.rlike(waiver)), F.lit(0))


def keep_richest(df: DataFrame, group: Column, richness: Column, key: str, closed: Column) -> DataFrame:
    """One row a group: the key of the richest row (the first on ties), the group's size and whether any row is closed.

    Two combinable aggregates instead of a window, so a hot group is never gathered.
    """
    best = F.max_by(F.col(key), F.struct(richness, -F.col(key)))
    return df.groupBy(group.alias("grp")).agg(best.alias("kept"), F.min(key).alias("first_seen"), F.count("*").alias("n"), F.max(closed.cast("int")).alias("closed"))


def upsert(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Latest non-blank value of each column by key; blanks never overwrite."""
    seq = F.struct(*order)
    return df.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), seq)).alias(c) for c in columns], F.min(order[0]).alias("first_seen"), F.max(order[0]).alias("last_seen"))


def is_fresh(stamp: Column, now: str, seconds: int = 86_400) -> Column:
    age = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(stamp)
    return (age >= 0) & (age < seconds)


def islands(df: DataFrame, group: str, order: str, starts: Column) -> DataFrame:
    """``df`` with ``block``: rows from one start to the next, numbered from 1 in each group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("block", F.greatest(F.lit(1), F.sum(F.when(starts, 1).otherwise(0)).over(w)).cast("long"))


def mention_pattern(phrase: str) -> str:
    return f"(?<!{WORD}){phrase}(?!{WORD})"


def latest_before(events: DataFrame, key: str, at: str, slot: Column, start: Column, value: str) -> DataFrame:
    """``events`` with ``latest``: the value of the latest row of its key at or before it for which ``start`` holds; null without one.

    ``slot`` grows with the time. The latest start of each slot is a combinable aggregate, carried from slot to slot over one row
    a slot; rows are ordered within their key and slot only, so a key with a third of all rows is dealt out by slot. Of starts
    at one time the greatest value counts; a row without key or time has no start and is none.
    """
    begins = F.coalesce(start, F.lit(False)) & F.col(key).isNotNull() & F.col(at).isNotNull()
    rows = events.withColumn("slot", slot).withColumn("mark", F.when(begins, F.struct(F.col(at).alias("at"), F.col(value).alias("value"))))
    slots = rows.groupBy(F.col(key).alias("s_key"), F.col("slot").alias("s_slot")).agg(F.max("mark").alias("own"))
    carried = F.last("own", ignorenulls=True).over(Window.partitionBy("s_key").orderBy("s_slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = slots.withColumn("carried", carried).where("carried is not null").select("s_key", "s_slot", "carried")
    near = rows.withColumn("near", F.max("mark").over(Window.partitionBy(key, "slot").orderBy(at)))
    joined = near.join(slots, (F.col(key) == F.col("s_key")) & (F.col("slot") == F.col("s_slot")), "left")
    return joined.select(*events.columns, F.coalesce("near", "carried")["value"].alias("latest"))
