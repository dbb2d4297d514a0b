"""The board of postings: merges, retiring, memo tables, and what a crawl leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions import postings as P

FIELDS = ["title", "company", "location", "description", "requirements", "deadline", "url", "status"]


def merge_board(rows: DataFrame) -> DataFrame:
    """Upsert of ``rows(id, seq, FIELDS, is_open, metadata)`` in the order of ``seq``; one row an id.

    A blank never overwrites; ``is_open`` keeps its last known value; metadata merges key by key, blanks aside. A detail
    that was once complete stays so, with the stamp of that reading; of other states the first one seen holds. First and last sight are kept. All are combinable aggregates, so a busy id is no window.
    """
    latest = lambda c, given: F.max_by(c, F.when(given, F.col("seq")))
    status, stamp = F.element_at("metadata", F.lit("detail_status")), F.element_at("metadata", F.lit("detail_collected_at"))
    aggs = [F.coalesce(latest(F.col(c), F.coalesce(F.col(c), F.lit("")) != ""), F.lit("")).alias(c) for c in FIELDS]
    aggs += [latest(F.col("is_open"), F.col("is_open").isNotNull()).alias("is_open"), F.min("seq").alias("first_seen"), F.max("seq").alias("last_seen")]
    aggs += [F.max((status == "complete").cast("int")).alias("complete"), F.min_by(F.coalesce(status, F.lit("pending")), "seq").alias("first_status"), F.min_by(stamp, F.when((status == "complete") & stamp.isNotNull(), F.col("seq"))).alias("complete_at"), latest(stamp, stamp.isNotNull()).alias("stamp")]
    one = rows.groupBy("id").agg(*aggs)
    # key by key: the last value that isn't blank
    pairs = rows.select("id", "seq", F.explode("metadata").alias("k", "v")).where("v is not null and v <> '' and k not in ('detail_status', 'detail_collected_at')")
    values = pairs.groupBy("id", "k").agg(F.max_by("v", "seq").alias("v")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))
    state = F.when(F.col("complete") == 1, "complete").otherwise(F.col("first_status"))
    return one.join(values, "id", "left").select("id", *FIELDS, "is_open", "metadata", state.alias("detail_status"), F.coalesce("complete_at", "stamp").alias("detail_collected_at"), "first_seen", "last_seen")


def overlaid(detail: DataFrame, listing: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Listing rows over the details read before: what the listing leaves blank keeps the detail's value."""
    old = detail.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    return listing.join(old, F.col(key) == F.col("__k"), "left").select(key, *[F.coalesce(P.blank_as_null(F.col(c)), F.col(f"__{c}"), F.lit("")).alias(c) for c in columns])


def failed_details(board: DataFrame, failures: DataFrame) -> DataFrame:
    """``board(id, detail_status, metadata)`` with the reasons of ``failures(id, error)``, other rows as they were."""
    df = board.join(failures, "id", "left")
    marked = P.merged_metadata(F.col("metadata"), F.create_map(F.lit("detail_status"), F.lit("failed"), F.lit("detail_error"), F.col("error")))
    return df.select("id", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("detail_status")).alias("detail_status"), F.when(F.col("error").isNotNull(), marked).otherwise(F.col("metadata")).alias("metadata"))


def with_memo(rows: DataFrame, memo: DataFrame, valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows(key, ...)`` parted by a table of earlier answers ``memo(key, value)``: hits with their value, and misses.

    Answers are checked again on every reading: where ``valid`` doesn't hold a hit counts as a miss.
    """
    both = rows.join(memo, "key", "left")
    good = F.col("value").isNotNull() & (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False)))
    return both.where(good), both.where(~good).drop("value")


def remembered(memo: DataFrame, fresh: DataFrame) -> DataFrame:
    """``memo`` with newer answers in place of older ones of the same key."""
    return memo.join(fresh, "key", "left_anti").unionByName(fresh)


def repeated_pages(pages: DataFrame) -> DataFrame:
    """``print, n, first_page`` of pages that list the same ids in the same order as another: the crawl goes in circles."""
    ids = pages.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("rows"))
    prints = ids.select("page", F.sha2(F.array_join(F.transform("rows", lambda r: r["id"]), ","), 256).alias("print"))
    return prints.groupBy("print").agg(F.count("*").alias("n"), F.min("page").alias("first_page")).where("n > 1")


def is_complete(pages: DataFrame, details: DataFrame, expected: int) -> bool:
    """Whether a crawl may retire what it didn't see: the list has all rows, every detail is complete, nothing warned."""
    seen = pages.select("id").distinct().count()
    done, all_, warned = details.agg(F.count_if(F.col("detail_status") == "complete"), F.count("*"), F.count_if(F.col("warning") != "")).first()
    return seen >= expected and done == all_ and warned == 0


def retired(board: DataFrame, seen: DataFrame, complete: bool) -> DataFrame:
    """``board`` with ``on_board`` false where a complete crawl didn't see the id; an incomplete one retires nothing."""
    if not complete:
        return board
    keep = seen.select("id").distinct().withColumn("__seen", F.lit(True))
    return board.join(keep, "id", "left").withColumn("on_board", F.col("on_board") & F.col("__seen").isNotNull()).drop("__seen")


def throttled(events: DataFrame, base: float, least: float = 1.0, most: float = 8.0) -> DataFrame:
    """``events(source, ord, outcome)`` with the ``interval`` in force after each: doubled when refused, half as much again when
    slow, a tenth less when well, within its bounds. A fold over each source's events in order.

    One source's events are gathered, so each is a bounded stretch of a crawl (a session), not a source's whole history.
    """
    rows = events.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ord", "outcome"))).alias("rows"))
    factor = lambda o: F.when(o == "refused", 2.0).when(o == "slow", 1.5).otherwise(0.9)
    step = lambda a, r: F.concat(a, F.array(F.round(F.greatest(F.lit(least), F.least(F.lit(most), F.element_at(a, -1) * factor(r["outcome"]))), 6)))
    folded = F.aggregate("rows", F.array(F.lit(base)), step)
    return rows.select("source", F.inline(F.zip_with("rows", F.slice(folded, 2, F.size("rows")), lambda r, i: F.struct(r["ord"].alias("ord"), r["outcome"].alias("outcome"), i.alias("interval")))))


