"""What a posting is compared by and what a model is shown: requirement chunks, the rerank query, evidence under a budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrank.functions import text as T

#: Weights of requirements and of a title, chunks of a posting, characters of a piece, of a profile that stands
#: for its pieces, of the rerank query.
WEIGHTS = {"must": 2.0, "preferred": 1.0}
TITLE_WEIGHT, CHUNKS, PIECE, WHOLE, QUERY = 2.0, 60, 4000, 12_000, 1200


def posting_chunks(requirements: Column) -> Column:
    """``array<struct<chunk, weight>>`` of a posting: its remembered ``requirements`` (``array<struct<text, importance>>``) if
    there are any, else its title and the sentences of its body."""

    def asked(r: Column) -> Column:
        w = F.lit(1.0)
        for name, v in WEIGHTS.items():
            w = F.when(r["importance"] == name, F.lit(v)).otherwise(w)
        return F.struct(T.collapse(r["text"]).alias("chunk"), w.alias("weight"))

    known = F.filter(F.transform(requirements, asked), lambda c: c["chunk"] != "")
    title = T.collapse(F.col("title"))
    head = F.when(title != "", F.array(F.struct(title.alias("chunk"), F.lit(TITLE_WEIGHT).alias("weight")))).otherwise(F.array().cast("array<struct<chunk: string, weight: double>>"))
    body = F.concat_ws("\n", F.coalesce("description", F.lit("")), F.coalesce("requirements", F.lit("")))
    pieces = F.transform(T.sentences(body), lambda s: F.struct(T.collapse(s).alias("chunk"), F.lit(1.0).alias("weight")))
    return F.slice(F.when(F.size(requirements) > 0, known).otherwise(F.concat(head, pieces)), 1, CHUNKS)


def chunk_rows(postings: DataFrame, key: str, remembered: DataFrame) -> DataFrame:
    """``key, ord, chunk, weight`` of ``postings`` with ``remembered(key, asked)``; each row takes its own source of chunks."""
    memo = remembered.select(F.col(key).alias("__k"), "asked")
    both = postings.join(memo, F.col(key) == F.col("__k"), "left")
    chunks = both.select(key, F.posexplode(posting_chunks(F.col("asked"))).alias("ord", "c"))
    return chunks.select(key, F.col("ord").cast("long").alias("ord"), "c.chunk", "c.weight")


def recency_or(df: DataFrame, recency: str, fallback: str) -> DataFrame:
    """``df`` with ``recency`` from ``fallback`` in every row if no row has one, and as it is if any has: a missing value
    among others means that nothing fits, not that nothing was asked."""
    some = df.agg((F.count(recency) > 0).alias("__some"))
    return df.join(F.broadcast(some)).withColumn(recency, F.when(F.col("__some"), F.col(recency)).otherwise(F.col(fallback))).drop("__some")


def as_text() -> Column:
    """An experience as one text: its parts that aren't blank, one a line."""
    parts = F.concat(F.array("title", "organization", "summary"), F.coalesce("highlights", F.array().cast("array<string>")), F.array(F.array_join("technologies", ", ")))
    return F.array_join(F.filter(parts, lambda p: F.trim(p) != ""), "\n")


def rerank_queries(profiles: DataFrame, experiences: DataFrame, most: int = QUERY) -> DataFrame:
    """``rid, query``: headline and experiences in order within ``most`` characters; the whole text's beginning where both are blank.

    ``profiles(rid, headline, text)``, ``experiences(rid, place, title, organization, summary, highlights, technologies)``.
    Only what can still fall within the budget is gathered: pieces whose predecessors fill it are left where they are, and of a
    profile's text no more travels than the beginning that may be asked for, and that only where the headline is blank.
    """
    text = F.when(F.coalesce(F.trim("headline") == "", F.lit(True)), F.substring("text", 1, most))
    profiles = profiles.select("rid", "headline", text.alias("text"))
    pieces = experiences.select("rid", "place", as_text().alias("piece")).where(F.trim("piece") != "")
    before = Window.partitionBy("rid").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    fits = pieces.withColumn("used", F.coalesce(F.sum(F.length("piece") + 1).over(before), F.lit(0))).where(F.col("used") <= most)  # at the limit itself the blank before it still counts
    joined = fits.groupBy("rid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.substring("piece", 1, most).alias("piece")))), lambda p: p["piece"]), " ").alias("body"))
    both = profiles.join(joined, "rid", "left")
    query = F.concat_ws(" ", F.when(F.trim("headline") != "", F.col("headline")), F.col("body"))
    return both.select("rid", F.substring(F.when(query != "", query).otherwise(F.coalesce("text", F.lit(""))), 1, most).alias("query"))


def evidence_payloads(profiles: DataFrame, experiences: DataFrame, text: Column | None = None, piece_text: Callable[[Column], Column] | None = None) -> DataFrame:
    """``rid, payload``: a profile as JSON with verbatim evidence, and nothing else to quote from.

    ``experiences(rid, place, ref, kind, title, organization, months, months_ago, technologies, text)`` in order of place, each
    with at most PIECE characters of its block's text; a profile without any gives the first WHOLE characters of its own text as
    the one piece, so that there is always something to quote. ``profiles(rid, headline, text, total_months, work_months)``.

    Where texts can be looked up or made from a few columns, these may travel in their stead: ``text`` is then the text of a
    profile by its own columns, ``piece_text`` that of a piece by its column ``text``, which may be of any type. Both are asked
    for once all is gathered, so what is shuffled and sorted doesn't grow with the texts.
    """
    fields = ["ref", "kind", "title", "organization", "months", "months_ago", "technologies"]
    text = F.col("text") if text is None else text
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, PIECE)
    piece = F.struct("place", *fields, (F.col("text") if piece_text else cut(F.col("text"))).alias("text"))
    pieces = experiences.groupBy("rid").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    both = profiles.join(pieces, "rid", "left")
    shown = F.transform("pieces", lambda p: F.struct(*[p[f].alias(f) for f in fields], (cut(piece_text(p["text"])) if piece_text else p["text"]).alias("text")))
    types = {f.name: f.dataType for f in experiences.schema.fields}
    alone = F.struct(F.lit("resume").alias("ref"), F.lit("other").alias("kind"), F.lit("").alias("title"), F.lit("").alias("organization"), F.lit(None).cast(types["months"]).alias("months"), F.lit(None).cast(types["months_ago"]).alias("months_ago"), F.array().cast("array<string>").alias("technologies"), F.substring(F.coalesce(text, F.lit("")), 1, WHOLE).alias("text"))
    body = F.struct(F.coalesce("headline", F.lit("")).alias("headline"), F.col("total_months").alias("total_experience_months"), F.col("work_months").alias("work_experience_months"), F.coalesce(shown, F.array(alone)).alias("experiences"))
    return both.select("rid", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))
