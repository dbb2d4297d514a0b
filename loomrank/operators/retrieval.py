"""Lexical and vector retrieval, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrank.functions import scores as S
from loomrank.functions.text import tokens
from loomrank.streaming.upsert import written

#: Rows of a side that is broadcast at most: query terms and profile chunks are bounded by the profile's size.
MAX_BROADCAST_ROWS = 20_000
#: Documents of a task that holds a row for each item they share a term with.
DEALT = 5_000


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is small enough, else as it is for the planner to shuffle."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def term_counts(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, term, tf``."""
    return docs.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def weighted_terms(chunks: DataFrame) -> DataFrame:
    """``term, weight`` of ``chunks(text, weight, listed)``: the greatest weight of what is demonstrated, else the listed weight."""
    terms = chunks.select(F.explode(tokens(F.col("text"))).alias("term"), "weight", "listed")
    shown = F.max(F.when(~F.col("listed"), F.col("weight")))
    return terms.groupBy("term").agg(F.coalesce(shown, F.lit(S.LISTED_WEIGHT)).alias("weight"))


def bm25(docs: DataFrame, key: str, text: Column, query: DataFrame) -> DataFrame:
    """``key, score`` of the documents with a query term; ``query(term, weight)``.

    Texts are tokenised once. Tokens meet the query terms in the task that makes them; what is written is a row for each
    document and one for each query term it holds, and lengths, term and document frequencies all come from that. Every
    document carries an empty term, which the query gets too, so that those without a match still count.
    """
    marked = small(query.select("term", F.col("weight").cast("double").alias("weight")).union(query.sparkSession.createDataFrame([("", 0.0)], "term string, weight double")))
    toks = docs.select(key, tokens(text).alias("toks")).select(key, "toks", F.size("toks").alias("len"))
    # explode_outer, for explode makes the planner ask for the tokens once more to see whether there are any
    each = toks.select(key, "len", F.explode_outer(F.concat(F.array(F.lit("")), "toks")).alias("term"))
    held = written(each.join(marked, "term").groupBy(key, "term", "len", "weight").agg(F.count("*").alias("tf")))
    stats = held.where("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("mean")).first()
    n, mean = stats["n"] or 0, stats["mean"] or 1.0
    tf = held.where("term <> ''")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("weight") * idf * F.col("tf") * (S.BM25_K1 + 1) / (F.col("tf") + S.BM25_K1 * (1 - S.BM25_B + S.BM25_B * F.col("len") / mean))
    return tf.join(small(df), "term").groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


def most_shared(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, shared``: for each document of ``docs(doc_id, text)`` the item of ``items(item_id, term)`` with the most of its different terms, the least id on ties.

    Counts are held by document and item until a task ends, so documents are dealt out by id first, at most about DEALT to a
    task: what it holds doesn't grow with the table or the size of its files. The two groupings keep this dealing.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // DEALT))
    each = docs.select("doc_id", "text").repartition(parts, "doc_id").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    shared = each.join(small(items), "term").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    best = shared.groupBy("doc_id").agg(F.max(F.struct("shared", (-F.col("item_id")).alias("neg"))).alias("b"))
    return best.select("doc_id", (-F.col("b.neg")).alias("item_id"), F.col("b.shared").alias("shared"))


def max_similarity(chunks: DataFrame, profile: DataFrame) -> DataFrame:
    """``owner, semantic, recency`` of ``chunks(owner, chunk, vec, weight)`` against ``profile(rid, rvec, rweight, rrecency)``.

    The best weighted similarity of each chunk is averaged by chunk weight; recency follows the most similar
    profile chunk, unweighted, the first on ties. The profile is one bounded row set, gathered into an array and
    carried by the chunk rows, so no pair of chunks ever becomes a row.
    """
    side = profile.agg(F.array_sort(F.collect_list(F.struct("rid", "rvec", "rweight", "rrecency"))).alias("rows"))
    sims = F.transform("rows", lambda r: F.struct(F.round(S.dot(F.col("vec"), r["rvec"]), 9).alias("sim"), (-r["rid"]).alias("neg"), r["rweight"].alias("w"), r["rrecency"].alias("rec")))
    each = chunks.join(F.broadcast(side)).withColumn("sims", sims)
    each = each.select("owner", "weight", F.array_max(F.transform("sims", lambda s: s["sim"] * s["w"])).alias("best"), F.array_max("sims")["rec"].alias("rec"))
    dated = F.when(F.col("rec").isNotNull(), F.col("weight"))
    return each.groupBy("owner").agg(
        F.round(F.sum(F.col("best") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-9)), 6).alias("semantic"),
        F.round(F.sum(F.col("rec") * dated) / F.sum(dated), 6).alias("recency"),
    )


def global_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with 1-based positions in a total order, without one task for all rows.

    Rows are sorted over ranges; each partition's count is all that is gathered (one row a partition).
    """
    placed = df.orderBy(*order).withColumn("__p", F.spark_partition_id()).withColumn("__r", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33)).persist()
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    starts = sizes.select(F.col("__p").alias("__q"), (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__s"))
    return placed.join(F.broadcast(starts), F.col("__p") == F.col("__q")).withColumn(name, (F.col("__r") + F.col("__s") + 1).cast("long")).drop("__p", "__r", "__q", "__s")


def reciprocal_rank_fusion(df: DataFrame, key: str, lexical: str, semantic: str) -> DataFrame:
    """``df`` with ``r_lex, r_sem, fused``; descending, nulls last, ties by key."""
    for name, score in (("r_lex", lexical), ("r_sem", semantic)):
        df = global_rank(df, name, F.col(score).desc_nulls_last(), F.col(key).asc())
    return df.withColumn("fused", F.round(1 / (S.RRF + F.col("r_lex")) + 1 / (S.RRF + F.col("r_sem")), 9))


def cascade(df: DataFrame, key: str, fused: str, judge: str, pool: int = S.POOL) -> DataFrame:
    """All rows, with ``pos``: the best ``pool`` by ``fused`` in the order of the costlier ``judge``, the others beneath as they were.

    The pool bounds what is judged and nothing else: ``judge`` is null outside it.
    """
    ranked = global_rank(df, "pos", F.col(fused).desc(), F.col(key).asc())
    by = Window.orderBy(F.col(judge).desc_nulls_last(), F.col(fused).desc(), F.col(key))  # over the bounded pool
    head = ranked.where(F.col("pos") <= pool).withColumn("pos", F.row_number().over(by).cast("long"))
    tail = ranked.where(F.col("pos") > pool).withColumn(judge, F.lit(None).cast(df.schema[judge].dataType))
    return head.unionByName(tail)


def lexical_only(df: DataFrame, lexical: str) -> DataFrame:
    """``df`` with ``fused`` where there are no similarities: the lexical score over the greatest one, or over 1 if that is 0."""
    most = df.agg(F.max(lexical).alias("__most"))
    return df.join(F.broadcast(most)).withColumn("fused", F.col(lexical) / F.coalesce(F.nullif("__most", F.lit(0.0)), F.lit(1.0))).drop("__most")


def shortlist(df: DataFrame, key: str, fused: str, k: int) -> DataFrame:
    """The k best rows with ``pos``, best first; all of them for k = 0."""
    order = (F.col(fused).desc(), F.col(key).asc())
    return global_rank(df.orderBy(*order).limit(k) if k else df, "pos", *order)


def clamped(limit: int, most: int = 100) -> int:
    return max(1, min(most, limit))
