"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus. DataFrame functions only.

Two multinomials over hash buckets are counted over whole texts: one over all documents, one over documents
with a trusted label. A document's verdict is its mean log ratio against a fixed threshold, after plain base
rules on length and repetition. The features of a word are the word and the character trigrams at its two ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of either multinomial; the table of their log ratios is all that reaches the driver.
BUCKETS = 1 << 14
#: Trusted ids that are broadcast at most, 8 bytes each; of more none is left out, but the join is dealt out by id.
TRUSTED_ROWS = 200_000
#: Least mean log ratio that is kept.
THRESHOLD = -0.75
#: Pseudo-count of a bucket.
SMOOTHING = 1.0
# Fixed values of the contract: white space that parts words, and characters counted as symbols.
SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def without(text: Column, chars: str, by: str = "") -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(without(text, SPACES, " "), " "), "")


def bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def ends_of(word: Column) -> tuple[Column, Column]:
    """Hashes of the character trigrams at a word's ends, apart from each other and from the word's own."""
    return F.xxhash64(F.substring(word, 1, 3), F.lit(1)), F.xxhash64(F.right(word, F.lit(3)), F.lit(2))


def log_ratios(docs: DataFrame, labels: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> list[float]:
    """Log ratio of each bucket: trusted target over raw corpus, both counted over all words of all their documents."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id"))
    good = good.distinct()
    good = F.broadcast(good) if good.count() <= trusted_rows else good.hint("merge")
    marked = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(good, F.col("id") == F.col("good_id"), "left")
    found = marked.select(F.col("good_id").isNotNull().cast("long").alias("good"), F.explode(words_of(F.coalesce("text", F.lit("")))).alias("word"))
    first, last = ends_of(F.col("word"))
    found = found.select("good", F.explode(F.array(bucket(F.xxhash64("word")), bucket(first), bucket(last))).alias("bucket"))
    counts = {r[0]: (r[1], r[2]) for r in found.groupBy("bucket").agg(F.count("*"), F.sum("good")).collect()}  # BUCKETS rows at most
    raw = sum(c[0] for c in counts.values()) + SMOOTHING * BUCKETS
    target = sum(c[1] for c in counts.values()) + SMOOTHING * BUCKETS
    out = []
    for b in range(BUCKETS):
        r, t = counts.get(b, (0, 0))
        out.append(math.log((t + SMOOTHING) / target) - math.log((r + SMOOTHING) / raw))
    return out if target > SMOOTHING * BUCKETS else [0.0] * BUCKETS


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, prefix: str = "", ratios: list[float] | None = None) -> DataFrame:
    """``docs`` with the columns of the verdict, named behind ``prefix``."""
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in (ratios or log_ratios(docs, labels)))), ",").cast("array<double>")
    p = prefix
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col(f"{p}text"), "\n"), lambda x: F.btrim(x, F.lit(" " + SPACES)) != "")
    df = docs.withColumn(f"{p}text", text).withColumn(f"{p}words", words_of(F.col(f"{p}text"))).withColumn(f"{p}lines", lines)
    words = F.col(f"{p}words")
    df = df.withColumn(f"{p}hashes", F.transform(words, lambda w: F.xxhash64(w)))
    hashes = F.col(f"{p}hashes")
    windows = F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    df = df.withColumn(f"{p}windows", windows)
    w = F.col(f"{p}windows")
    # only texts with a repeated window pay for the sort that finds where the repeats lie
    df = df.withColumn(f"{p}sorted", F.when(F.size(F.array_distinct(w)) < F.size(w), F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col(f"{p}sorted")
    twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    df = df.withColumn(f"{p}twice", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.col(f"{p}twice"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    score = F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.get(table, bucket(h))) + F.aggregate(words, F.lit(0.0), lambda a, w: a + sum(F.get(table, bucket(e)) for e in ends_of(w)))
    n = F.col(f"{p}n_words")
    df = df.withColumns({
        f"{p}n_words": F.size(words).cast("long"),
        f"{p}word_chars": F.length(F.array_join(words, "")).cast("long"),
        f"{p}n_symbols": (F.length(f"{p}text") - F.length(without(F.col(f"{p}text"), SYMBOLS))).cast("long"),
        f"{p}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
        f"{p}n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        f"{p}sum": score,
    })
    df = df.withColumn(f"{p}base_failed", (n < 50) | (100 * F.col(f"{p}n_repeat_words") > 50 * n))
    df = df.withColumn(f"{p}log_ratio", F.when(n > 0, F.round(F.col(f"{p}sum") / (3 * n), 6)))
    return df.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (F.coalesce(f"{p}log_ratio", F.lit(float("-inf"))) >= threshold))


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio"]


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, ratios: list[float] | None = None) -> DataFrame:
    """One row a document: ``doc_id``, the base counts, ``base_failed``, ``kept`` and the mean ``log_ratio``.

    A null or blank text has no word: it fails the base rules and has no ratio. Without trusted labels all
    ratios are 0 and the base rules alone decide. Repeated rows are judged one by one; an empty table gives
    none; further columns are not read.
    """
    df = judged(docs.select("doc_id", "text"), labels, threshold, "__q_", ratios)
    return df.select("doc_id", *[F.col(f"__q_{c}").alias(c) for c in COLUMNS])


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose document is kept, as they were, whatever their columns are called.

    Null and blank texts go, repeated rows stay or go alike, an empty table gives none.
    """
    mark = "__q_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark = "_" + mark
    # the row number keeps the optimiser from moving the verdict, written out in full, below the columns it reads
    seen = judged(docs, labels, threshold, mark).withColumn(f"{mark}row", F.monotonically_increasing_id())
    return seen.where(F.col(f"{mark}kept") & (F.col(f"{mark}row") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
