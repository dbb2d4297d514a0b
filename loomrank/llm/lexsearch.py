"""Ranked lexical search with variable blocks of bounds.

Tasks read whole texts once and keep of each document its number of terms and the terms that items ask for. Shards of some
thousand documents are then searched in full, each by an inverted index with integer impacts. A posting list is parted into
blocks by dynamic programming: of all partings with as many blocks it has the least sum of (greatest impact - impact), the
error of the bounds.

An item's search in a shard adds up the greatest impacts of the blocks that lie over each document (a pivot test for all
documents at once). The documents with the best bounds are scored first; after that only blocks are opened that hold a
document whose bound reaches the k-th best score, which passes from shard to shard of a task. A bound that only equals it is followed
up, so ties are settled by doc_id. Spark merges the tasks' best rows.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrank.llm.common import map_batches, materialise

#: Results an item.
TOP = 20
#: Documents and postings of a shard; one document may have more.
SHARD_DOCS, SHARD_POSTINGS = 8192, 1_500_000
#: Postings that a boundary may follow, granules of a block at most, and of a block on average.
GRANULE, MOST, USUAL = 8, 16, 4
#: Documents that are scored first.
SEED = 256
#: Items, and characters of them, that one pass over the documents serves.
PASS_ITEMS, PASS_CHARS = 5_000, 16 << 20
#: Bytes of a text that are split at once.
RUN = 1 << 20
BETWEEN = bytes(b for b in range(0x80) if chr(b) not in string.ascii_letters + string.digits)
FOLD = bytes.maketrans(string.ascii_uppercase.encode() + BETWEEN, string.ascii_lowercase.encode() + b" " * len(BETWEEN))
NO_ID = (1 << 63) - 1


def runs_of_terms(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms in order, some at a time."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        end = len(folded)
        if at + RUN < end:
            end = folded.rfind(b" ", at + 1, at + RUN)
            end = end if end > 0 else folded.find(b" ", at + RUN)
            end = end if end > 0 else len(folded)
        yield folded[at:end].split()
        at = end


def asked_terms(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of the rows with a term: how many they have, which asked ones and how often (ints as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for b in batches:
            sizes, terms, tfs = [], [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                n, found = 0, Counter()
                for words in runs_of_terms(text or b""):
                    n += len(words)
                    found.update(map(get, words))
                found.pop(None, None)
                sizes.append(n)
                terms.append(np.fromiter(found.keys(), np.int32, len(found)).tobytes())
                tfs.append(np.fromiter(found.values(), np.int64, len(found)).tobytes())
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(np.array(sizes, np.int64) > 0))

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n long, terms binary, tfs binary")


def counts(held: DataFrame, terms: int) -> dict[int, int]:
    """Documents that hold each asked term; their number under -1, all their terms under -2. A row a task and term is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, size = np.zeros(terms, np.int64), 0, 0
        for b in batches:
            flat = np.frombuffer(b"".join(b.column("terms").to_pylist()), np.int32)
            df += np.bincount(flat, minlength=terms)
            n, size = n + b.num_rows, size + int(b.column("n").to_numpy().sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [n, size]))], ["term", "v"])

    rows = map_batches(held.select("n", "terms"), run, "term long, v long").groupBy("term").agg(F.sum("v").alias("v"))
    return {r.term: r.v for r in rows.collect()}


def boundaries(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First postings of the blocks of all lists; ``values`` are impacts, lists begin at ``starts``.

    Of all partings at granules the sum of (greatest - value) plus a price a block is least. The price of a list is its
    mean error in blocks of the usual size. Lists of about the same length are worked out together.
    """
    sizes = np.diff(np.append(starts, len(values)))
    granules = -(-sizes // GRANULE)
    base = np.cumsum(granules) - granules
    first = np.repeat(starts, granules) + GRANULE * (np.arange(granules.sum()) - np.repeat(base, granules))
    length = np.minimum(GRANULE, np.repeat(starts + sizes, granules) - first).astype(float)
    top, total = np.maximum.reduceat(values, first).astype(float), np.add.reduceat(values, first).astype(float)
    found = []
    group = np.frexp(granules)[1]
    for g in np.unique(group):
        lists = np.flatnonzero(group == g)
        width = int(granules[lists].max())
        at = np.minimum(base[lists, None] + np.arange(width), len(first) - 1)
        real = np.arange(width) < granules[lists, None]
        t, s, n = (np.where(real, x[at], 0.0) for x in (top, total, length))
        whole = width + -width % USUAL
        pad = lambda x: np.pad(x, ((0, 0), (0, whole - width))).reshape(len(lists), -1, USUAL)  # noqa: B023, E731
        price = (pad(n).sum(2) * pad(t).max(2) - pad(s).sum(2)).sum(1) / -(-granules[lists] // USUAL) + 1
        best = np.full((len(lists), width + MOST), np.inf)  # by the number of granules, behind MOST that can't be
        best[:, MOST - 1] = 0
        back = np.zeros((len(lists), width), np.int64)
        rt, rs, rn = (np.zeros((len(lists), MOST)) for _ in range(3))
        for i in range(width):
            rt = np.maximum(np.concatenate([np.zeros((len(lists), 1)), rt[:, :-1]], 1), t[:, i, None])
            rs = np.concatenate([np.zeros((len(lists), 1)), rs[:, :-1]], 1) + s[:, i, None]
            rn = np.concatenate([np.zeros((len(lists), 1)), rn[:, :-1]], 1) + n[:, i, None]
            cost = best[:, i : i + MOST][:, ::-1] + rn * rt - rs
            back[:, i] = cost.argmin(1)
            best[:, i + MOST] = cost[np.arange(len(lists)), back[:, i]] + price
        last = granules[lists] - 1
        rows = np.arange(len(lists))
        while len(rows):
            begin = last - back[rows, last]
            found.append(first[base[lists[rows]] + begin])
            on = begin > 0
            rows, last = rows[on], begin[on] - 1
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def gathered(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of some ranges."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


class Shard:
    """An inverted index of some documents, which lie in the order of their ids."""

    def __init__(self, batches: list[pa.RecordBatch], weight: np.ndarray, n: int, size: int):
        ids = np.concatenate([b.column("doc_id").fill_null(NO_ID).to_numpy() for b in batches])
        order = np.argsort(ids, kind="stable")
        terms = [np.frombuffer(x, np.int32) for b in batches for x in b.column("terms").to_pylist()]
        tfs = [np.frombuffer(x, np.int64) for b in batches for x in b.column("tfs").to_pylist()]
        words = np.concatenate([b.column("n").to_numpy() for b in batches])
        self.ids = ids[order]
        m = np.array([75 + 25 * x * n // size for x in words[order].tolist()], np.int64)  # in ints of any size
        doc = np.repeat(np.arange(len(order)), [len(terms[i]) for i in order])
        term, tf = (np.concatenate([x[i] for i in order]) if len(doc) else np.zeros(0, np.int64) for x in (terms, tfs))
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        by = np.argsort(term, kind="stable")
        by = by[impact[by] > 0]
        self.doc, self.impact, term = doc[by], impact[by], term[by]
        self.term, starts = np.unique(term, return_index=True)
        self.block = boundaries(self.impact, starts)
        self.until = np.append(self.block, len(by))[1:]
        self.most = np.maximum.reduceat(self.impact, self.block) if len(by) else self.impact
        self.low, self.high = self.doc[self.block], self.doc[self.until - 1]
        self.of = np.searchsorted(self.block, np.append(starts, len(by)))
        self.opened = self.asked = 0

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k best ``(scores, ids)`` of those so far and of this shard's documents."""
        at = np.searchsorted(self.term, terms)
        has = (at < len(self.term)) & (self.term[np.minimum(at, len(self.term) - 1)] == terms) if len(self.term) else np.zeros(len(terms), bool)
        at, times = at[has], times[has]
        if not len(at):
            return best
        blocks = gathered(self.of[at], self.of[at + 1])
        many = np.repeat(times, self.of[at + 1] - self.of[at])
        change = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(change, self.low[blocks], many * self.most[blocks])
        np.add.at(change, self.high[blocks] + 1, -many * self.most[blocks])
        bound = np.cumsum(change)[:-1]
        self.asked += int((self.until[blocks] - self.block[blocks]).sum())
        seed = np.argpartition(-bound, SEED)[:SEED] if len(bound) > SEED else np.arange(len(bound))
        best = self.scored(seed[bound[seed] >= self.least(best, k)], blocks, many, k, best)
        bound[seed] = 0
        return self.scored(np.flatnonzero(bound >= self.least(best, k)), blocks, many, k, best)

    @staticmethod
    def least(best: tuple[np.ndarray, np.ndarray], k: int) -> int:
        return int(best[0][-1]) if len(best[0]) == k else 1

    def scored(self, docs: np.ndarray, blocks: np.ndarray, many: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``best`` with some documents scored in full; blocks without one of them stay closed."""
        if not len(docs):
            return best
        wanted = np.zeros(len(self.ids), bool)
        wanted[docs] = True
        before = np.append(0, np.cumsum(wanted))
        live = before[self.high[blocks] + 1] > before[self.low[blocks]]
        lo, hi = self.block[blocks[live]], self.until[blocks[live]]
        at = gathered(lo, hi)
        self.opened += len(at)
        score = np.zeros(len(self.ids), np.int64)
        np.add.at(score, self.doc[at], np.repeat(many[live], hi - lo) * self.impact[at])
        docs = docs[score[docs] > 0]
        s, i = np.append(best[0], score[docs]), np.append(best[1], self.ids[docs])
        order = np.lexsort((i, -s))[:k]
        return s[order], i[order]


def searched(items: list[tuple[int, np.ndarray, np.ndarray]], weight: np.ndarray, n: int, size: int, k: int):
    """``no, doc_id, score``: the best rows of a task for each of ``items(no, terms, times)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        best = [none] * len(items)
        held: list[pa.RecordBatch] = []
        docs = postings = 0

        def pour() -> None:
            shard = Shard(held, weight, n, size)
            for j, (_, terms, times) in enumerate(items):
                best[j] = shard.search(terms, times, k, best[j])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            docs, postings = docs + b.num_rows, postings + sum(len(x) for x in b.column("terms").to_pylist()) // 4
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                pour()
                held, docs, postings = [], 0, 0
        if held:
            pour()
        for at in range(0, len(items), 1000):
            some = range(at, min(at + 1000, len(items)))
            no = np.repeat([items[j][0] for j in some], [len(best[j][0]) for j in some])
            score, ids = (np.concatenate([best[j][i] for j in some]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(ids, mask=ids == NO_ID), pa.array(score)], ["no", "doc_id", "score"])

    return run


def one_pass(docs: DataFrame, texts: list[tuple[int, str | None]], k: int) -> DataFrame | None:
    number: dict[bytes, int] = {}
    items = []
    for no, text in texts:
        found = Counter(number.setdefault(t, len(number)) for words in runs_of_terms((text or "").encode("utf-8", "replace")) for t in words)
        if found:
            items.append((no, np.fromiter(found.keys(), np.int32, len(found)), np.fromiter(found.values(), np.int64, len(found))))
    if not items:
        return None
    held = materialise(asked_terms(docs, number))
    df = counts(held, len(number))
    n, size = df.get(-1, 0), df.get(-2, 0)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(number))], np.int64)
    return map_batches(held, searched(items, weight, n, size, k), "no long, doc_id long, score long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    Scores are whole numbers (README: contract of ``op11``); only those above 0 count, equal ones go by doc_id, a null one
    last. Null and blank texts hold no term: such a document is in no count, such an item has no rows. Repeated items have
    rows each, repeated documents are documents of their own. No documents or no items give no rows. Only the named columns are read, so
    others can't clash. Items are read by the driver in passes of bounded size, for they are questions.
    """
    spark: SparkSession = docs.sparkSession
    asked = items.select("item_id", F.col("text").cast("string").alias("text"))
    many = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    passes = max(1, -(-many.n // PASS_ITEMS), -(-many.chars // PASS_CHARS))
    kind, names, parts = items.schema["item_id"].dataType, [], []
    for i in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).collect() if passes > 1 else asked.collect()
        texts = [(len(names) + j, r.text) for j, r in enumerate(rows)]
        names += [(len(names) + j, r.item_id) for j, r in enumerate(rows)]
        if (found := one_pass(docs, texts, k)) is not None:
            parts.append(found)
    named = spark.createDataFrame(names, f"no long, item_id {kind.simpleString()}")
    best = parts[0] if parts else spark.createDataFrame([], "no long, doc_id long, score long")
    for p in parts[1:]:
        best = best.unionByName(p)
    by = Window.partitionBy("no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.join(named, "no").select("item_id", "rank", "doc_id", "score")


TERMS_OF = "unnest(regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))".format(up=string.ascii_uppercase, low=string.ascii_lowercase)
SEARCH_SQL = f"""with d as (select row_number() over () as row, doc_id, text from documents),
 w as (select row, doc_id, {TERMS_OF} as term from d),
 tf as (select row, doc_id, term, count(*) as tf from w group by all),
 ln as (select row, sum(tf)::bigint as n from tf group by row),
 al as (select count(*) as nn, sum(n)::bigint as ll from ln),
 df as (select term, count(*) as df from tf group by term),
 wt as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint as w from df, al),
 i as (select row_number() over () as no, item_id, text from benchmark),
 q as (select no, item_id, {TERMS_OF} as term from i),
 qt as (select no, item_id, term, count(*) as times from q group by all),
 s as (select no, item_id, tf.row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::bigint as score from qt join tf using (term) join wt using (term) join ln on ln.row = tf.row, al group by all),
 r as (select item_id, row_number() over (partition by no order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0)
 select * from r where rank <= {TOP}"""
