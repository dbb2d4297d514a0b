"""Mixture-controlled packing of documents into fixed-length training sequences.

Each source is a queue of its documents' tokens. Windows of whole sequences are filled by deficit
round-robin: at each window a queue is credited its target share, serves its whole tokens, and the
fraction that it is owed stays as its deficit for the next window; slots left over go to the queues whose
next token is most overdue. Served that way, what a queue has been given after any number of windows is a
closed form of the queues' totals and targets, so every task finds the deficits that its first window
inherits without running the windows before it: deficits carry across partitions, and nothing but the totals
of the queues moves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrank.llm.common import map_batches, materialise
from loomrank.llm.wordids import word_ids

#: Queues up to which each document's place is computed from all queues' totals; sources beyond go to shared queues.
MAX_QUEUES = 4096
#: Rows of queue bases that are broadcast at most (about 40 bytes each).
MAX_BROADCAST_ROWS = 50_000


class Mixture:
    """Deficit round-robin over queues with ``totals`` tokens and target ``weights`` (default: the totals)."""

    def __init__(self, totals: list[int], weights: list[int] | None = None):
        self.totals, self.weights = totals, list(weights or totals)
        if any(t and w <= 0 for t, w in zip(self.totals, self.weights, strict=True)):
            raise ValueError("each queue with tokens needs a positive weight")
        self.total = sum(totals)
        ends = sorted({Fraction(t, w) for t, w in zip(self.totals, self.weights, strict=True) if t})
        #: (time, tokens served by then, weight of the queues that go on): where queues run dry
        self.phases: list[tuple[Fraction, Fraction, int]] = []
        for at in [Fraction(0), *ends]:
            self.phases.append((at, sum((min(Fraction(t), w * at) for t, w in zip(self.totals, self.weights, strict=True)), Fraction(0)), sum(w for t, w in zip(self.totals, self.weights, strict=True) if t and Fraction(t, w) > at)))
        self.memo: dict[int, list[int]] = {}

    def served(self, upto: int) -> list[int]:
        """Tokens that each queue has put among the first ``upto``; token j of a queue falls due at (j + 1/2) / weight."""
        upto = min(upto, self.total)
        if upto in self.memo:
            return self.memo[upto]
        at, done, weight = max((p for p in self.phases if p[1] <= upto), key=lambda p: p[0])
        now = at + (Fraction(upto) - done) / weight if weight else at
        num, den = now.numerator, now.denominator
        n = [min(t, (2 * w * num + den) // (2 * den)) for t, w in zip(self.totals, self.weights, strict=True)]
        owed = upto - sum(n)
        while owed > 0:
            i = min((i for i in range(len(n)) if n[i] < self.totals[i]), key=lambda i: (Fraction(2 * n[i] + 1, 2 * self.weights[i]), i))
            n[i] += 1
            owed -= 1
        while owed < 0:
            i = max((i for i in range(len(n)) if n[i]), key=lambda i: (Fraction(2 * n[i] - 1, 2 * self.weights[i]), i))
            n[i] -= 1
            owed += 1
        if len(self.memo) > 1000:
            self.memo.clear()
        self.memo[upto] = n
        return n

    def place(self, queue: int, start: int, length: int, window: int, sequence: int) -> Iterator[tuple[int, int, int, int]]:
        """Where tokens start..start + length of a queue lie: (first token, length, sequence id, offset there)."""
        k = start * self.total // max(1, self.totals[queue]) // window
        end = start + length
        while start < end:
            while k and self.served(k * window)[queue] > start:
                k -= 1
            while self.served((k + 1) * window)[queue] <= start:
                k += 1
            a, b = self.served(k * window), self.served((k + 1) * window)
            here = k * window + sum(b[i] - a[i] for i in range(queue)) + start - a[queue]
            to = min(end, b[queue])
            while start < to:
                n = min(to - start, sequence - here % sequence)
                yield start, n, here // sequence, here % sequence
                start, here = start + n, here + n


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Written table ``doc_id, source, part, before, n, ids``; ``before`` counts the task's earlier tokens of that source."""
    width = "<u2" if max(word_ids(tokenizer).size, end_id + 1) <= 1 << 16 else "<u4"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, sums = word_ids(tokenizer), TaskContext.get().partitionId(), {}
        for b in batches:
            ids = [np.frombuffer(x + end, "<u4") for x in encoder.encode_all(b.column("text").to_pylist())]
            before = []
            for s, x in zip(b.column("source").to_pylist(), ids, strict=True):
                before.append(sums.get(s, 0))
                sums[s] = before[-1] + len(x)
            n = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), n, pa.array([x.astype(width).tobytes() for x in ids], pa.binary())], ["doc_id", "source", "part", "before", "n", "ids"])

    cols = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    out = materialise(map_batches(cols, run, "doc_id long, source string, part int, before long, n long, ids binary"))
    out.loomrank_width = width
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, sequence: int = 1024, window_sequences: int = 32, targets: dict[str | None, int] | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source`` (and ``ids``).

    Windows of ``window_sequences`` sequences hold the sources in their target proportions (default: those of
    the corpus, so all queues end together; a source that ``targets`` doesn't name weighs 1); a source that runs dry leaves its
    share to the others. Beyond MAX_QUEUES sources those of one weight share queues, each of as much weight as its
    sources together, so that every weight still gets its proportion; inside a queue sources follow each other. All
    sequences are full but the last, so padding is less than one sequence. A null text is empty (one end
    token), a null source is a queue of its own, repeated rows are documents of their own, no rows give none.
    """
    table = tokenised(docs, tokenizer, end_id)
    width = table.loomrank_width
    sums = table.groupBy("part", "source").agg(F.sum("n").alias("tokens"))
    n_sources = sums.select("source").distinct().count()
    queue = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    named = [("-" if k is None else f"+{k}", int(v)) for k, v in (targets or {}).items()] or [("", 1)]
    weights_of = docs.sparkSession.createDataFrame(named, "t_name string, t_weight long")
    sums = sums.withColumn("name", queue).join(F.broadcast(weights_of), F.col("name") == F.col("t_name"), "left")
    sums = sums.select("part", "source", "tokens", "name", F.coalesce("t_weight", F.lit(1)).alias("weight"))
    queue = F.col("name")
    if n_sources > MAX_QUEUES:
        kinds = len({1, *(v for _, v in named)})
        if kinds > MAX_QUEUES // 2:
            raise ValueError("too many different target weights")
        queue = F.concat(F.col("weight").cast("string"), F.lit(":"), F.pmod(F.xxhash64("name"), F.lit(MAX_QUEUES // kinds)).cast("string"))
    ordered = Window.partitionBy("queue").orderBy("part", F.col("source").asc_nulls_first())
    bases = materialise(sums.withColumn("queue", queue).drop("name").withColumn("base", F.sum("tokens").over(ordered) - F.col("tokens")))
    # one row a source and queue first, so that a queue's sources are counted once each
    by_source = bases.groupBy("queue", "source").agg(F.sum("tokens").alias("tokens"), F.max("weight").alias("weight"))
    totals = [tuple(r) for r in by_source.groupBy("queue").agg(F.sum("tokens"), F.sum("weight")).orderBy("queue").collect()]  # MAX_QUEUES rows at most
    names = {q: i for i, (q, _, _) in enumerate(totals)}
    weights = [w for _, _, w in totals] if targets else None
    amounts = [t for _, t, _ in totals]
    window = window_sequences * sequence
    side = bases.select(F.col("part").alias("b_part"), F.col("source").alias("b_source"), "queue", "base")
    if bases.count() <= MAX_BROADCAST_ROWS:
        side = F.broadcast(side)
    placed = table.join(side, (F.col("part") == F.col("b_part")) & F.col("source").eqNullSafe(F.col("b_source"))).select("doc_id", "source", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = Mixture(amounts, weights)
        for b in batches:
            rows: list[tuple] = []
            for doc, source, q, at, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                flat = np.frombuffer(ids, width).astype("<u4")
                for first, length, seq, offset in mix.place(names[q], at, n, window, sequence):
                    piece = flat[first - at : first - at + length]
                    rows.append((doc, first - at, length, zlib.crc32(piece), n, seq, offset, source, piece.tolist() if with_ids else None))
            kinds = [pa.int64()] * 7 + [pa.string()] + [pa.list_(pa.int64())] * with_ids
            for i in range(0, len(rows), 20_000):
                cols = list(zip(*rows[i : i + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], COLUMNS[: len(kinds)])

    schema = ", ".join(f"{c} long" for c in COLUMNS[:7]) + ", source string" + ", ids array<long>" * with_ids
    return map_batches(placed, run, schema)


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"]


def sequences(pieces: DataFrame, pad_id: int = 0, sequence: int = 1024) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the padded sequences of pieces that carry their ids; a group holds one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    return out.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id).cast("long"), (sequence - F.size("ids")).cast("int"))))
