"""Language identification by error-correcting output codes.

Each language has a binary codeword. One linear classifier a bit, over hashed byte n-grams of the lower-cased
letters, predicts it. Decoding weighs the bits' logistic losses by how well each bit was learnt, takes the
nearest codeword and flags documents whose second-nearest is close.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.llm.common import held_out, map_batches

#: Documents that are learnt from at most, by hash of doc_id; hash buckets; passes of the fit.
FIT_ROWS, BUCKETS, PASSES = 3000, 4096, 120
#: Probability margin under which a document is ambiguous.
MARGIN = 0.2
#: Rows out of which limits of the decoding loss are learnt, in all and in a length class, at least; a limit is SLACK times that quantile of their losses,
#: and never below NEAR (each bit decoded with a probability of about 0.95).
GATE_ROWS, CLASS_ROWS, QUANTILE, SLACK, NEAR = 200, 40, 0.999, 2.0, 0.05
LETTER = regex.compile(r"\p{L}")
#: ASCII characters that aren't letters become blanks.
FOLD = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def grams(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed 1-, 2- and 3-grams of the folded bytes."""
    b = np.frombuffer(b" ".join((text or "").lower().encode("utf-8", "replace").translate(FOLD).split()), np.uint8).astype(np.uint32)
    if not len(b):
        return np.zeros(BUCKETS, np.float32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    salt, spread = np.uint32(0x9E3779B1), np.uint32(20)
    keys = np.concatenate([b + np.uint32(1 << 24), two + np.uint32(2 << 24), three]) * salt >> spread
    counts = np.bincount(keys.astype(np.int64), minlength=BUCKETS)
    return np.sqrt(counts / len(keys)).astype(np.float32)


def codewords(classes: int) -> np.ndarray:
    """Signs of each class's bits: all different non-constant splits for few classes, else random with the greatest least distance."""
    if classes <= 6:
        rows = [(1, *p) for p in product((1, -1), repeat=max(0, classes - 1))]
        splits = [r for r in rows if len(set(r)) > 1]
        return np.array(splits, np.float32).T if splits else np.ones((classes, 1), np.float32)
    rng = np.random.default_rng(7)
    bits = 10 * int(np.ceil(np.log2(classes)))
    best, most = None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (classes, bits)).astype(np.float32)
        d = ((m[:, None, :] != m[None, :, :]).sum(2) + np.eye(classes) * bits).min()
        if d > most:
            best, most = m, d
    return best


class OutputCodes:
    def __init__(self, texts: list[str | None], langs: list[str]):
        self.langs = sorted(set(langs))
        at = {x: i for i, x in enumerate(self.langs)}
        y = np.array([at[x] for x in langs], np.int64)
        self.code = codewords(len(self.langs))
        x = np.stack([grams(t) for t in texts]) if texts else np.zeros((0, BUCKETS), np.float32)
        self.mean = x.mean(0) if len(x) else np.zeros(BUCKETS, np.float32)
        x = x - self.mean
        bits = self.code[y] if len(y) else np.zeros((0, self.code.shape[1]), np.float32)
        share = np.bincount(y, minlength=len(self.langs)) if len(y) else np.ones(len(self.langs))
        weight = (len(y) / np.maximum(share, 1) / max(1, len(self.langs)))[y][:, None].astype(np.float32) if len(y) else np.ones((0, 1), np.float32)
        w, m, v = (np.zeros((BUCKETS + 1, self.code.shape[1]), np.float32) for _ in range(3))
        for step in range(1, PASSES + 1 if len(y) else 1):  # Adam on the weighted logistic loss
            margin = bits * (x @ w[:-1] + w[-1])
            pull = -(bits * weight / (1 + np.exp(np.clip(margin, -30, 30)))) / len(x)
            g = np.concatenate([x.T @ pull, pull.sum(0, keepdims=True)]) + 1e-6 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights = w
        right = ((bits * (x @ w[:-1] + w[-1]) > 0).mean(0) if len(y) else np.ones(self.code.shape[1])).clip(0.51, 0.999)
        #: a bit's say in the decoding
        self.trust = np.log(right / (1 - right)).astype(np.float64)
        self.trust /= self.trust.sum()

    def losses(self, texts: list[str | None]) -> np.ndarray:
        """Decoding loss of each text (row) to each language."""
        x = np.stack([grams(t) for t in texts]) - self.mean
        margins = (x @ self.weights[:-1] + self.weights[-1]).astype(np.float64)
        return np.stack([(np.logaddexp(0, -margins * c) * self.trust).sum(1) for c in self.code], 1) if self.langs else np.zeros((len(texts), 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, probability and ambiguity of each text; ``und`` without a letter or without any learnt language."""
        loss = self.losses(texts)
        p = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)[:, ::-1]
        unclear = (top[:, 0] - (top[:, 1] if p.shape[1] > 1 else 0)) < MARGIN
        none = np.array([not self.langs or not LETTER.search(t or "") for t in texts])
        langs = ["und" if none[i] else self.langs[best[i]] for i in range(len(texts))]
        return langs, np.where(none, 0.0, np.round(top[:, 0], 9)), none | unclear


def length_class(text: str | None) -> int:
    """Doublings of the number of letters, 10 at most: few letters are decoded with a greater loss."""
    return min(10, len(LETTER.findall(text or "")).bit_length())


class Gate(OutputCodes):
    """Codes that also tell what is near none of their words.

    The limits of the decoding loss, one a length class, come from learnable rows as a model of the other half of
    them decodes them. A longer class's limit is never the greater; a class with few rows takes the shorter one's.
    Under GATE_ROWS rows nothing can be told about losses and there is no limit.
    """

    def __init__(self, texts: list[str | None], langs: list[str]):
        super().__init__(texts, langs)
        self.limits = np.full(11, np.inf)
        if len(texts) < GATE_ROWS or len(self.langs) < 2:
            return
        kind, loss = np.array([length_class(t) for t in texts]), np.zeros(len(texts))
        for half in (0, 1):
            other = OutputCodes(texts[1 - half :: 2], langs[1 - half :: 2])
            loss[half::2] = other.losses(texts[half::2]).min(1)
        limit = np.inf
        for k in range(11):
            if (kind == k).sum() >= CLASS_ROWS:
                limit = min(limit, max(NEAR, SLACK * np.quantile(loss[kind == k], QUANTILE)))
            self.limits[k] = limit

    def near(self, texts: list[str | None]) -> np.ndarray:
        """Whether each text is within its limit of some language."""
        return self.losses(texts).min(1) <= self.limits[[length_class(t) for t in texts]]


def fit(docs: DataFrame, rows: int = FIT_ROWS, kind: type[OutputCodes] = OutputCodes) -> OutputCodes:
    """Fit on rows with a language that may be learnt from, at most about ``rows`` of them, in one task."""
    told = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null").where(~held_out(F.col("id")))
    n = docs.where("lang is not null").count()
    if n > rows:
        told = told.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(rows / n * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((t, x) for b in batches for x, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(kind([g[0] for g in got], [g[1] for g in got]))], pa.binary())], ["model"])

    got = map_batches(told.select("lang", "text").repartition(1), run, "model binary").first()
    return pickle.loads(got[0]) if got else kind([], [])


def language_scores(docs: DataFrame, rows: int = FIT_ROWS, keep: bool = False) -> DataFrame:
    """One row a document: ``doc_id, held_out, lang_pred, score, ambiguous``.

    Null texts and texts without a letter are ``und`` with score 0. Repeated rows are predicted one by one; an
    empty table gives none. Only doc_id, lang and text are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                langs, score, unclear = model.value.predict(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs), pa.array(score), pa.array(unclear)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows_in = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return map_batches(rows_in, run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_language(docs: DataFrame, languages: list[str] | None = None, rows: int = FIT_ROWS) -> DataFrame:
    """Rows of ``docs`` whose text is in a learnt language (one of ``languages`` if given), as they were, without a shuffle.

    A text goes that has no letter or whose decoding loss to every language is past its limit. All rows stay where no
    language could be learnt.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, rows, Gate))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and not model.value.langs:
                yield b
            elif b.num_rows:
                texts = b.column(at).to_pylist()
                langs, _, _ = model.value.predict(texts)
                yield b.filter(pa.array([bool(n) and x != "und" and (not languages or x in languages) for x, n in zip(langs, model.value.near(texts), strict=True)]))

    at = docs.columns.index("text")
    return map_batches(docs, run, docs.schema)
