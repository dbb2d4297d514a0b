"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled documents gives the terms (words and word beginnings that tell the labels
apart), their weights and the examples. The index has a postings list a term, cut into blocks of examples, and every
block's greatest weight: a query's best possible cosine with a block is known before it is opened, and blocks that
can't reach the k-th best are never scored. Votes of the k nearest are weighted by distance and calibrated by isotonic
regression on leave-one-out votes; the neighbours are the evidence.

The cosine is over terms that tell the labels apart, not over all words: with all words neighbours are of like topic
and length, and the votes say little of the label (the figures are in the README).
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.llm.common import held_out, map_batches

#: Labelled documents that are learnt from at most, by hash of doc_id.
FIT_ROWS = 8000
#: Neighbours that vote, examples of a block.
NEIGHBOURS, BLOCK = 15, 64
#: Documents of label 1 that a term must lie in (a quarter of them where they are few), and times its share there must
#: exceed its share elsewhere.
LEAST_DOCS, LEAST_LIFT = 5, 3.0
WORD = re.compile(r"\w+")
#: Lengths of word beginnings that are terms besides whole words.
HEADS = (4, 5, 6)


def terms_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in HEADS if len(word) > n]]


class Vocabulary:
    def __init__(self, terms: list[str]):
        self.index = {t: i for i, t in enumerate(terms)}
        self.whole = {t for t in terms if not t.endswith("*")}
        self.heads = {t[: min(HEADS)] for t in terms if t.endswith("*")}
        self.words: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> dict[int, int]:
        """Occurrences of each term; most words are passed over by two set look-ups."""
        words = WORD.findall((text or "").lower())
        distinct = set(words)
        n = min(HEADS)
        hit = (distinct & self.whole) | {w for w in distinct if w[:n] in self.heads}
        out: dict[int, int] = {}
        if hit:
            for w, c in Counter([w for w in words if w in hit]).items():
                for t in terms_of(w):
                    if (i := self.index.get(t)) is not None:
                        out[i] = out.get(i, 0) + c
        return out


class BlockMaxIndex:
    """Postings of sparse vectors (term to weight) by term, in blocks of BLOCK vectors with each block's greatest weight."""

    def __init__(self, vectors: list[dict[int, float]], terms: int):
        entries = sorted((t, i, w) for i, v in enumerate(vectors) for t, w in v.items())
        self.size, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        self.places = np.array([e[1] for e in entries], np.int64)
        self.weights = np.array([e[2] for e in entries], float)
        term = np.array([e[0] for e in entries], np.int64)
        #: a chunk is what one term has in one block
        cell = term * max(1, self.blocks) + self.places // BLOCK
        self.cuts = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell))
        first = self.cuts[:-1]
        self.chunk_block = self.places[first] // BLOCK
        self.chunk_max = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        #: chunks of each term
        self.starts = np.searchsorted(term[first], np.arange(terms + 1))

    def nearest(self, query: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the k nearest vectors that share a term, best first, the earlier on ties; perhaps fewer."""
        bound = np.zeros(self.blocks)
        for t, w in query.items():
            at = slice(self.starts[t], self.starts[t + 1])
            bound[self.chunk_block[at]] += w * self.chunk_max[at]
        sims, near = np.zeros(0), np.zeros(0, np.int64)
        for b in np.argsort(-bound, kind="stable").tolist():
            # a block that can only tie may still hold an earlier example
            if bound[b] <= 0 or (len(sims) == k and bound[b] < sims[-1] - 1e-8):
                break
            got = np.zeros(BLOCK)
            for t, w in query.items():
                lo, hi = self.starts[t], self.starts[t + 1]
                c = lo + np.searchsorted(self.chunk_block[lo:hi], b)
                if c < hi and self.chunk_block[c] == b:
                    part = slice(self.cuts[c], self.cuts[c + 1])
                    got[self.places[part] - b * BLOCK] += w * self.weights[part]
            got = np.round(got, 9)
            hit = np.flatnonzero(got > 0)
            sims, near = np.append(sims, got[hit]), np.append(near, hit + b * BLOCK)
            best = np.lexsort((near, -sims))[:k]
            sims, near = sims[best], near[best]
        return sims, near


class NearestExamples:
    """The fitted model."""

    def __init__(self, keys: list[int | None], texts: list[str | None], labels: list[int]):
        y = np.array(labels, np.int64)
        seen: dict[str, list[int]] = {}
        for text, label in zip(texts, labels, strict=True):
            here = {t for w in set(WORD.findall((text or "").lower())) for t in terms_of(w)}
            for t in here:
                seen.setdefault(t, [0, 0])[label] += 1
        n = np.bincount(y, minlength=2)[:2]
        self.base = float((n[1] + 0.5) / (n.sum() + 1))
        least = max(1, min(LEAST_DOCS, int(n[1]) // 4))
        chosen = sorted(t for t, (a, b) in seen.items() if b >= least and (b + 0.5) / (n[1] + 1) >= LEAST_LIFT * (a + 0.5) / (n[0] + 1))
        self.vocabulary = Vocabulary(chosen)
        df = np.array([sum(seen[t]) for t in chosen], float)
        self.idf = (np.log((1 + len(y)) / (1 + df)) + 1).tolist()
        vectors = [self.vector(t) for t in texts]
        told = [i for i, v in enumerate(vectors) if v]
        #: what documents without any term come to
        silent = y[[i for i, v in enumerate(vectors) if not v]]
        self.silent = float((silent.sum() + self.base) / (len(silent) + 1))
        self.examples, self.labels = [vectors[i] for i in told], y[told]
        self.keys = np.array([-1 if keys[i] is None else keys[i] for i in told], np.int64)
        self.index = BlockMaxIndex(self.examples, len(chosen))
        self.steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
        if told:
            votes = []
            for i, v in enumerate(self.examples):
                sims, near = self.index.nearest(v, NEIGHBOURS + 1)
                other = near != i
                votes.append(self.vote(sims[other][:NEIGHBOURS], near[other][:NEIGHBOURS]))
            self.steps = isotonic(np.array(votes), self.labels)

    def vector(self, text: str | None) -> dict[int, float]:
        """TF-IDF of the text's terms, of length 1; empty without any."""
        v = {t: (1 + math.log(c)) * self.idf[t] for t, c in sorted(self.vocabulary.counts(text).items())}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    def vote(self, sims: np.ndarray, near: np.ndarray) -> float:
        """Share of label 1 among the neighbours, weighted by distance, with the base rate as one distant vote."""
        weight = 1 / (0.05 + 1 - sims)
        return round(float(((weight * self.labels[near]).sum() + self.base) / (weight.sum() + 1)), 9)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[int]]]:
        out, evidence = np.full(len(texts), self.silent), [[] for _ in texts]
        for i, text in enumerate(texts):
            if len(self.labels) and (v := self.vector(text)):
                sims, near = self.index.nearest(v, NEIGHBOURS)
                out[i] = np.interp(self.vote(sims, near), *self.steps)
                evidence[i] = self.keys[near[:3]].tolist()
        return np.clip(out, 0, 1), evidence


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x (pools of adjacent violators), strictly inside 0 and 1."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1.0, a * 1.0])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, w, m = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w, pools[-1][2] + m]
    return np.array([m / w for _, w, m in pools]), np.array([(s + 0.1) / (w + 0.2) for s, w, _ in pools])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> NearestExamples:
    """Fit on the labelled rows that may be learnt from, at most about ``rows`` of them, in one task."""
    told = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("l_toxic")).where(~held_out(F.col("l_id")))
    n = told.count()
    if n > rows:
        told = told.where(F.pmod(F.xxhash64("l_id"), F.lit(1 << 20)) < int(rows / n * (1 << 20)))
    told = told.groupBy("l_id").agg(F.max("l_toxic").alias("l_toxic"))
    # the sample is bounded by ``rows``, so this side is
    joined = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(told), F.col("id") == F.col("l_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got.sort(key=lambda r: (r[1] or "", r[0]))  # the texts' order, so that ids decide nothing
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(NearestExamples([r[0] for r in got], [r[1] for r in got], [r[2] for r in got]))], pa.binary())], ["model"])

    got = map_batches(joined.select("id", "text", "l_toxic").repartition(1), run, "model binary").first()
    return pickle.loads(got[0]) if got else NearestExamples([], [], [])


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """One row a document: ``doc_id, held_out, score, predicted, evidence`` (doc_ids of the nearest examples).

    Null and empty texts get the score of documents without any term. Repeated rows are scored one by one, an
    empty table gives none, and without labels every score is the neutral base rate. Ties between examples go
    to the text that sorts first. Further columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, evidence = model.value.score(b.column("text").to_pylist())
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "evidence"])

    rows_in = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return map_batches(rows_in, run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")
