"""Slots for models: an embedder, a cross-encoder, and calls whose answers are checked and remembered.

A provider is a plain callable that workers can load. None is a provider too: its columns stay null and what follows falls
back to lexical scores.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrank.functions.scores import CREDIT
from loomrank.operators.board import remembered
from loomrank.streaming.upsert import written


def embedded(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray] | None) -> DataFrame:
    """``key, vector`` with vectors of length 1; null without an encoder or where it fails on a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors: list = [None] * b.num_rows
            if encode is not None and b.num_rows:
                try:
                    got = np.asarray(encode([t or "" for t in b.column(1).to_pylist()]), np.float64)
                    if got.ndim == 2 and len(got) == b.num_rows:
                        vectors = (got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)).tolist()
                except Exception:  # noqa: BLE001  a model that fails costs its scores, never the run
                    pass
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float64()))], [key, "vector"])

    return df.select(F.col(key).cast("string").alias(key), F.col(text).cast("string")).mapInArrow(run, f"{key} string, vector array<double>")


def reranked(df: DataFrame, key: str, text: str, query: str, score: Callable[[str, list[str]], list[float]] | None, chars: int = 1800) -> DataFrame:
    """``key, logit`` of the pool; null where there is no model, it fails, or it answers for another number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list = [None] * b.num_rows
            if score is not None and b.num_rows:
                try:
                    got = list(score(query, [(t or "")[:chars] for t in b.column(1).to_pylist()]))
                    out = [float(x) for x in got] if len(got) == b.num_rows else out
                except Exception:  # noqa: BLE001  as above
                    pass
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], [key, "logit"])

    return df.select(F.col(key).cast("string").alias(key), F.col(text).cast("string")).mapInArrow(run, f"{key} string, logit double")


def answered(rows: DataFrame, memo: DataFrame, call: Callable[[str, str], str], verify: Callable[[str, str], str]) -> tuple[DataFrame, DataFrame]:
    """``key, value, cached`` of ``rows(key, payload)``, and the memo with what is new in it.

    A remembered answer is verified again and used if it holds. Otherwise ``call(payload, feedback)`` is asked, and once
    more with what ``verify(payload, answer)`` found wrong; an answer that fails twice is null and isn't remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, cached = [], []
            for payload, known in zip(b.column("payload").to_pylist(), b.column("value").to_pylist(), strict=True):
                cached.append(known is not None and holds(verify, payload, known))
                values.append(known if cached[-1] else asked_twice(call, verify, payload))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(values, pa.string()), pa.array(cached)], ["key", "value", "cached"])

    known = memo.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    both = rows.select(F.col("key").cast("string").alias("key"), F.col("payload").cast("string").alias("payload")).join(known, "key", "left")
    # written once and used twice: a model is asked once a row, and the memo holds what the result holds
    out = written(both.mapInArrow(run, "key string, value string, cached boolean"))
    fresh = out.where("not cached and value is not null").select("key", "value").dropDuplicates(["key"])
    return out, remembered(known, fresh)


def asked_twice(call: Callable[[str, str], str], verify: Callable[[str, str], str], payload: str) -> str | None:
    wrong = ""
    for _ in range(2):
        try:
            answer = call(payload, wrong)
            wrong = verify(payload, answer)
        except Exception as e:  # noqa: BLE001  a call that fails is a wrong answer
            answer, wrong = None, str(e) or "failed"
        if not wrong:
            return answer
    return None


def holds(verify: Callable[[str, str], str], payload: str, value: str) -> bool:
    try:
        return verify(payload, value) == ""
    except Exception:  # noqa: BLE001  what can't be checked doesn't hold
        return False


def quotes_hold(payload: str, answer: str) -> str:
    """What is wrong with extracted requirements: each quote must stand in the payload, white space aside; empty if nothing is."""
    found = " ".join(payload.split())
    for i, item in enumerate(json.loads(answer)["requirements"], 1):
        quote = " ".join(item["quote"].split())
        if len(quote) < 8 or quote not in found:
            return f"quote {i} is not in the text"
    return ""


def judged_once(payload: str, answer: str) -> str:
    """What is wrong with judgements: each requirement's number must be judged exactly once, with a status that is known."""
    wanted = sorted(json.loads(payload)["requirements"])
    got = json.loads(answer)["judgements"]
    if sorted(x["index"] for x in got) != wanted:
        return "each requirement is to be judged once"
    return "" if all(x["status"] in CREDIT for x in got) else "unknown status"
