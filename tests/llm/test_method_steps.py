"""Steps of the named methods run in the queries themselves."""

import hashlib
import random

import corpus_pipeline
import numpy as np
from loomrank.llm import flac, queries, simhash

SF = "/root/testdata/sf0.001"


def test_streams_have_general_predictors_and_come_back_as_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    media = [bytes(r.media) for r in flac.to_media(docs).collect()]
    kinds = [flac.open_frame(np.frombuffer(m + bytes(8), np.uint8), p[1], [*[q[1] for q in h.points], len(m)][i + 1], 8) for m in media for h in [flac.read_header(m)] for i, p in enumerate(h.points)]
    assert sum(f.coefs is not None for f in kinds) > len(kinds) / 2
    blocks = flac.stored_blocks(docs)
    assert all("loomrank-" in f for f in queries.op9_flac(spark, SF).inputFiles())
    texts = sorted(flac.payload_of(r.text)[0] for r in docs.collect())
    found = [r.blocks for r in blocks.collect()]
    assert sorted((np.frombuffer(b"".join(bytes(b.pcm) for b in bs), np.uint8) ^ 0x80).tobytes() for bs in found) == texts
    assert all(b.sample_offset == i * flac.BLOCK and b.n_samples == len(b.pcm) for bs in found for i, b in enumerate(bs))
    at = {hashlib.sha256(m).hexdigest(): [p[1] for p in flac.read_header(m).points] for m in media}
    assert all(at[r.media_sha256] == [b.byte_offset for b in r.blocks] for r in blocks.collect())


def test_general_predictors_of_many_frames_are_undone_together():
    rng = np.random.default_rng(4)
    x = [np.cumsum(rng.integers(-9, 10, n)).astype(np.int16) for n in (1, 7, 40, 700, 5000, 9001)]
    m = [flac.encode(v, 16, order) for v in x for order in (0, 3, 8, 12)]
    assert all((a == b).all() for a, b in zip(flac.decode_all(m), [v for v in x for _ in range(4)], strict=True))


def test_near_duplicate_stage_compares_fingerprints_bit_sliced(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for _ in range(12):
        w = [word() for _ in range(600)]
        texts += [" ".join(w), " ".join([*w[:-1], word()])]
    docs = spark.createDataFrame([*enumerate(texts), (90, "a b"), (91, "A b"), (92, None), (93, " ")], "doc_id long, text string")
    found = []

    def seen(*args, kept=simhash.sliced_links, **more):
        found.append(kept(*args, **more))
        return found[-1]

    monkeypatch.setattr(simhash, "sliced_links", seen)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()}
    assert kept == {*range(0, 24, 2), 90, 92}
    assert found[0].count() >= 8  # most pairs lie within the radius; the bands find the others
    shingled = {simhash.fingerprint(t, 5) for t in ("a b", "A b")}
    assert len(shingled) == 1
