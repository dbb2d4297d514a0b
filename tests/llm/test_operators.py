"""The ten operators against brute force, libraries and exact round trips, on a table with every awkward row."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from loomrank.llm import flac, html_text, langid, linededup, packing, piece, quality, simhash, tokenbin, toxicity
from loomrank.llm.common import components

WORDS = "the of and to in that is for on with as was be by are from this have not which one all were".split()
BASE = " ".join(WORDS[i * i % len(WORDS)] + str(i % 11) for i in range(120))
ROWS = [
    (0, BASE, "en", "a"), (1, BASE, "en", "a"), (2, BASE.replace("the0", "The0", 1) + " x", "en", None), (3, None, None, "b"), (4, "", "en", "b"), (5, "  \n\t ", "en", "b"),
    (6, "one", "fr", "c"), (7, "Ünïcode 中文 🎉 mit Worten.\nzweite Zeile\nzweite Zeile", "de", "c"), (None, "no id here at all", "en", "a"), (9, "long " * 30_000, "en", "a"), (9, "same id, other text", "en", "a"), (1, BASE, "en", "a"),
]
EXTRA = [(*r, 5, "clash") for r in ROWS]
SCHEMA = "doc_id long, text string, lang string, source string, score int, fp string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EXTRA, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 0), (6, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    got = simhash.simhash_components(docs).collect()
    fp = [brute_fingerprint(r[1]) for r in ROWS]
    assert sorted((r.doc_id or -1, r.fp % (1 << 64)) for r in got) == sorted((r[0] or -1, f) for r, f in zip(ROWS, fp, strict=True))
    root = list(range(len(fp)))
    for _ in fp:
        root = [min(root[j] for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= 3) for i in range(len(fp))]
    for r in got:
        same = {ROWS[j][0] for j in range(len(fp)) if root[j] == root[fp.index(r.fp % (1 << 64))]}
        assert r.component_id == min((x for x in same if x is not None), default=None)
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))


def test_bit_sliced_links_are_those_of_brute_force():
    rng = np.random.default_rng(5)
    near = [int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 5)))) for b in rng.integers(0, 2**63, 60) for _ in range(5)]
    fp = np.unique(np.array(near, np.uint64))
    a, b = simhash.spanning_links(fp, np.array([0]), 3)
    parent = {int(x): int(x) for x in fp}

    def root(p, x):
        while p[x] != x:
            x = p[x]
        return x

    other = dict(parent)
    for x in map(int, fp):
        for y in map(int, fp):
            if (x ^ y).bit_count() <= 3:
                u, v = root(parent, x), root(parent, y)
                parent[max(u, v)] = min(u, v)
    for x, y in zip(map(int, a), map(int, b), strict=True):
        u, v = root(other, x), root(other, y)
        other[max(u, v)] = min(u, v)
    assert all(root(parent, x) == root(other, x) for x in parent)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 9), (20, 21), (5, 5)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 20: 20, 21: 20}
    assert components(edges.where("a < 0")).count() == 0


def test_sentencepiece(docs, empty):
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r, (_, text, *_) in zip(piece.piece_round_trip(docs.coalesce(1), path, with_ids=True).collect(), ROWS, strict=True):
        ids = sp.encode(text or "")
        assert (r.n_tokens, r.ids, r.ids_sha256) == (len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert piece.piece_round_trip(empty, path).count() == 0
    bpe, rng = piece.model_for(path), np.random.default_rng(3)
    for _ in range(300):
        text = "".join(rng.choice(list("ab ▁ \n\té中🎉<s>aaaa  th"), rng.integers(0, 50)))
        ids = rng.integers(0, 600, 9).tolist()
        assert bpe.encode(text) == sp.encode(text) and bpe.decode(ids) == sp.decode(ids)


def test_toxicity(spark, docs, empty, labels):
    words = np.random.default_rng(0)
    rows = [(i, " ".join(words.choice(WORDS, 40)) + (" grobian" if i % 9 == 0 else "")) for i in range(400)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame([(i, int(i % 9 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(many, told).collect()
    assert all(r.predicted == int(r.doc_id % 9 == 0) and 0 <= r.score <= 1 for r in got)
    model = toxicity.NearestExamples([i for i, _ in rows], [t for _, t in rows], [int(i % 9 == 0) for i, _ in rows])
    for _, text in rows:
        v = model.vector(text)
        sims, near = model.index.nearest(v, 5)
        full = [round(sum(w * e.get(t, 0.0) for t, w in v.items()), 9) for e in model.examples]
        best = [j for j in sorted(range(len(full)), key=lambda j: (-full[j], j)) if full[j] > 0][:5]
        assert near.tolist() == best and np.allclose(sims, [full[j] for j in best], atol=2e-9)
    assert toxicity.toxicity_scores(docs, labels).count() == len(ROWS)
    assert toxicity.toxicity_scores(docs, labels.where("toxic > 1")).count() == len(ROWS)
    assert toxicity.toxicity_scores(empty, labels).count() == 0


def test_token_files(spark, docs, empty):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    folder = tokenbin.write_tokens(docs, path)
    got = sorted(tokenbin.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in ROWS), key=lambda x: -1 if x is None else x)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = Counter((d, zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for d, x, *_ in ROWS)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    found = {r.doc_id: r.ids for r in tokenbin.lookup(spark, folder, spark.createDataFrame([(7,), (6,), (777,)], "doc_id long")).collect()}
    assert found == {i: t.encode(dict((r[0], r[1]) for r in ROWS)[i], add_special_tokens=False).ids + [1] for i in (6, 7)}
    assert tokenbin.read_tokens(spark, tokenbin.write_tokens(empty, path)).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64))
    h = tokenbin.PerfectHash.load(tokenbin.PerfectHash.build(keys).dump())
    assert sorted(h.slots(keys)) == list(range(len(keys)))


def test_language(spark, docs, empty):
    kinds = {"aa": "lo mi na ", "bb": "xu qe wo ", "cc": "sch ung tz "}
    rows = [(i, kinds[k] * 8 + str(i), k) for i, k in enumerate(list(kinds) * 60)]
    got = langid.language_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] and 0 <= r.score <= 1 for r in got) and any(r.held_out for r in got)
    mine = langid.language_scores(docs).collect()
    assert len(mine) == len(ROWS) and {r.lang_pred for r in mine if r.doc_id in (3, 4, 5)} == {"und"}
    kept = langid.keep_language(docs)
    assert kept.columns == docs.columns and kept.count() == sum(bool(re.search(r"[^\W\d_]", r[1] or "")) for r in ROWS)
    assert langid.language_scores(empty).count() == 0


def test_html(spark):
    maker = html_text.PageMaker(77)
    made = [maker.page() for _ in range(60)]
    net = html_text.trained()
    found = [html_text.leaves(p) for p, _ in made]
    right = [(q >= 0.5) == np.array(y) for q, (_, y) in zip(net.label([html_text.vectors(x) for x in found]), made, strict=True)]
    assert np.concatenate(right).mean() > 0.97
    page = '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>T &amp; U</h1><p><b>First  one.<br><p>Second\n one.</article><footer>&copy; x</footer>'
    rows = html_text.main_text(spark.createDataFrame([(1, "u", page, 3), (2, None, None, 3), (3, "v", "", 3)], "page_id long, url string, html string, text int")).orderBy("page_id").collect()
    assert [r.text for r in rows] == ["T & U\n\nFirst one.\n\nSecond one.", "", ""] and rows[0].n_chars == len(rows[0].text)


def test_quality(docs, empty, labels):
    got = quality.quality_report(docs, labels).collect()
    by = Counter()
    for d, text, *_ in ROWS:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(grams)
        hit = len({i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)})
        by[d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), hit, len(w) < 50 or 2 * hit > len(w)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == by
    assert all(not (r.kept and r.base_failed) for r in got) and {r.doc_id for r in got if r.kept} == {0, 1, 2}
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.quality_report(empty, labels).count() == 0
    assert quality.quality_report(docs, labels.where("quality > 1")).count() == len(ROWS)


def test_lines(spark, docs, empty):
    a = "the quick brown fox jumps over the lazy dog near the old river bank " * 3
    rows = [(1, a + "\nown line of one\n\n"), (2, "Own  line of ONE\n" + a + "\nlast"), (3, a.replace("lazy", "lazi", 1).strip()), (4, None), (5, "")]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "last" and got[2].n_removed == 2 and got[4].text is None and got[5].text == ""
    assert got[3].text == ""
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert linededup.dedup_lines(empty).count() == 0


def test_line_simhash(docs):
    for r in linededup.with_simhash(linededup.exploded(docs)).select("words", "sim").collect():
        first = [xxhash.xxh64_intdigest(w.encode(), 42) for w in r.words]
        # pairs of neighbouring words; a word alone where there is one
        h = [xxhash.xxh64_intdigest(w.encode(), f) for w, f in zip(r.words[1:], first, strict=False)] or first
        assert r.sim % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_flac(docs, empty):
    media = flac.to_media(docs)
    for r in flac.media_features(media).collect():
        texts = [x[1] for x in ROWS if x[0] == r.doc_id]
        options = [flac.payload_of(t) for t in texts]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.n_bytes) in {(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), n) for p, n in options}
    assert flac.pcm_blocks(media).groupBy("doc_id").sum("n_samples").count() == len({r[0] for r in ROWS})
    assert flac.media_features(flac.to_media(empty)).count() == 0


@pytest.mark.parametrize("order", [0, 8])
def test_flac_samples_and_faults(order):
    rng = np.random.default_rng(2)
    x = (np.sin(np.arange(15_000) / 30) * 9000 + rng.normal(0, 50, 15_000)).astype(np.int16)
    m = flac.encode(x, 16, order)
    assert (flac.decode_all([m])[0] == x).all() and (flac.decode_range(m, 5000, 6000) == x[5000:11000]).all() and len(m) < x.nbytes
    bad = bytearray(m)
    bad[len(bad) // 2] ^= 1
    with pytest.raises(flac.BadFlac):
        flac.decode_all([bytes(bad)])


def test_packing(docs, empty):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, with_ids=True, sequence=64, window_sequences=4).collect()
    lengths = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths[r.sequence_id] and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        lengths[r.sequence_id] += r.length
    assert all(lengths[i] == 64 for i in range(len(lengths) - 1))
    single = {d: x for d, x, *_ in ROWS if [r[0] for r in ROWS].count(d) == 1}
    for d, text in single.items():
        ids = [i for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start) for i in r.ids]
        assert ids == t.encode(text or "", add_special_tokens=False).ids + [0]
    assert packing.pack_documents(empty, path).count() == 0


def test_mixture_is_exact():
    for totals, weights in (([1000, 300, 7, 555, 1], None), ([1000, 300, 7, 555, 1], [1, 1, 1, 5, 2])):
        mix = packing.Mixture(totals, weights)
        served = [mix.served(k * 40) for k in range(60)]
        assert all(sum(s) == min(mix.total, 40 * k) for k, s in enumerate(served))
        assert all(b >= a for x, y in zip(served, served[1:], strict=False) for a, b in zip(x, y, strict=True))


def test_alike(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(150):
        a = "".join(rng.choice("abc é") for _ in range(rng.randint(1, 90)))
        b = list(a)
        for _ in range(rng.randint(0, 25)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        rows.append((a, "".join(b)))

    def distance(a, b):
        row = range(len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for r in spark.createDataFrame(rows, "x string, y string").withColumn("ok", linededup.alike("x", "y", 0.8)).collect():
        assert r.ok == (distance(r.x, r.y) <= int(0.2 * max(len(r.x), len(r.y)) + 1e-9))


def test_separators_are_no_words_of_a_line(spark):
    rows = [(i, " | ".join(f"{w}{i}" for w in ("alpha", "beta", "gamma", "delta"))) for i in range(40)] + [(99, "- - - - - - - - - - - -"), (100, "- - - - - - - - - - - -")]
    lines = linededup.exploded(spark.createDataFrame(rows, "doc_id long, text string"))
    words = {r.doc_id: r.w for r in lines.select("doc_id", linededup.telling(lines.words).alias("w")).collect()}
    assert words[3] == ["alpha3", "beta3", "gamma3", "delta3"] and words[99] == ["-"] * 12
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "" and got[99] == rows[40][1]
