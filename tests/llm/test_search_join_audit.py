"""Lexical search, metric join and source divergence against brute force, with nulls, ties, repeats and hot groups."""

import itertools
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrank.llm import divergence, lexsearch, metricjoin, queries

SF = "/root/testdata/sf0.001"


def same(rows):
    return sorted(map(repr, rows))


# ---- lexical search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=20):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, size = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms_of(text)), []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // size
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, r in asked.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return out


def made_docs(n, seed):
    rng = np.random.default_rng(seed)
    words = ["w%d" % i for i in range(60)] + ["Été", "naïve", "B2B"]
    weights = 1 / np.arange(1, len(words) + 1)
    return [(int(i), " ".join(rng.choice(words, int(rng.integers(1, 60)), p=weights / weights.sum()))) for i in range(n)]


def test_search_equals_brute_force(spark):
    docs = made_docs(700, 1) + [(5, "w3 w4"), (5, "w3 w4"), (None, "w3 w4"), (9001, None), (9002, ""), (9003, " -- "), (9004, "É w1 " * 3000), (9005, "same same"), (9006, "same same"), (9007, "x" * 2_000_000 + " w7")]
    items = [(1, "w3 W4 w3, été b2b"), (2, None), (3, "..."), (4, "same"), (4, "same"), (None, "w50 naïve É"), (6, "nowhere"), (7, "w7 " * 400_000)]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, no int").repartition(5)
    i = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    got = lexsearch.lexical_search(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert same(tuple(r) for r in got.collect()) == same(ranked(docs, items))


def test_search_of_nothing(spark):
    d, i = spark.createDataFrame(made_docs(5, 2), "doc_id long, text string"), spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexsearch.lexical_search(d.limit(0), i).count() == 0 and lexsearch.lexical_search(d, i.limit(0)).count() == 0
    assert lexsearch.lexical_search(d, i, k=2).count() == 2


def test_boundaries_are_the_best_for_their_number():
    rng = np.random.default_rng(3)
    g = lexsearch.GRANULE
    lists = [rng.integers(1, 100, n) for n in (1, 7, 8, 9, 40, 55, 64)]
    starts = np.cumsum([0] + [len(x) for x in lists[:-1]])
    cuts = lexsearch.boundaries(np.concatenate(lists), starts)
    for x, at in zip(lists, starts.tolist(), strict=True):
        mine = [c - at for c in cuts.tolist() if at <= c < at + len(x)]
        assert mine[0] == 0 and all(c % g == 0 for c in mine)
        error = lambda begins: sum(len(x[a:b]) * x[a:b].max() - x[a:b].sum() for a, b in zip(begins, [*begins[1:], len(x)], strict=True))  # noqa: B023, E731
        others = (list((0, *c)) for c in itertools.combinations(range(g, len(x), g), len(mine) - 1))
        assert error(mine) == min(map(error, others))


def test_blocks_are_skipped_and_ties_kept():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n = 6000
    tf = np.where(rng.random(n) < 0.01, 50, 1)
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, 100)), pa.array([np.array([0], np.int32).tobytes()] * n), pa.array([np.array([x], np.int64).tobytes() for x in tf.tolist()])], ["doc_id", "n", "terms", "tfs"])
    shard = lexsearch.Shard([rows], np.array([500]), n, 100 * n)
    s, i = shard.search(np.array([0]), np.array([1]), 20, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert i.tolist() == np.flatnonzero(tf == 50)[:20].tolist() and len(set(s.tolist())) == 1
    assert shard.opened < shard.asked / 2


# ---- metric join


def links(rows, cosine=0.95):
    n = len(rows)
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    units = [np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) if g else None for (_, v), g in zip(rows, good, strict=True)]
    parent, count = list(range(n)), [0] * n

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(n):
        for b in range(a):
            if good[a] and good[b] and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= cosine:
                count[a], count[b] = count[a] + 1, count[b] + 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    name = defaultdict(list)
    for i in range(n):
        if rows[i][0] is not None:
            name[root(i)].append(rows[i][0])
    least = {r: min(x) for r, x in name.items()}
    return [(rows[i][0], count[i], least.get(root(i)), rows[i][0] is not None and rows[i][0] == least.get(root(i))) for i in range(n)]


@pytest.mark.parametrize("dims", [3, 8, 24])
def test_join_equals_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    hot = rng.normal(size=dims)
    vectors = [rng.normal(size=dims) for _ in range(150)]  # in three dimensions cells overlap and many lie at the limit
    vectors += [hot + rng.normal(size=dims) * 0.05 for _ in range(120)] + [hot + rng.normal(size=dims) * 0.25 for _ in range(60)] + [vectors[0]] * 30 + [vectors[1] * 7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * dims), (1003, [math.nan] + [1.0] * (dims - 1)), (1004, [None] + [1.0] * (dims - 1)), (1005, [math.inf] + [1.0] * (dims - 1)), (None, rows[0][1]), (3, rows[4][1]), (1006, [1.0]), (1007, [2.0]), (1008, [-2.0]), (1009, [1e300] + [0.0] * (dims - 1)), (1010, [1e-300] + [0.0] * (dims - 1)), (None, None)]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, kept string, label int").repartition(3)
    got = metricjoin.near_vectors(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert same(tuple(r) for r in got.collect()) == same(links(rows))


def test_parts_of_a_cell_and_cores(spark, monkeypatch):
    """Cells in parts of 20 vectors: who hosts whom, and cores whose members are never compared."""
    monkeypatch.setattr(metricjoin, "CELL_ROWS", 20)
    rng = np.random.default_rng(5)
    centre = [rng.normal(size=16) for _ in range(3)]
    rows = [(i, (centre[i % 3] + rng.normal(size=16) * (0.04, 0.16, 0.3)[i % 3]).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert same(tuple(r) for r in metricjoin.near_vectors(df).collect()) == same(links(rows))
    assert metricjoin.near_vectors(df.limit(0)).count() == 0


def test_meeting_places():
    a, b = np.meshgrid(np.arange(40), np.arange(40))
    once = metricjoin.hosts(a, b) ^ metricjoin.hosts(b, a)
    assert once[a != b].all()
    share = [(metricjoin.hosts(np.full(40, c), np.arange(40)) & (np.arange(40) != c)).sum() for c in range(40)]
    assert min(share) >= 18 and max(share) <= 21


# ---- divergence


def diverged(docs, least, top):
    held, groups = defaultdict(Counter), set()
    df = Counter()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        t = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        held[lang, source].update(t)
        df.update((lang, x) for x in set(t))
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for x, s in groups if x == lang)
        kept = [t for (x, t), n in df.items() if x == lang and n >= least]
        v = len(kept)
        total = {s: sum(held[lang, s][t] for t in kept) for s in sources}
        share = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * v)  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {(s, t): share(held[lang, s][t], total[s]) for s in sources for t in kept}
        q = {t: share(sum(held[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pair = [(-sum(f(p[s, t], p[o, t]) for t in kept), o) for o in sources if o != s]
            term = [(-f(p[s, t], q[t]), t) for t in kept if held[lang, s][t] and p[s, t] > q[t]]
            for part, rows in (("pair", sorted(pair)), ("term", sorted(term, key=lambda r: (r[0], r[1].encode()))[:top])):
                out += [(lang, s, part, x[1], -x[0], i) for i, x in enumerate(rows, 1)]
    return out


def test_divergence_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    words = ["alpha", "Beta", "gamma", "ñu", "été", "zz", "one", "ONE", "d4d"]
    docs = [(" ".join(rng.choice(words, 12)), ["en", "de", None][i % 3], ["a", "b", None, "", "c"][i % 5] if i % 7 else "a") for i in range(200)]
    docs += [(None, "en", "empty"), ("", "xx", "only"), ("once", "yy", "p"), ("twice", "yy", "q"), ("a b", "zz", "s"), ("1 2 3", "zz", "t"), ("a " * 300_000, "zz", "s"), ("same words here", "en", "a"), ("same words here", "en", "a")]
    df = spark.createDataFrame([(*d, "x", 2) for d in docs], "text string, lang string, source string, term string, n int").repartition(4)
    for least, top in ((10, 10), (2, 3)):
        assert same(tuple(r) for r in divergence.source_divergence(df, least, top).collect()) == same(diverged(docs, least, top))
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_counts_beyond_a_batch_are_added_up(spark, monkeypatch):
    """A task that must give up its counts before the end loses none."""
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD_ROWS", 5)
    rows = [pa.RecordBatch.from_pydict({"lang": ["l"] * 3, "source": ["s"] * 3, "text": [f"a{chr(97 + i)} b{chr(97 + i)} c", "c c", ""]}) for i in range(8)]
    n = Counter()
    for b in divergence.counted(iter(rows)):
        for r in b.to_pylist():
            n[r["term"], "n"] += r["n"]
            n[r["term"], "docs"] += r["docs"]
    assert n["c", "n"] == 24 and n["c", "docs"] == 16 and sum(v for (_, k), v in n.items() if k == "n") == 40


@pytest.mark.parametrize("name", ["op11_lexical_search", "op13_divergence"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, other = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert same(tuple(r) for r in df.select(*other.columns).collect()) == same(other.fetchall())


def test_the_whole_table_is_joined(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert same(tuple(r) for r in queries.QUERIES["op12_metric_join"](spark, SF).collect()) == same(links(rows))
    assert df.where(F.col("vec_id") < 0).count() == 0


# ---- names that clash, streams without a seek table


def test_clashing_names_come_back_as_they_were(spark):
    from loomrank.llm import quality, simhash

    text = "one two three four five six seven eight nine ten eleven twelve " * 6
    rows = [(i, text if i < 2 else f"{text} and {i} others of their own kind " + " ".join(f"w{i}x{j}" for j in range(60)), 7, 8, 9, {"a": "b"}) for i in range(4)] + [(0, text, 1, 8, 9, {"a": "b"})]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id int, __th int, __q_words int, __q_kept map<string,string>")
    got = simhash.drop_similar(df)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == {0, 2, 3} and got.schema == df.schema
    assert simhash.drop_near_duplicates(df).count() == 3
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_quality(df, labels, threshold=-100.0)
    assert kept.schema == df.schema and all(r["__q_words"] == 9 and r["__q_kept"] == {"a": "b"} for r in kept.collect())
    assert quality.keep_quality(df.limit(0), labels).count() == 0 and simhash.drop_similar(df.limit(0)).count() == 0


def test_frames_are_found_without_a_seek_table():
    from loomrank.llm import flac

    rng = np.random.default_rng(8)
    x = np.cumsum(rng.integers(-3, 4, 20_000)).astype(np.int16)
    x[5000:5100] = -8  # bytes that look like a sync code
    m = flac.encode(x, 16)
    at, blocks = 4, []
    while True:
        last, kind, size = m[at] & 0x80, m[at] & 0x7F, int.from_bytes(m[at + 1 : at + 4], "big")
        blocks.append((kind, m[at + 4 : at + 4 + size]))
        at += 4 + size
        if last:
            break

    def stream(metadata):
        parts = [bytes([kind | (0x80 if i + 1 == len(metadata) else 0)]) + len(b).to_bytes(3, "big") + b for i, (kind, b) in enumerate(metadata)]
        return b"fLaC" + b"".join(parts) + m[at:]

    bare = stream([b for b in blocks if b[0] != 3])
    sparse = stream([(k, b[:18] if k == 3 else b) for k, b in blocks])
    for s in (bare, sparse):
        assert (flac.decode_all([s])[0] == x).all() and (flac.decode_range(s, 9000, 3000) == x[9000:12000]).all()
        assert len(flac.decode_range(s, 30_000, 5)) == 0
    with pytest.raises(flac.BadFlac):
        flac.read_header(bare[:-50])
