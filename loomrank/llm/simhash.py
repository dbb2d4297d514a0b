"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints of 64 bits come from hashed word shingles. Distinct fingerprints are dealt into pigeonhole
buckets (any two within the radius agree on at least one key), and each bucket is compared bit-sliced: the
bits of 64 fingerprints lie in one machine word a bit position, distances grow in carry-save counters, and
blocks of 64 are abandoned once every lane has passed the radius. A bucket sends on a spanning forest of its
links only. Components are found by distributed star rounds.

Shingle similarity reaches further than pigeonholes can: at a Jaccard similarity of 0.8 fingerprints differ in 8 bits,
often in 13. ``drop_similar`` therefore checks the links of the bit-sliced comparison by their shingles, then buckets what they leave
apart by bands of minima, keeps pairs within a wide radius and compares their shingles too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrank.llm.common import components, map_batches, materialise, unused

#: Bucket members compared in one task at most; larger buckets are dealt into pairs of tiles.
TILE = 4096
#: Mean bucket size above which keys with more bits (and more tables) are taken.
MEAN_BUCKET = 64
#: (query, word) pairs compared at once.
PAIRS = 1 << 19
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bands of ROWS minima each: at a similarity of 0.8 all 16 differ for 2 pairs in 10,000.
BANDS, ROWS = 16, 4
#: Bits that fingerprints of similar documents may differ in (20 at most among 1,050 made pairs of similarity 0.82 to 0.91).
WIDE = 24
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
MIXERS = np.random.default_rng(12).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """Hashes of one text's word shingles: words are runs without ASCII white space, A-Z lower-cased; no word gives none."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, "<u8")
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.array([digest(g, seed) for g in grams], dtype="<u8")


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of one text; no word gives 0."""
    return simhash_of(shingles(text, words, seed))


def simhash_of(h: np.ndarray) -> int:
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 255):
        counts += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, th, fp)`` of every row: the text's hash, and its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words, seed) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("th")), run, "doc_id long, th long, fp long")


def text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def key_masks(n: int, radius: int) -> list[int]:
    """Bit masks of the pigeonhole keys: with m blocks two fingerprints within the radius agree on m - radius of them.

    m is the least for which n evenly spread fingerprints share a key MEAN_BUCKET times on average at most.
    """
    for m in range(radius + 1, radius + 6):
        cuts = [64 * i // m for i in range(m + 1)]
        blocks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(m)]
        masks = [sum(c) for c in combinations(blocks, m - radius)]
        if n / 2 ** min(bin(x).count("1") for x in masks) <= MEAN_BUCKET:
            break
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_bits(planes: np.ndarray, bits: np.ndarray, qi: np.ndarray, wi: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For pairs (query, word of 64 lanes): the pairs left and the lanes within the radius.

    ``planes[b, w]`` holds bit b of the 64 members of word w; ``bits[b, q]`` is all ones where query q has bit b.
    """
    width = (radius + 1).bit_length()
    counters = [np.zeros(len(qi), np.uint64) for _ in range(width)]
    over = np.zeros(len(qi), np.uint64)
    # a counter that starts at 2**width - 1 - radius overflows exactly when a distance passes the radius
    for k in range(width):
        if (2**width - 1 - radius) >> k & 1:
            counters[k] |= ALL
    for b in range(64):
        carry = planes[b][wi] ^ bits[b][qi]
        for k in range(width):
            c = counters[k]
            counters[k], carry = c ^ carry, c & carry
        over |= carry
        if b % 8 == 7:
            live = over != ALL
            if not live.all():
                qi, wi, over = qi[live], wi[live], over[live]
                counters = [c[live] for c in counters]
                if not len(qi):
                    break
    yield qi, wi, ~over


def spanning_links(fp: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within the radius inside each run of ``fp`` (runs begin at ``starts``)."""
    sizes = np.diff(np.append(starts, len(fp)))
    keep = np.repeat(sizes > 1, sizes)
    fp, sizes = fp[keep], sizes[sizes > 1]
    n = len(fp)
    label = np.arange(n)
    if not n:
        return fp, fp
    words = -(-sizes // 64)
    first_word, first = np.cumsum(words) - words, np.cumsum(sizes) - sizes
    run = np.repeat(np.arange(len(sizes)), sizes)
    lane = np.arange(n) - first[run]
    slot = first_word[run] * 64 + lane
    padded, member = np.zeros(words.sum() * 64, np.uint64), np.full(words.sum() * 64, -1)
    padded[slot], member[slot] = fp, np.arange(n)
    planes = np.stack([np.packbits((padded >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8") for b in range(64)])
    bits = np.stack([(np.uint64(0) - (fp >> np.uint64(b) & np.uint64(1))) for b in range(64)])
    per = words[run]
    ends = np.cumsum(per)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        p = per[at:to]
        qi = np.repeat(np.arange(at, to), p)
        wi = np.repeat(first_word[run[at:to]], p) + np.arange(len(qi)) - np.repeat(np.cumsum(p) - p, p)
        for q, w, near in near_bits(planes, bits, qi, wi, radius):
            for i in range(0, len(q), 1 << 15):
                pair, which = np.nonzero(np.unpackbits(near[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                a, b = q[i : i + (1 << 15)][pair], member[w[i : i + (1 << 15)][pair] * 64 + which]
                a, b = a[b >= 0], b[b >= 0]
                x, y = label[a], label[b]
                cross = x < y
                if cross.any():
                    label = joined(label, np.unique(np.stack([x[cross], y[cross]], 1), axis=0))
        at = to
    moved = label != np.arange(n)
    return fp[moved], fp[label[moved]]


def joined(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """``label`` after its classes are united along ``pairs`` of class labels."""
    parent = np.arange(len(label))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, y in pairs.tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    while (parent != parent[parent]).any():
        parent = parent[parent]
    return parent[label]


def links(fps: DataFrame, n: int, radius: int = 3) -> DataFrame:
    """``(a, b)``: links that connect all distinct fingerprints ``fps(fp)`` within the radius of each other."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(key_masks(n, radius))])
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    counts = dealt.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    dealt = dealt.join(counts, ["t", "key"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    dealt = dealt.select("t", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    dealt = dealt.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def emit(cols: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
            a, b = spanning_links(cols[4].view(np.uint64), starts, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def begun(cols: list[np.ndarray]) -> np.ndarray:
            new = np.zeros(len(cols[0]), bool)
            new[:1] = True
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            return np.flatnonzero(new)

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)] if held else cols
            starts = begun(held)
            if len(starts) > 1 and len(held[0]) >= 1 << 14:
                cut = starts[-1]
                yield emit([c[:cut] for c in held], starts[:-1])
                held = [c[cut:] for c in held]
        if held and len(held[0]):
            yield emit(held, begun(held))

    return map_batches(dealt, run, "a long, b long")


def near_groups(rows: DataFrame, radius: int = 3) -> DataFrame:
    """``(fp, root, group_doc)`` for each distinct fingerprint of ``rows(doc_id, fp)``: its component and the least doc_id there."""
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    n = fps.count()
    roots = components(links(fps, n, radius)).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("group_doc"))
    return rooted.join(least, "root").select("fp", "root", "group_doc")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row a document: ``doc_id, fp, component_id`` (least doc_id reachable over links within the radius).

    Null and blank texts have fingerprint 0 and link like any other; a null doc_id takes part and names a
    component only where all its ids are null; repeated rows come back repeated; an empty table gives none.
    Only ``doc_id`` and ``text`` are read, so further columns can't clash.
    """
    rows = materialise(fingerprints(docs, words, seed).select("doc_id", "fp"))
    return rows.join(near_groups(rows, radius), "fp").select("doc_id", "fp", F.col("group_doc").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id, and of several such the least text hash.

    The decision moves as (doc_id, text hash) only; the texts are shuffled once, to meet it. Rows that repeat
    in full count as one document, of which one stays. Columns come back as they were.
    """
    rows = materialise(fingerprints(docs, words, seed))
    groups = near_groups(rows, radius)
    kept = rows.join(groups, "fp").where(F.col("doc_id").eqNullSafe(F.col("group_doc"))).groupBy("root", F.col("doc_id").alias("__id")).agg(F.min("th").alias("__th"))
    return only(docs, kept.select("__id", "__th"))


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``kept(__id, __th)`` names; of those that share id and text the one whose other columns hash least."""
    a, b, n = unused(docs, "kept_id", "kept_th", "copy")
    out = docs.join(kept.select(F.col("__id").alias(a), F.col("__th").alias(b)), F.col("doc_id").cast("long").eqNullSafe(F.col(a)) & (text_hash() == F.col(b)))
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    one = Window.partitionBy(a, b).orderBy(F.xxhash64(*plain))
    return out.withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def bands_of(h: np.ndarray) -> np.ndarray:
    """A hash a band of the minima of a set of shingle hashes; of no shingle all zero."""
    if not len(h):
        return np.zeros(BANDS, np.int64)
    least = np.full(BANDS * ROWS, ALL)
    for i in range(0, len(h), 2048):
        least = np.minimum(least, ((h[i : i + 2048, None] ^ MIXERS) * FACTORS).min(0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes()) for b in least.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def sketches(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """``doc_id, th, fp, n, bands`` of every row; n is the number of different shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, n, bands = [], [], []
            for t in b.column("text").to_pylist():
                h = shingles(t, words, seed)
                fp.append(simhash_of(h))
                h = np.unique(h)
                n.append(len(h))
                bands.append(bands_of(h))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array([x.tolist() for x in bands], pa.list_(pa.int64()))], ["doc_id", "th", "fp", "n", "bands"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("th")), run, "doc_id long, th long, fp long, n long, bands array<long>")


def similar(pairs: DataFrame, docs: DataFrame, words: int, seed: int, similarity: float) -> DataFrame:
    """The ``(a, b)`` of text hashes whose sets of shingles have the Jaccard similarity, compared in full."""
    pairs = materialise(pairs)
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.col("a").alias("th")).union(pairs.select(F.col("b").alias("th"))).distinct()
    texts = docs.select(F.col("text").cast("string").alias("text"), text_hash().alias("th")).join(ends, "th", "left_semi").dropDuplicates(["th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingles(t, words, seed)).view(np.int64) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("th"), pa.array(sets, pa.list_(pa.int64()))], ["th", "grams"])

    sets = materialise(map_batches(texts, run, "th long, grams array<long>"))
    both = pairs.join(sets.select(F.col("th").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("th").alias("b"), F.col("grams").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return materialise(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"))


def sliced_links(distinct: DataFrame, docs: DataFrame, words: int, seed: int, similarity: float, radius: int = 3) -> DataFrame:
    """Verified links among the texts ``distinct(th, fp, n)`` whose fingerprints lie within the radius.

    The bit-sliced comparison gives links that connect all such fingerprints, each of which stands for one of its texts;
    its other texts meet that one. A link counts only where the shingles of its two texts have the Jaccard similarity.
    """
    leads = materialise(distinct.groupBy("fp").agg(F.min("th").alias("lead")))
    near = links(leads.select("fp"), leads.count(), radius)
    of = lambda c: leads.select(F.col("fp").alias(c), F.col("lead").alias(f"{c}_lead"))
    across = near.join(of("a"), "a").join(of("b"), "b").select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b"))
    within = distinct.join(leads, "fp").where("th <> lead").select(F.col("lead").alias("a"), F.col("th").alias("b"))
    return similar(across.unionByName(within).distinct(), docs, words, seed, similarity)


def similar_links(distinct: DataFrame, docs: DataFrame, words: int, seed: int, similarity: float) -> DataFrame:
    """Verified links that connect all similar texts of ``distinct(th, fp, n, bands)`` which share a band or have near fingerprints.

    ``sliced_links`` come first; what they connect isn't compared again. Then each text meets the leader of each of its buckets, then those of its bucket that are outside the bucket's
    commonest component and not in its own: a bucket full of copies costs its size, and no pair that matters is left out.
    """
    sliced = sliced_links(distinct, docs, words, seed, similarity)
    known = distinct.join(components(sliced).withColumnRenamed("node", "th"), "th", "left")
    dealt = known.select("th", "fp", "n", F.coalesce("root", "th").alias("class"), F.posexplode("bands").alias("t", "key"))
    close = (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= WIDE) & (F.least("n", "n2") >= similarity * F.greatest("n", "n2") - 1e-9) & (F.col("th") != F.col("th2"))
    met = lambda df: df.where(close).select(F.least("th", "th2").alias("a"), F.greatest("th", "th2").alias("b")).distinct()
    leaders = dealt.groupBy("t", "key").agg(F.min(F.struct("th", "fp", "n", "class")).alias("lead"), F.count("*").alias("size")).where("size > 1")
    leaders = leaders.select("t", "key", F.col("lead.th").alias("th2"), F.col("lead.fp").alias("fp2"), F.col("lead.n").alias("n2"), F.col("lead.class").alias("class2"))
    shared = materialise(dealt.join(leaders, ["t", "key"]))
    first = sliced.unionByName(similar(met(shared.where("class <> class2")), docs, words, seed, similarity))
    classed = shared.select("t", "key", "th", "fp", "n").join(components(first).withColumnRenamed("node", "th"), "th", "left").withColumn("class", F.coalesce("root", "th"))
    sizes = classed.groupBy("t", "key", "class").agg(F.count("*").alias("m"))
    common = sizes.groupBy("t", "key").agg(F.max(F.struct("m", "class")).alias("top"), F.count("*").alias("classes")).where("classes > 1").select("t", "key", F.col("top.class").alias("common"))
    mixed = materialise(classed.join(common, ["t", "key"]))
    rest = mixed.where("class <> common").select("t", "key", F.col("th").alias("th2"), F.col("fp").alias("fp2"), F.col("n").alias("n2"), F.col("class").alias("class2"))
    second = similar(met(mixed.join(rest, ["t", "key"]).where("class <> class2")), docs, words, seed, similarity)
    return first.unionByName(second)


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each component of texts whose word shingles have the Jaccard similarity.

    The row that stays has the least doc_id, of several such the least text hash; rows that repeat in full count as
    one document. Texts without a word are alike; one of fewer words than a shingle is its own only shingle.
    """
    rows = materialise(sketches(docs, words, seed))
    distinct = materialise(rows.groupBy("th").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bands").alias("bands")))
    # texts without a word have no shingle to compare: the least of them stands for all
    empty = distinct.where("n = 0")
    blank = empty.crossJoin(F.broadcast(empty.agg(F.min("th").alias("a")))).select("a", F.col("th").alias("b"))
    found = components(similar_links(distinct.where("n > 0"), docs, words, seed, similarity).unionByName(blank)).withColumnRenamed("node", "th")
    rooted = distinct.join(found, "th", "left").select("th", "first", F.coalesce("root", "th").alias("root"))
    kept = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "th")).alias("k")).select(F.col("k.first").alias("__id"), F.col("k.th").alias("__th"))
    return only(docs, kept)
