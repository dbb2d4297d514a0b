"""Token-id files with keyed access through a minimal perfect hash index.

Files: ``payload`` holds segments in ascending key order, each a blob of a header, the lengths of its
documents and their raw ids; ``index`` holds, for each bucket of keys, a minimal perfect hash (levels of bit
arrays, a key's slot is the rank of its bit) and by slot a stored fingerprint and the document's place.
Both are written by Spark's own writer, so they lie in whatever store the cluster uses: the payload in a folder a
shard, the index in a folder a few dozen buckets. A lookup of some keys lists the folders, opens those of its keys'
buckets and shards, and there reads the row groups of its buckets and segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrank.llm.common import map_batches, shared_dir
from loomrank.llm.wordids import word_ids

MAGIC, HEADER = b"LRT1", struct.Struct("<4sIII")
#: Ids and documents of a segment at most (a longer document has one of its own).
SEGMENT_IDS, SEGMENT_DOCS = 1 << 16, 4096
#: Keys of an index bucket on average; buckets of an index folder.
BUCKET_KEYS, FOLDER_BUCKETS = 4096, 32
#: Bytes of a range of documents (as the planner puts them), at most about.
RANGE_BYTES = 256 << 20
#: Keys up to which a lookup names the folders it opens; beyond that index and payload are joined whole.
FEW_KEYS = 10_000
#: Rows of segment starts that are broadcast at most.
MAX_BROADCAST_ROWS = 50_000


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix (xor, multiply, shift) of unsigned keys, another for each seed."""
    x = keys ^ np.uint64(seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Levels of bit arrays over distinct keys: a key lies in the first level where it alone set its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.cumsum(bits) - bits for bits in levels]
        self.base = np.cumsum([0] + [int(b.sum()) for b in levels])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.uint64), []
        while len(left):
            at = (mixed(left, len(levels)) % np.uint64(2 * len(left))).astype(np.int64)
            once = np.bincount(at, minlength=2 * len(left)) == 1
            levels.append(once)
            left = left[~once[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 if no level has it."""
        out = np.full(len(keys), -1)
        open_ = np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = (mixed(keys[open_], i) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.base[i] + self.ranks[i][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<I", len(b)) + np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        (n,), at, levels = struct.unpack_from("<I", blob), 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<I", blob, at)
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, -(-size // 8), at + 4), count=size).astype(bool))
            at += 4 + -(-size // 8)
        return cls(levels)


def pack_segment(docs: list[np.ndarray], width: str) -> bytes:
    return HEADER.pack(MAGIC, int(width[-1]), len(docs), sum(map(len, docs))) + np.array([len(d) for d in docs], "<u4").tobytes() + b"".join(d.astype(width).tobytes() for d in docs)


def read_segment(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and ids of a segment."""
    magic, width, n_docs, n_ids = HEADER.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    return np.frombuffer(blob, "<u4", n_docs, HEADER.size), np.frombuffer(blob, f"<u{width}", n_ids, HEADER.size + 4 * n_docs)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> str:
    """Write payload and index of all rows; returns their folder.

    Rows are dealt by ranges of (doc_id, text hash), so a key that repeats doesn't land in one task. Null
    texts are empty (one end id); null keys come first and have no index entry; of a repeated key the index
    holds the first. An empty table gives empty files.
    """
    spark = docs.sparkSession
    path = path or shared_dir(spark)
    width = "<u2" if max(word_ids(tokenizer).size, end_id + 1) <= 1 << 16 else "<u4"
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, segment = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            one = [[shard], [segment], [len(held)], [size], [keys], [[len(x) for x in held]], [pack_segment(held, width)]]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, kinds, strict=True)], ["shard", "segment", "n_docs", "n_ids", "doc_ids", "lengths", "blob"])

        for b in batches:
            for key, ids in zip(b.column("doc_id").to_pylist(), encoder.encode_all(b.column("text").to_pylist()), strict=True):
                ids = np.frombuffer(ids + end, "<u4")
                if held and (size + len(ids) > SEGMENT_IDS or len(held) == SEGMENT_DOCS):
                    yield flush()
                    keys, held, size, segment = [], [], 0, segment + 1
                keys.append(key)
                held.append(ids)
                size += len(ids)
        if held:
            yield flush()

    size = int(docs.select("doc_id", "text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES) if size < 1 << 60 else 1)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.withColumn("th", F.xxhash64("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "th").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "th").select("doc_id", "text")
    # a shard is what one task writes, so each of these folders has one file
    map_batches(ordered, encode, PAYLOAD).write.option("compression", "zstd").partitionBy("shard").parquet(f"{path}/payload")
    payload = read_payload(spark, path)
    n = payload.agg(F.sum("n_docs")).first()[0] or 0
    buckets = max(1, n // BUCKET_KEYS)
    starts = segment_starts(payload)
    places = directory(payload.select("shard", "segment", "doc_ids", "lengths"), starts).where("doc_id is not null")
    first = places.groupBy("doc_id").agg(F.min(F.struct("start", "shard", "segment", "offset", "n_tokens")).alias("p"), F.count("*").alias("copies"))
    keyed = first.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), "doc_id", "p.*", "copies")

    def index(table: pa.Table) -> pa.Table:
        keys = table.column("doc_id").to_numpy().view(np.uint64)
        h = PerfectHash.build(keys)
        order = np.argsort(h.slots(keys))
        cols = [prints(keys)[order].tobytes()] + [table.column(c).to_numpy()[order].astype("<i8").tobytes() for c in PLACE]
        return pa.table({"bucket": table.column("bucket")[:1], "hash": pa.array([h.dump()]), **{c: pa.array([x], pa.binary()) for c, x in zip(["prints", *PLACE], cols, strict=True)}})

    made = keyed.groupBy("bucket").applyInArrow(index, INDEX).withColumn("buckets", F.lit(buckets)).withColumn("folder", folder_of(F.col("bucket")))
    made.repartition("folder").sortWithinPartitions("folder", "bucket").write.option("compression", "zstd").partitionBy("folder").parquet(f"{path}/index")
    return path


PAYLOAD = "shard int, segment int, n_docs int, n_ids long, doc_ids array<long>, lengths array<int>, blob binary"
PLACE = ["start", "shard", "segment", "offset", "n_tokens", "copies"]
INDEX = "bucket long, hash binary, prints binary, " + ", ".join(f"{c} binary" for c in PLACE)


def folder_of(bucket) -> Column:
    return F.floor(bucket / FOLDER_BUCKETS).cast("long")


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).parquet(f"{path}/payload")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX + ", buckets long, folder long").parquet(f"{path}/index")


def segment_starts(payload: DataFrame) -> DataFrame:
    """``shard, segment, segment_start``: ids before each segment; only one row a shard meets in one task."""
    sizes = payload.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    shards = shards.select(F.col("shard").alias("s"), (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("n_ids")
    return sizes.withColumn("within", within).join(shards, F.col("shard") == F.col("s")).select("shard", "segment", (F.col("base") + F.col("within")).alias("segment_start"))


def directory(segments: DataFrame, starts: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, shard, segment, offset, n_tokens, start`` and, if segments have blobs, ``ids_crc32``."""
    if starts.count() <= MAX_BROADCAST_ROWS:
        starts = F.broadcast(starts)
    joined = segments.join(starts, ["shard", "segment"])
    payload = "blob" in segments.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one blob at a time
                row = b.slice(i, 1).to_pylist()[0]
                if payload:
                    lengths, ids = read_segment(row["blob"])
                    lengths = lengths.astype(np.int64)
                else:
                    lengths = np.array(row["lengths"], np.int64)
                offset = np.cumsum(lengths) - lengths
                n = len(lengths)
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(offset), pa.array(lengths), pa.array(offset + row["segment_start"])]
                if payload:
                    wide = ids.astype("<u4")
                    cols.append(pa.array([zlib.crc32(wide[o : o + k]) for o, k in zip(offset.tolist(), lengths.tolist(), strict=True)], pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "shard", "segment", "offset", "n_tokens", "start"] + ["ids_crc32"] * payload
    schema = "doc_id long, shard int, segment int, offset long, n_tokens long, start long" + ", ids_crc32 long" * payload
    out = map_batches(joined, run, schema)
    return out


def locate(spark: SparkSession, path: str, keys: DataFrame, few: bool = False) -> DataFrame:
    """Places of ``keys(doc_id)`` through the index: ``doc_id, start, shard, segment, offset, n_tokens, copies``.

    Each bucket meets its keys only; a key whose slot has another fingerprint is not in the files (but for one
    in 2**32 strangers) and gives no row. Of ``few`` keys only the folders of their buckets are opened.
    """
    table = read_index(spark, path)
    some = table.select("buckets").first()
    buckets = some[0] if some else 1
    wanted = keys.where("doc_id is not null").select("doc_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    if few:
        at = sorted(r[0] for r in wanted.select("bucket").distinct().collect())  # FEW_KEYS at most
        table = table.where(F.col("folder").isin(sorted({b // FOLDER_BUCKETS for b in at})) & F.col("bucket").isin(at))
    names = ["doc_id", *PLACE]

    def look(key, wanted: pa.Table, index: pa.Table) -> pa.Table:
        ids = wanted.column("doc_id").to_numpy()
        empty = not len(index) or not len(ids)
        if empty:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        row = index.slice(0, 1).to_pylist()[0]
        slot = PerfectHash.load(row["hash"]).slots(ids.view(np.uint64))
        hit = (slot >= 0) & (np.frombuffer(row["prints"], "<u4")[slot] == prints(ids.view(np.uint64)))
        return pa.table({"doc_id": ids[hit], **{c: np.frombuffer(row[c], "<i8")[slot[hit]] for c in PLACE}})

    return wanted.groupBy("bucket").cogroup(table.drop("buckets", "folder").groupBy("bucket")).applyInArrow(look, ", ".join(f"{c} long" for c in names))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All documents read back from the files: ``doc_id, start, n_tokens, ids_crc32``.

    Every key goes through the index to its shard, segment and offset, and meets there the ids that the payload
    holds at that place. Null keys and later rows of a repeated key have their segment's own directory. Empty files
    give no rows.
    """
    payload = read_payload(spark, path)
    found = directory(payload.select("shard", "segment", "doc_ids", "blob"), segment_starts(payload))
    keys = payload.select(F.explode("doc_ids").alias("doc_id"))
    placed = locate(spark, path, keys).select(F.col("doc_id").alias("key"), F.col("start").alias("at"), "shard", "segment", "offset", F.col("n_tokens").alias("size"))
    both = found.join(placed, ["shard", "segment", "offset"], "left")
    return both.select(F.coalesce("key", "doc_id").alias("doc_id"), F.coalesce("at", "start").alias("start"), F.coalesce("size", "n_tokens").alias("n_tokens"), "ids_crc32", F.col("key").isNotNull().alias("indexed"))


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """``doc_id, ids`` of ``keys(doc_id)``; null keys and keys that aren't in the files give no row, repeated ones one.

    Up to FEW_KEYS keys open the index folders of their buckets and the payload folders of their shards, and nothing
    else: what is read doesn't grow with the corpus. More keys are joined with index and payload.
    """
    few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    placed = locate(spark, path, keys, few)
    payload = read_payload(spark, path).select("shard", "segment", "blob")
    if few:
        places = [tuple(r) for r in placed.select("doc_id", "shard", "segment", "offset", "n_tokens").collect()]
        placed = spark.createDataFrame(places, "doc_id long, shard long, segment long, offset long, n_tokens long")
        payload = payload.where(F.col("shard").isin(sorted({p[1] for p in places})) & F.col("segment").isin(sorted({p[2] for p in places})))
    want = placed.groupBy(F.col("shard").cast("int").alias("shard"), F.col("segment").cast("int").alias("segment")).agg(F.collect_list(F.struct("doc_id", "offset", "n_tokens")).alias("want"))
    joined = payload.join(F.broadcast(want) if few else want, ["shard", "segment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                _, ids = read_segment(row["blob"])
                out = [(w["doc_id"], ids[w["offset"] : w["offset"] + w["n_tokens"]].tolist()) for w in row["want"]]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return map_batches(joined.select("blob", "want"), run, "doc_id long, ids array<long>")
