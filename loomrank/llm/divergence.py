"""How far the sources of a language diverge in their words, counted and compared by DuckDB, shard by shard.

Each task counts the words of its documents in SQL; the counts are dealt into shards by language and term, and each shard
sums them and keeps the terms that enough documents hold. In a second round each shard works out its share of every
pair's distance and its own best terms; Spark adds up the shares and ranks.

A pair of sources is compared over all kept terms, but only what at least one of them has is looked at: with f the
distance of one term, f0 that of a term neither has, a shard's share is f0 times its terms, corrected for the terms of one of
the two (by the number of terms with the same count) and for the terms that both have.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrank.llm.common import delete_path, map_batches, materialise

#: A term is kept where so many documents of the language hold it.
LEAST_DOCS = 10
#: Ranks of the part ``term``.
TOP_TERMS = 10
#: Rows of counts a shard has on average at most; rows of counts that a task holds before it adds them up.
SHARD_ROWS, HELD_ROWS = 400_000, 1_000_000
#: Pairs of sources whose shares are held at once.
HELD_PAIRS = 2_000_000
SEPARATORS = "".join(map(chr, [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
FOLD = (string.ascii_uppercase + SEPARATORS, string.ascii_lowercase + " " * len(SEPARATORS))

WORDS = """insert into part with
 words as (select row, lang, source, unnest(string_split(translate(text, ?, ?), ' ')) as term from batch),
 held as (select row, lang, source, term, count(*) as n from words where term <> '' group by all)
 select lang, source, term, sum(n)::bigint, count(*) from held group by all"""
ADD_UP = "create or replace table part as select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from part group by all"
KEPT = """with terms as (select *, sum(docs) over (partition by lang, term) as all_docs, row_number() over (partition by lang, term order by source) = 1 as counts from part)
 select lang, source, term, n, counts from terms where all_docs >= {least}"""
#: Shares are of bigints, told by counts and totals of any size.
PREPARE = """
 create macro share(n, total, vocab) as (1 + (1000000000::hugeint * (n + 2)) // (total + 2 * vocab)::hugeint)::bigint;
 create macro f(p, q) as ((p - q) * (p - q)) // (p + q);
 create table side as select distinct lang, source, n as total, lang_total, vocab from part where term is null;
 create table zero as select lang, source, total, lang_total, vocab, case when vocab > 0 then share(0, total, vocab) end as p0 from side;
 create table k as select t.lang, t.term, t.source, share(t.n, z.total, z.vocab) as p, z.p0, share(sum(t.n) over (partition by t.lang, t.term), z.lang_total, z.vocab) as q from part t join zero z on t.lang = z.lang and t.source = z.source where t.term is not null;
"""
PAIRS = """with base as (select a.lang, a.source as a, b.source as b, coalesce(v.terms * f(a.p0, b.p0), 0) as value from zero a join zero b on a.lang = b.lang and a.source < b.source left join (select lang, count(distinct term) as terms from k group by lang) v on v.lang = a.lang where hash(a.source) % {slices} = {slice}),
 same as (select lang, source, p, p0, count(*) as m from k group by all),
 one as (select h.lang, least(h.source, z.source) as a, greatest(h.source, z.source) as b, m * (f(h.p, z.p0) - f(h.p0, z.p0)) as value from same h join zero z on h.lang = z.lang and h.source <> z.source where hash(least(h.source, z.source)) % {slices} = {slice}),
 both_ as (select x.lang, x.source as a, y.source as b, f(x.p, y.p) - f(x.p, y.p0) - f(x.p0, y.p) + f(x.p0, y.p0) as value from k x join k y on x.lang = y.lang and x.term = y.term and x.source < y.source where hash(x.source) % {slices} = {slice})
 select lang, a as source, 'pair' as part, b as item, sum(value)::bigint as value from (from base union all from one union all from both_) group by all"""
TERMS = """select lang, source, 'term' as part, term as item, f(p, q)::bigint as value from k where p > q
 qualify row_number() over (partition by lang, source order by f(p, q) desc, term) <= {top}"""


def opened() -> duckdb.DuckDBPyConnection:
    """One thread a task, nothing written to a local disk."""
    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})


def size_of(con: duckdb.DuckDBPyConnection) -> int:
    return con.sql("select count(*) from part").fetchall()[0][0]


def drained(con: duckdb.DuckDBPyConnection, query: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(query).to_arrow_table().combine_chunks().to_batches(max_chunksize=50_000)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts ``lang, source, term, n, docs`` of a task's documents ``lang, source, text``, added up while they fit."""
    con = opened()
    con.execute("create table part (lang varchar, source varchar, term varchar, n bigint, docs bigint)")
    most = HELD_ROWS
    for b in batches:
        con.register("batch", pa.Table.from_batches([b]).append_column("row", pa.array(range(b.num_rows), pa.int64())))
        con.execute(WORDS, list(FOLD))
        con.unregister("batch")
        if size_of(con) > most:
            con.execute(ADD_UP)
            if size_of(con) > HELD_ROWS // 2:
                yield from drained(con, "select * from part")
                con.execute("delete from part")
    con.execute(ADD_UP)
    yield from drained(con, "select * from part")


def summed(least: int):
    """A shard's counts added up: ``lang, source, term, n, counts`` of the terms that enough documents hold; of each
    language and term one row counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = opened()
        con.execute("create table part (lang varchar, source varchar, term varchar, n bigint, docs bigint)")
        most = HELD_ROWS
        for b in batches:
            con.register("batch", pa.Table.from_batches([b]))
            con.execute("insert into part select lang, source, term, n, docs from batch")
            con.unregister("batch")
            if size_of(con) > most:
                con.execute(ADD_UP)
                most = size_of(con) + HELD_ROWS
        con.execute(ADD_UP)
        yield from drained(con, KEPT.format(least=least))

    return run


def compared(top: int):
    """A shard's share of each pair's distance and its best terms: ``lang, source, part, item, value``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = opened()
        con.execute("create table part (lang varchar, source varchar, term varchar, n bigint, lang_total bigint, vocab bigint)")
        for b in batches:
            con.register("batch", pa.Table.from_batches([b]))
            con.execute("insert into part select lang, source, term, n, lang_total, vocab from batch")
            con.unregister("batch")
        con.execute(PREPARE)
        pairs = con.sql("select coalesce(sum(s * s), 0) / 2 from (select count(*) as s from side group by lang)").fetchall()[0][0]
        slices = 1 + int(pairs) // HELD_PAIRS
        for i in range(slices):
            yield from drained(con, PAIRS.format(slices=slices, slice=i))
        yield from drained(con, TERMS.format(top=top))

    return run


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs(text, lang, source)``.

    Terms are runs of letters (A-Z, a-z and all that is not ASCII), only A-Z lower-cased. A language keeps the terms that
    ``least_docs`` of its rows hold. Part ``pair``: for every source of a language every other one with their distance over
    all kept terms. Part ``term``: for every source the ``top`` terms that it has more of than its language. Equal values
    rank by the item's bytes.

    A null text, lang or source counts as empty; every row is a document, repeated ones too. A language of one source has
    no pairs, one without kept terms has pairs of value 0 and no terms; an empty table gives no rows. Only the three columns
    are read, so others can't clash. Texts may be of any length that a row may have.
    """
    spark = docs.sparkSession
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = materialise(map_batches(plain, counted, "lang string, source string, term string, n long, docs long"))
    shards = max(least, -(-part.count() // SHARD_ROWS))
    kept = materialise(map_batches(part.repartition(shards, "lang", "term"), summed(least_docs), "lang string, source string, term string, n long, counts boolean"))
    delete_path(spark, part.loomrank_path)
    has = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("counts").alias("vocab"))
    none = F.lit(0).cast("long")
    totals = plain.select("lang", "source").distinct().join(has, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("n", "lang_total", "vocab")])
    shards = max(least, -(-kept.count() // SHARD_ROWS))
    # every shard gets all totals with its counts: by the shuffle, however many sources there are
    rows = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"), "lang", "source", "term", "n", none.alias("lang_total"), none.alias("vocab"))
    sides = totals.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), "n", "lang_total", "vocab")
    dealt = rows.unionByName(sides).repartitionById(shards, F.col("shard")).drop("shard")
    shares = map_batches(dealt, compared(top), "lang string, source string, part string, item string, value long")
    ways = F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).otherwise(F.array(F.struct("source", "item")))
    added = shares.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = added.select("lang", "part", "value", F.explode(ways).alias("w")).select("lang", "w.source", "part", "w.item", "value")
    by = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").asc())
    return both.withColumn("rank", F.row_number().over(by)).where((F.col("part") == "pair") | (F.col("rank") <= top))


#: The query in DuckDB's SQL: all sources against all terms, without the shortcuts above.
DIVERGENCE_SQL = f"""with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
 w as (select row, lang, source, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
 kt as (select lang, term from w group by all having count(distinct row) >= {LEAST_DOCS}),
 v as (select lang, count(*) as v from kt group by lang),
 g as (select distinct lang, source from d),
 c as (select g.lang, g.source, kt.term, coalesce(n, 0) as n from g join kt using (lang) left join (select lang, source, term, count(*) as n from w group by all) x using (lang, source, term)),
 p as (select *, (1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * v)::hugeint)::bigint as p,
  (1 + (1000000000::hugeint * (sum(n) over (partition by lang, term) + 2)) // (sum(n) over (partition by lang) + 2 * v)::hugeint)::bigint as q from c join v using (lang)),
 pr as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join
  (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s on s.lang = a.lang and s.source = a.source and s.item = b.source),
 tr as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p where n > 0 and p > q),
 r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (from pr union all from tr))
 select * from r where part = 'pair' or rank <= {TOP_TERMS}"""
