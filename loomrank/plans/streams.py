"""Queries that run as streams: reuse of details, the board merged run by run, details with retries, whole crawls; and the
counters of a ranking. Each is held against SQL over the same rows at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomrank.operators.board import FIELDS
from loomrank.plans import crawl as C
from loomrank.plans import inputs
from loomrank.plans.matching import read
from loomrank.streaming import crawl as K
from loomrank.streaming import details as D
from loomrank.streaming import reuse as R
from loomrank.streaming.upsert import shared_folder

#: Files that a table is dealt into before it is streamed; files of a batch.
PARTS, A_BATCH = 6, 2


def replayed(df: DataFrame, order: str, folder: str, parts: int = PARTS, some: range | None = None) -> DataFrame:
    """``df`` written as files in the order of the column ``order``, of which ``some``; and the stream over them, A_BATCH at a time."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    spark = df.sparkSession
    for i in some or range(parts):
        lo, hi = ((low or 0) + ((high or 0) + 1 - (low or 0)) * j // parts for j in (i, i + 1))
        # dealt into one file behind a shuffle: coalesced, the whole table would be read and worked out by one task for each part
        df.where((F.col(order) >= lo) & (F.col(order) < hi)).repartition(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", A_BATCH).parquet(f"{folder}/in")


# Reading rows out of events: listings and details, with stamps of every sort.
READS = """select cast(user_id as string) as id, event_id as seq, ts, case when event_type in ('click', 'view', 'error') then 'listing' else 'detail' end as kind, case event_id % 11 when 0 then 'failed' when 1 then 'Complete' else 'complete' end as status,
 case event_id % 9 when 0 then substr(cast(ts + interval 2 hour as string), 1, 19) || '+02:00' when 1 then substr(cast(ts as string), 1, 19) when 2 then substr(cast(ts + interval 3 hour as string), 1, 19) || 'Z' when 3 then 'yesterday' when 4 then replace(substr(cast(ts - interval 20 hour as string), 1, 19), ' ', 'T') || 'Z'
  when 5 then replace(substr(cast(ts - interval 330 minute as string), 1, 16), ' ', 'T') || '-0530' else replace(substr(cast(ts as string), 1, 19), ' ', 'T') || 'Z' end as stamp, 'body ' || cast(event_id as string) as body from {events}"""


def stream_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of each listing; the stream is run, ended half way and taken up again."""
    rows = C.shared(spark, sf_dir, READS, "events").withColumn("at", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))).drop("ts")
    folder = shared_folder(spark)
    for half in (range(PARTS // 2), range(PARTS // 2, PARTS)):
        R.run_reuse(replayed(rows, "seq", folder, some=half), folder)
    return R.read_outcomes(spark, folder)


def stream_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``board_merge`` batch by batch."""
    df = C.shared(spark, sf_dir, C.BOARD, "events")
    meta = F.map_filter(F.create_map(F.lit("detail_status"), "d_status", F.lit("detail_collected_at"), "d_stamp", F.lit("Level"), "m_level"), lambda k, v: v != "")
    rows = df.select("id", "seq", *FIELDS, "is_open", meta.alias("metadata"))
    folder = shared_folder(spark)
    table = K.board_table(spark, folder, fan=3)
    K.run_merge(replayed(rows, "seq", folder, parts=10), table, f"{folder}/checkpoint")
    got = K.read_board(table)
    return got.select("id", "title", "company", "status", "is_open", F.try_element_at("metadata", F.lit("Level")).alias("level"), "detail_status", "detail_collected_at", "first_seen", "last_seen")


# What the reading of a posting's detail gives at each attempt: some never load, some load late, some break a rule.
PAYLOAD = """case when pos % 17 = 6 or (pos % 11 = 4 and attempt < 2) then cast(null as string) when pos % 13 = 5 and attempt < 3 then '{"title": "cut' when pos % 23 = 8 then '{"title": "' || repeat('x', 1001) || '"}'
 when pos % 19 = 7 then '{"title": "T' || cast(pos as string) || '", "location": "' || repeat('far ', 251) || '"}' when pos % 5 = 0 then '{"title": "", "location": "Hall ' || cast(attempt as string) || '"}' else '{"title": "D' || cast(pos as string) || '", "location": null}' end"""
TARGETS = "select doc_id as pos, 'J' || cast(doc_id as string) as id, case when doc_id % 10 = 0 then '' else 'Listed ' || cast(doc_id as string) end as title, case when doc_id % 3 = 0 then '' else coalesce(lang, '') end as location from {documents}"


def stream_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.shared(spark, sf_dir, TARGETS, "documents")
    folder = shared_folder(spark)
    D.run_details(replayed(rows, "pos", folder, parts=4), lambda df, attempt: df.withColumn("attempt", F.lit(attempt)).withColumn("payload", F.expr(PAYLOAD)), folder)
    return D.read_details(spark, folder).select("pos", "id", "title", "location", "outcome", F.col("tries").cast("long").alias("tries"), "issue", "from_listing")


# Three crawls of the board: the first sees most, the second is complete and misses some, the third has a warning.
SEEN = {1: "doc_id % 10 <> 9", 2: "doc_id % 10 <> 8", 3: "doc_id % 10 in (1, 8)"}


def crawled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dict]]:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    folder, told = shared_folder(spark), []
    table = K.board_table(spark, folder, fan=3)
    span = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1
    for crawl, seen in SEEN.items():
        here = docs.where(seen).withColumn("seq", F.lit(crawl * span) + F.col("doc_id")).withColumn("page", F.floor(F.col("doc_id") / 25).cast("long"))
        n = here.count()
        state = F.when((F.col("doc_id") % 50 == 3) & F.lit(crawl == 1), "failed").otherwise("complete")
        text = {"title": F.concat(F.lit(f"T{crawl}-"), F.col("doc_id").cast("string")), "company": F.col("source"), "location": F.col("lang")}
        rows = here.select("page", F.concat(F.lit("J"), F.col("doc_id").cast("string")).alias("id"), "seq", *[text.get(c, F.lit("")).alias(c) for c in FIELDS], F.lit(True).alias("is_open"), F.create_map(F.lit("detail_status"), state).alias("metadata"), (F.col("doc_id") % 4 == 0).alias("reused"), F.lit(None).cast("long").alias("expected"), F.lit(False).alias("last"), F.lit("").alias("warning"))
        again = rows.where("seq % 7 = 0").withColumn("page", F.col("page") + 1)  # the board moved while it was read
        last = here.agg(F.max("page").alias("end"))
        pages = here.groupBy("page").agg(F.max("seq").alias("seq")).join(F.broadcast(last)).select("page", F.lit(None).cast("string").alias("id"), "seq", *[F.lit("").alias(c) for c in FIELDS], F.lit(None).cast("boolean").alias("is_open"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(False).alias("reused"), F.lit(n).cast("long").alias("expected"), (F.col("page") == F.col("end")).alias("last"), F.when((F.col("page") == 0) & F.lit(crawl == 3), "a page was cut").otherwise("").alias("warning"))
        stream = replayed(rows.unionByName(again).unionByName(pages), "page", f"{folder}/crawl{crawl}", parts=4)
        told.append({"crawl": crawl} | K.run_crawl(stream, table, crawl, f"{folder}/checkpoint{crawl}"))
    return K.read_board(table), told


def crawl_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board after three crawls; the second retired what it didn't see, the others nothing."""
    return crawled(spark, sf_dir)[0].select("id", "title", "company", "detail_status", "first_seen", "last_seen", "on_board")


def crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["crawl", "jobs", "complete", "failed", "reused", "pages", "warnings", "ends", "least"]
    return spark.createDataFrame([tuple(t.get(n) for n in names) for t in crawled(spark, sf_dir)[1]], ", ".join(f"{n} long" for n in names))


def counted_run(rows: DataFrame, path: str) -> dict[str, int]:
    """Write a run's ``rows(reason, place, answer, cached)`` and say what it came to, as observed in that one pass.

    All, those that no rule shut out, those within the shortlist and answered for, those without an answer though asked, those
    answered from memory, and those beyond the shortlist (``place`` null).
    """
    seen = Observation()
    eligible, asked = F.col("reason") == "", F.col("place").isNotNull()
    counts = {"total": F.count(F.lit(1)), "eligible": F.count_if(eligible), "assessed": F.count_if(eligible & asked & F.col("answer").isNotNull()), "failed": F.count_if(eligible & asked & F.col("answer").isNull()), "cached": F.count_if(eligible & asked & F.col("answer").isNotNull() & F.col("cached")), "skipped": F.count_if(eligible & ~asked)}
    rows.observe(seen, *[v.alias(k) for k, v in counts.items()]).write.parquet(path)
    return {k: seen.get[k] for k in counts}


RUN = """select pos, case when status = ' Closed ' then 'closed' when title = '' then 'untitled' else '' end as reason, case when pos % 4 <> 3 then pos end as place, case when pos % 13 <> 2 then 'answer' end as answer, pos % 3 = 0 as cached from p"""


def run_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(RUN.replace("from p", "from {p}"), p=inputs.postings(spark, sf_dir))
    got = counted_run(rows, shared_folder(spark))
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} long" for k in got))


QUERIES = {f.__name__: f for f in (stream_reuse, stream_board, stream_details, crawl_board, crawl_counters, run_envelope)}

READ_AT = r"""case when kind = 'detail' and lower(status) = 'complete' then case when stamp like '%Z' then cast(replace(substr(stamp, 1, 19), 'T', ' ') as timestamp) when regexp_matches(stamp, '\+02:00$') then cast(substr(stamp, 1, 19) as timestamp) - interval 2 hour when regexp_matches(stamp, '-0530$') then cast(replace(substr(stamp, 1, 16), 'T', ' ') || ':00' as timestamp) + interval 330 minute end end"""
span = "(select max(doc_id) + 1 from documents)"
one_crawl = " union all ".join(f"select doc_id, {c} as crawl from documents where {where}" for c, where in SEEN.items())
ORACLE_SQL = {
    "stream_reuse": f"with r as ({READS.format(events='events')}), v as (select *, case when {READ_AT} <= ts then {READ_AT} end as read from r), w as (select *, last_value(read ignore nulls) over s as held, last_value(case when read is not null then body end ignore nulls) over s as held_body from v window s as (partition by id order by seq rows between unbounded preceding and current row)), f as (select *, coalesce(ts - held >= interval 0 second and ts - held < interval 24 hour, false) as fresh from w where kind = 'listing') select id, seq, case when fresh then 'reused' else 'to read' end as outcome, case when fresh then epoch_us(held) end as read_at, case when fresh then held_body end as body from f",
    "stream_board": C.ORACLE_SQL["board_merge"],
    "stream_details": f"""with t as ({TARGETS.format(documents='documents')}), a as (select t.*, attempt, {PAYLOAD} as payload from t, (select unnest([1, 2, 3]) as attempt)),
 j as (select *, coalesce(json_valid(payload), false) as ok, case when json_valid(payload) then coalesce(nullif(payload ->> 'title', ''), title) else title end as t2, case when json_valid(payload) then coalesce(nullif(payload ->> 'location', ''), location) else location end as l2 from a),
 b as (select *, t2 = '' or length(t2) > 1000 as bad_title, length(l2) > 1000 as bad_location from j),
 k as (select *, case when payload is null then 'not loaded' when not ok then 'not JSON' when bad_title or bad_location then 'wrong: ' || concat_ws(', ', case when bad_title then 'title' end, case when bad_location then 'location' end) else '' end as issue, attempt = 3 and ok and bad_location and not bad_title and location <> '' as from_listing from b),
 g as (select *, issue = '' or from_listing as good from k), n as (select pos, min(attempt) as first from g where good group by pos)
 select g.pos, id, case when good then t2 else title end as title, case when good and not from_listing then l2 else location end as location, case when good then 'complete' else 'dead' end as outcome, attempt::bigint as tries, issue, from_listing from g left join n on g.pos = n.pos where attempt = coalesce(first, 3)""",
    "crawl_board": f"with s as ({one_crawl}) select 'J' || doc_id as id, 'T' || max(crawl) || '-' || doc_id as title, coalesce(any_value(source), '') as company, case when min(crawl) = 1 and doc_id % 50 = 3 and max(crawl) = 1 then 'failed' else 'complete' end as detail_status, min(crawl) * {span} + doc_id as first_seen, max(crawl) * {span} + doc_id as last_seen, max(crawl) >= 2 as on_board from s join documents using (doc_id) group by doc_id",
    "crawl_counters": f"with s as ({one_crawl}), p as (select crawl, count(distinct doc_id // 25) as pages from s group by crawl) select crawl::bigint as crawl, count(*) as jobs, count(*) filter (not (crawl = 1 and doc_id % 50 = 3)) as complete, count(*) filter (crawl = 1 and doc_id % 50 = 3) as failed, count(*) filter (doc_id % 4 = 0) as reused, any_value(pages) as pages, (crawl = 3)::bigint as warnings, 1::bigint as ends, count(*) as least from s join p using (crawl) group by crawl",
    "run_envelope": f"with p as ({inputs.POSTINGS_SQL}), r as ({RUN}) select count(*) as total, count(*) filter (reason = '') as eligible, count(*) filter (reason = '' and place is not null and answer is not null) as assessed, count(*) filter (reason = '' and place is not null and answer is null) as failed, count(*) filter (reason = '' and place is not null and answer is not null and cached) as cached, count(*) filter (reason = '' and place is null) as skipped from r",
}
