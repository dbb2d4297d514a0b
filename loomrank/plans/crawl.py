"""Queries of judging, merging, memo tables, crawls and exchange, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrank.functions import postings as P
from loomrank.functions import scores as S
from loomrank.operators import board as B
from loomrank.operators import criteria as C
from loomrank.operators import retrieval as R
from loomrank.plans import inputs
from loomrank.plans.matching import BM25_SQL, read, scored
from loomrank.sources import exchange as X
from loomrank.streaming.upsert import shared_folder

KINDS = "case l_linenumber % 5 when 0 then 'technical' when 1 then 'experience' when 2 then 'domain' when 3 then 'eligibility' else 'soft' end"
JUDGED = f"""select l_orderkey as job, cast(l_linenumber as bigint) as idx, {KINDS} as category, case when l_linestatus = 'O' then 'must' else 'preferred' end as importance,
 case (l_orderkey + l_linenumber) % 6 when 0 then 'conflict' when 1 then 'missing' when 2 then 'unknown' when 3 then 'transferable' else 'direct' end as status,
 case (l_orderkey * 3 + l_linenumber) % 5 when 0 then 'ran  the nightly  batch' when 1 then 'lists many tools' when 2 then 'never written' when 3 then 'ran the' else 'order ' || cast(l_orderkey as string) end as quote from {{lineitem}}"""
SPANS = """select o_orderkey as job, cast(1 as bigint) as block, o_orderkey % 3 <> 0 as evidence, cast(0.25 as double) * (o_orderkey % 4) as recency, 'We ran the nightly batch for order ' || cast(o_orderkey as string) as body from {orders}
 union all select o_orderkey, 2, false, cast(null as double), 'A page that lists many tools of order ' || cast(o_orderkey as string) from {orders}"""
JOBS = "select o_orderkey as job, case o_orderkey % 4 when 0 then cast(null as double) when 1 then cast(0 as double) when 2 then cast(0.5 as double) else cast(1 as double) end as preference from {orders}"
BOARD = """select cast(user_id as string) as id, event_id as seq, case when event_id % 3 = 0 then '' else event_type || cast(event_id as string) end as title, case when event_id % 5 = 0 then 'c' || cast(event_id as string) else '' end as company, '' as location,
 '' as description, '' as requirements, '' as deadline, '' as url, event_type as status, case when event_id % 7 = 0 then true when event_id % 11 = 0 then false end as is_open,
 case event_id % 9 when 0 then 'complete' when 1 then 'failed' else '' end as d_status, case when event_id % 2 = 0 then 't' || cast(event_id as string) else '' end as d_stamp, case when event_id % 4 = 0 then event_type else '' end as m_level from {events}"""


def shared(spark, sf_dir, sql, *tables):
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in tables})


def judged_rows(spark, sf_dir):
    return C.checked_judgements(shared(spark, sf_dir, JUDGED, "lineitem"), shared(spark, sf_dir, SPANS, "orders"))


def checked_judgements(spark, sf_dir):
    return judged_rows(spark, sf_dir)


def unmatched_judgements(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").cast("long").alias("idx"), "l_quantity")
    return C.unmatched(li.where("idx <= 5"), li.where("l_quantity > 10"))


def scored_jobs(spark, sf_dir):
    got = C.score_jobs(judged_rows(spark, sf_dir), shared(spark, sf_dir, JOBS, "orders"))
    parts = [F.try_element_at("breakdown", F.lit(k)).alias(f"p_{k}") for k in (*S.CATEGORY_WEIGHTS, "recency", "preferences", "qualification_cap")]
    return got.select("job", "score", *parts, "eligibility", "must_have_coverage", "must_have_count", "evidence_coverage", "recency_alignment")


def near_tie_order(spark, sf_dir):
    """The best hundred orders after neighbours in near ties were compared; a judge prefers the greater key."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.round(F.col("o_totalprice") / 5000, 2).alias("score"), F.when(F.col("o_orderkey") % 9 == 0, "conflict").otherwise("").alias("eligibility"))
    top = R.global_rank(o.orderBy(F.col("score").desc(), "job").limit(102), "rank", F.col("score").desc(), F.col("job").asc())
    prefer = lambda a, b: "A" if a.job > b.job else "B"
    return C.swapped(top, C.near_ties(top, 100, 6), prefer).select("rank", "job", "score")


def board_merge(spark, sf_dir):
    df = shared(spark, sf_dir, BOARD, "events")
    meta = F.map_filter(F.create_map(F.lit("detail_status"), "d_status", F.lit("detail_collected_at"), "d_stamp", F.lit("Level"), "m_level"), lambda k, v: v != "")
    got = B.merge_board(df.withColumn("metadata", meta))
    return got.select("id", "title", "company", "status", "is_open", F.try_element_at("metadata", F.lit("Level")).alias("level"), "detail_status", "detail_collected_at", "first_seen", "last_seen")


def listing_overlay(spark, sf_dir):
    p = inputs.postings(spark, sf_dir).withColumn("key", F.col("pos"))
    detail = p.where("pos % 2 = 0").select("key", F.lit("old title").alias("title"), F.col("company").alias("url"))
    return B.overlaid(detail, p, "key", ["title", "url"])


def memo_hits(spark, sf_dir):
    p = inputs.postings(spark, sf_dir).select("pos", F.sha2(F.concat_ws("|", "title", "url"), 256).alias("key"))
    memo = p.where("pos % 3 = 0").groupBy("key").agg(F.min("pos").alias("value"))
    memo = B.remembered(memo, p.where("pos % 15 = 0").groupBy("key").agg((-F.min("pos")).alias("value")))
    hits, misses = B.with_memo(p, memo, F.col("value") % 2 == 0)
    return hits.unionByName(misses.withColumn("value", F.lit(None).cast("long"))).select("pos", "value")


def page_prints(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("page"), (F.col("doc_id") % 5).alias("place"), (F.floor(F.col("doc_id") / 5) % 13 * 5 + F.col("doc_id") % 5).cast("string").alias("id"))
    return B.repeated_pages(d)


def throttle_intervals(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "error", "refused").when(F.col("value") > 60, "slow").otherwise("well").alias("outcome"))
    return B.throttled(ev, 1.0)


def unit_vectors(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7))
    df = read(spark, sf_dir, "embeddings").select("vec_id", S.unit(scaled).alias("u"))
    return df.select("vec_id", F.round(S.dot(F.col("u"), F.col("u")), 6).alias("square"), (F.round(F.get("u", F.lit(0)), 6) + F.lit(0.0)).alias("first"))


def hash_material(spark, sf_dir):
    m = F.create_map(F.lit("title"), "title", F.lit("company"), "company", F.lit("id"), "id")
    return inputs.postings(spark, sf_dir).select("pos", F.sha2(P.sorted_json(m), 256).alias("hash"))


def import_rows(spark, sf_dir):
    """Postings as JSON lines, some broken, taken in again: what is taken, with nulls as defaults, and how much isn't."""
    p = inputs.postings(spark, sf_dir).where("pos < 10000").select("pos", F.to_json(F.struct("id", F.nullif("title", F.lit("")).alias("title"), F.lit(None).cast("string").alias("company"), F.col("url"), "is_open")).alias("value"))
    good, bad = X.imported(p.select(F.when(F.col("pos") % 10 == 3, F.substring("value", 1, 9)).otherwise(F.col("value")).alias("value")))
    rows = good.groupBy("id", "title", "company", "is_open").agg(F.count("*").alias("n"))
    return rows.unionByName(bad.agg(F.lit("bad").alias("id"), F.lit("").alias("title"), F.lit("").alias("company"), F.lit(None).cast("boolean").alias("is_open"), F.count("*").alias("n")))


def csv_export(spark, sf_dir):
    """The export written and read back."""
    df = inputs.postings(spark, sf_dir).select(F.col("pos").alias("rank"), (F.col("pos") % 100 / 4.0).alias("score"), F.concat(F.when(F.col("pos") % 5 == 0, "=").otherwise(""), "title").alias("title"), "company", F.array(F.lit("a"), F.lit('b "q"')).alias("matched_skills"), F.create_map(F.lit("relevance"), F.lit(1.5)).alias("score_breakdown"), F.concat(F.lit("-"), "location").alias("location"))
    path = shared_folder(spark)
    X.write_csv(df, path)
    return X.read_csv(spark, path).select("rank", "score", F.coalesce("title", F.lit("")).alias("title"), "company", "matched_skills", "score_breakdown", "location", F.coalesce("criteria", F.lit("")).alias("criteria"))


def lexical_fusion(spark, sf_dir):
    """Without similarities the lexical score over the greatest is the fused one; a shortlist of 0 takes all."""
    docs = read(spark, sf_dir, "documents").select("doc_id").join(scored(spark, sf_dir), "doc_id", "left").withColumn("lexical", F.coalesce("score", F.lit(0.0)))
    fused = R.lexical_only(docs, "lexical")
    return R.shortlist(fused, "doc_id", "fused", 0).select("doc_id", F.round("fused", 6).alias("fused"), "pos")


def wire_values(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("text"))
    return ev.select("event_id", X.coerced(F.col("text"), "long", -1).alias("number"))


QUERIES = {f.__name__: f for f in (checked_judgements, unmatched_judgements, scored_jobs, near_tie_order, board_merge, listing_overlay, memo_hits, page_prints, throttle_intervals, unit_vectors, hash_material, import_rows, csv_export, lexical_fusion, wire_values)}

CHECKED_SQL = f"""j as ({JUDGED.format(lineitem='lineitem')}), sp as ({SPANS.format(orders='orders')}),
 j1 as (select * replace (trim(regexp_replace(quote, '\\s+', ' ', 'g')) as quote), status in ('direct', 'transferable', 'conflict') as needs from j),
 ft as (select j1.job, idx, min(block) as block from j1 join sp on j1.job = sp.job and contains(body, quote) where needs and length(quote) >= 8 group by all),
 k as (select j1.*, ft.block, sp.evidence, sp.recency as rec from j1 left join ft on j1.job = ft.job and j1.idx = ft.idx left join sp on sp.job = ft.job and sp.block = ft.block),
 k1 as (select *, needs and block is null as missing, needs and block is not null and not evidence and category <> 'eligibility' and status <> 'conflict' as unproven from k),
 k2 as (select *, case when missing or unproven then 'unknown' else status end as st from k1),
 k3 as (select *, st = 'conflict' and not (category = 'eligibility' and importance = 'must') as mild from k2),
 ck as (select job, idx, category, importance, case when mild then 'unknown' else st end as status, case when mild or st in ('missing', 'unknown') then '' else quote end as quote, case when needs and not mild and st not in ('missing', 'unknown') then rec end as recency, case when missing then 'unverifiable' when unproven then 'unproven' when mild then 'mild' else '' end as warning from k3)"""
W = "case when importance = 'must' then 2.0 else 1.0 end::double"
CR = "case status when 'direct' then 1.0 when 'transferable' then 0.6 else 0.0 end::double"
ratio = lambda when, value: f"sum({W} * {value}) filter ({when}) / sum({W}) filter ({when})"
EDGE = lambda x, d: f"round({x} + 1e-9, {d})"
SCORED_SQL = f"""{CHECKED_SQL}, jb as ({JOBS.format(orders='orders')}),
 g as (select job, {ratio("category = 'technical'", CR)} as t, {ratio("category = 'experience'", CR)} as e, {ratio("category = 'domain'", CR)} as d, {ratio("category in ('technical', 'experience', 'domain') and importance = 'must'", CR)} as mc, {ratio("status in ('direct', 'transferable') and recency is not null", 'recency')} as rec,
  count(*) filter (importance = 'must') as mh, count(*) filter (status in ('direct', 'transferable')) as ns, count(*) as n, bool_or(status = 'conflict') as cf, bool_or(category = 'eligibility') as he, bool_or(category = 'eligibility' and status = 'unknown') as oe from ck group by job),
 a as (select jb.job, preference, g.* exclude (job), case when t is null then 0 else 35 end + case when e is null then 0 else 40 end + case when d is null then 0 else 25 end as present, 100 - case when preference is null then 0 else 10 end - case when rec is null then 0 else 10 end as budget from jb left join g on jb.job = g.job),
 q as (select *, {EDGE('budget * 35.0::double / present * t', 2)} as pt, {EDGE('budget * 40.0::double / present * e', 2)} as pe, {EDGE('budget * 25.0::double / present * d', 2)} as pd, {EDGE('10 * rec', 2)} as pr, {EDGE('10 * preference', 2)} as pp from a),
 z as (select *, round(coalesce(pt, 0) + coalesce(pe, 0) + coalesce(pd, 0) + coalesce(pr, 0) + coalesce(pp, 0), 2) as total from q)"""
EVENTS_SQL = f"b as ({BOARD.format(events='events')})"
LATEST = lambda c, given: f"arg_max({c}, seq) filter ({given})"
P_SQL = f"p as ({inputs.POSTINGS_SQL})"
#: Places are asked one by one: around the cut, then from the top; which are free depends on those before.
TIES_SQL = f"""with recursive o as (select o_orderkey as job, round(o_totalprice / 5000, 2) as score, o_orderkey % 9 = 0 as conflict from orders),
 top as (select *, row_number() over (order by score desc, job) as rank from o order by score desc, job limit 102),
 pr as (select a.rank as i, abs(a.score - b.score) <= {S.NEAR_TIE} and least(a.score, b.score) <> 0 and not a.conflict and not b.conflict as fits, b.job > a.job as swap from top a join top b on b.rank = a.rank + 1),
 st as (select 0 as n, []::bigint[] as got union all select n + 1, case when len(got) < 6 and exists (select 1 from pr where fits and i = ([100, 99, 101, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12])[n + 1])
  and len(list_filter(got, lambda g: abs(g - ([100, 99, 101, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12])[n + 1]) < 2)) = 0 then list_append(got, ([100, 99, 101, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12])[n + 1]) else got end from st where n < 15),
 mv as (select i from (select unnest(got) as i from st where n = 15) g join pr using (i) where swap)
 select (case when rank in (from mv) then rank + 1 when rank - 1 in (from mv) then rank - 1 else rank end)::bigint as rank, job, score from top"""
ORACLE_SQL = {
    "near_tie_order": TIES_SQL,
    "checked_judgements": f"with {CHECKED_SQL} select * from ck",
    "unmatched_judgements": "with l as (select l_orderkey as job, l_linenumber::bigint as idx, l_quantity from lineitem), a as (select job, idx, count(*) as asked from l where idx <= 5 group by all), g as (select job, idx, count(*) as given from l where l_quantity > 10 group by all) select * from (select coalesce(a.job, g.job) as job, coalesce(a.idx, g.idx) as idx, case when given is null then 'not judged' when asked is null then 'not asked' when given > 1 then 'judged twice' end as problem from a full join g on a.job = g.job and a.idx = g.idx) where problem is not null",
    "scored_jobs": f"with {SCORED_SQL} select job, case when coalesce(cf, false) and total > 20 then 20.0::double else total end as score, pt as p_technical, pe as p_experience, pd as p_domain, pr as p_recency, pp as p_preferences, case when cf and total > 20 then round(20 - total, 2) end as p_qualification_cap, case when not coalesce(he, false) then 'needs_review' when cf then 'conflict' when oe then 'needs_review' else 'no_known_conflict' end as eligibility, {EDGE('mc', 3)} as must_have_coverage, coalesce(mh, 0) as must_have_count, coalesce({EDGE('ns / n', 3)}, 0) as evidence_coverage, {EDGE('rec', 4)} as recency_alignment from z",
    "board_merge": f"with {EVENTS_SQL}, w as (select *, nullif(d_stamp, '') as stamp, nullif(d_status, '') as ds from b) select id, coalesce({LATEST('title', chr(116) + 'itle <> ' + chr(39) * 2)}, '') as title, coalesce({LATEST('company', 'company <> ' + chr(39) * 2)}, '') as company, {LATEST('status', 'true')} as status, {LATEST('is_open', 'is_open is not null')} as is_open, {LATEST('m_level', 'm_level <> ' + chr(39) * 2)} as level, case when bool_or(ds = 'complete') then 'complete' else arg_min(coalesce(ds, 'pending'), seq) end as detail_status, coalesce(arg_min(stamp, seq) filter (ds = 'complete' and stamp is not null), {LATEST('stamp', 'stamp is not null')}) as detail_collected_at, min(seq) as first_seen, max(seq) as last_seen from w group by id",
    "listing_overlay": f"with {P_SQL} select pos as key, case when title <> '' then title when pos % 2 = 0 then 'old title' else '' end as title, case when url <> '' then url when pos % 2 = 0 then coalesce(company, '') else '' end as url from p",
    "memo_hits": f"with {P_SQL}, k as (select pos, sha256(concat_ws('|', title, url)) as key from p), o as (select key, min(pos) as value from k where pos % 3 = 0 group by key), nw as (select key, -min(pos) as value from k where pos % 15 = 0 group by key), m as (select * from o where key not in (select key from nw) union all select * from nw) select pos, case when value % 2 = 0 then value end as value from k left join m on k.key = m.key",
    "page_prints": "with d as (select doc_id // 5 as page, doc_id % 5 as place, ((doc_id // 5) % 13 * 5 + doc_id % 5)::varchar as id from documents), f as (select page, sha256(string_agg(id, ',' order by place)) as print from d group by page) select print, count(*) as n, min(page) as first_page from f group by print having count(*) > 1",
    "throttle_intervals": "with recursive s as (select user_id as source, event_id as ord, case when event_type = 'error' then 'refused' when value > 60 then 'slow' else 'well' end as outcome, row_number() over (partition by user_id order by event_id) as n from events), f as (select source, 0::bigint as n, null::bigint as ord, null::varchar as outcome, 1.0::double as interval from (select distinct source from s) union all select s.source, s.n, s.ord, s.outcome, round(greatest(1.0::double, least(8.0::double, f.interval * case s.outcome when 'refused' then 2.0 when 'slow' then 1.5 else 0.9 end::double)), 6) from f join s on s.source = f.source and s.n = f.n + 1) select source, ord, outcome, interval from f where n > 0",
    "unit_vectors": "with e as (select vec_id, list_transform(embedding, lambda x: x::double * (vec_id % 7)) as v from embeddings), u as (select vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) as u from e) select vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) as square, round(u[1], 6) + 0.0::double as first from u",
    "hash_material": f"""with {P_SQL} select pos, sha256('{{"company":"' || company || '","id":"' || id || '","title":"' || title || '"}}') as hash from p""",
    "import_rows": f"with {P_SQL}, k as (select *, pos % 10 <> 3 and title <> '' as good from p where pos < 10000) select id, title, '' as company, is_open, count(*) as n from k where good group by all union all select 'bad', '', '', null, count(*) from k where not good",
    "csv_export": f"with {P_SQL} select pos::varchar as rank, (pos % 100 / 4.0::double)::varchar as score, case when pos % 5 = 0 then '''=' || title else title end as title, company, 'a | b \"q\"' as matched_skills, '{{\"relevance\":1.5}}' as score_breakdown, '''-' || location as location, '' as criteria from p",
    "lexical_fusion": f"with {BM25_SQL}, l as (select documents.doc_id, coalesce(score, 0) as lex from documents left join bm using (doc_id)), f as (select doc_id, lex / coalesce(nullif((select max(lex) from l), 0), 1) as fused from l) select doc_id, round(fused, 6) as fused, row_number() over (order by fused desc, doc_id) as pos from f",
    "wire_values": "select event_id, case when event_id % 4 = 0 then -1 else user_id end as number from events",
}
