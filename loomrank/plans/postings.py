"""Queries over built postings: renderings, keys, rules and the split, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrank.functions import postings as P
from loomrank.functions import text as T
from loomrank.operators import eligibility as E
from loomrank.plans import inputs
from loomrank.plans.matching import sql_collapse
from loomrank.plans.sqltext import sql_digits, sql_mentions

KEYWORDS, LIMIT = ["docker", "scrum", "marketing"], 8


def with_metadata(df):
    names = {"posting_status": "m_status", "Work Term Duration": "m_term", "detail_text": "m_detail", "seats": "m_seats"}
    pairs = [x for k, c in names.items() for x in (F.lit(k), F.col(c).cast("string"))]
    return df.withColumn("metadata", F.map_filter(F.create_map(*pairs), lambda k, v: v != "")).drop(*names.values())


def rendered(spark, sf_dir):
    df = with_metadata(inputs.postings(spark, sf_dir))
    return df.withColumn("text", P.job_text(F.col("metadata"))).withColumn("key", P.dedupe_key()).withColumn("closed", E.is_closed(F.col("metadata")))


def meta(key: str, column: str) -> str:
    return f"case when {column} <> '' then '{key}: ' || {column} end"


METADATA = [meta("posting_status", "m_status"), meta("Work Term Duration", "m_term"), meta("detail_text", "m_detail"), "'seats: ' || m_seats"]
CLOSED = "'closed','expired','cancelled','canceled','filled','archived','applications closed','posting closed'"
SHAPE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^#]*)"
folded = lambda c: f"replace(lower({sql_collapse(c)}), 'ß', 'ss')"
RENDERED_SQL = f"""p as ({inputs.POSTINGS_SQL}),
 r as (select *, concat_ws(chr(10), nullif(title, ''), nullif(company, ''), nullif(location, ''), nullif(description, ''), nullif(requirements, ''), {', '.join(METADATA)}) as text,
  case when trim(id) <> '' then 'id:' || replace(lower(trim(id)), 'ß', 'ss') when trim(url) <> '' then 'url:' || lower(regexp_extract(trim(url), '{SHAPE}', 1)) || '://' || lower(regexp_extract(trim(url), '{SHAPE}', 2)) || regexp_extract(trim(url), '{SHAPE}', 3)
   else 'content:' || {folded('title')} || chr(31) || {folded('company')} || chr(31) || {folded('location')} end as key,
  {folded('status')} in ({CLOSED}) or {folded('m_status')} in ({CLOSED}) or coalesce(not is_open, false) as closed from p)"""
CLEAN = "trim(coalesce(deadline, ''))"
for pattern, by, flags in ((r"\s*\((?:EST|EDT|ET)\)\s*$", "", "i"), (r"\s+(?:EST|EDT|ET)$", "", "i"), (r"\s+at\s+", " ", "gi"), (r"(\d)(?:st|nd|rd|th)\b", r"\1", "gi")):
    CLEAN = f"regexp_replace({CLEAN}, '{pattern}', '{by}', '{flags}')"
STATE_SQL = rf"""dl as (select *, {CLEAN} as dt from r),
 ds as (select *, try_strptime(dt, ['%b %d, %Y', '%B %d, %Y', '%Y/%m/%d', '%d %b %Y', '%d-%b-%Y', '%Y-%m-%d'])::date < timestamp '{inputs.NOW}'::date as p1,
  try_strptime(dt, ['%b %d, %Y %I:%M %p', '%B %d, %Y %I:%M %p', '%b %d, %Y %H:%M', '%B %d, %Y %H:%M', '%Y-%m-%d %I:%M %p', '%Y/%m/%d %H:%M', '%m/%d/%Y %I:%M %p', '%d %b %Y %H:%M', '%Y-%m-%d %H:%M', '%Y-%m-%dT%H:%M:%S']) < timestamp '{inputs.NOW}' as p2,
  try_strptime(regexp_replace(dt, '(Z|[+-]\d\d:?\d\d)$', ''), ['%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M', '%Y-%m-%dT%H', '%Y%m%dT%H%M%S', '%Y%m%d']) as wall,
  case when regexp_matches(dt, ':.*[+-]\d\d:?\d\d$') then replace(regexp_extract(dt, '[+-]\d\d:?\d\d$'), ':', '') when dt like '%Z' then '+0000' end as off from dl),
 dz as (select *, case when off is null then wall < timestamp '{inputs.NOW}' else wall - to_minutes((off[2:3]::int * 60 + off[4:5]::int) * case when off[1] = '-' then -1 else 1 end) < timestamp '{inputs.NOW_UTC}' end as p3 from ds),
 st as (select * exclude (p1, p2, p3, wall, off), case when dt = '' then 'blank' when coalesce(p1, p3, p2) is null then 'unread' when coalesce(p1, p3, p2) then 'passed' else 'open' end as state from dz)"""
WAIVED = " or ".join(f"regexp_matches(c, '{w}', 'i')" for w in E.WAIVERS)
RESTRICTION = rf"""list_filter(list_transform(list_transform([title, description, requirements, {', '.join(METADATA)}], lambda t: regexp_replace(regexp_replace(coalesce(t, ''), 'https?://\S+', '', 'g'), '\bU\.S\.(?:A\.)?', 'US', 'gi')),
  lambda t: case when regexp_matches(t, '{E.PROGRAM}', 'i') then 'programme' else list_filter(list_transform(list_transform(string_split_regex(t, '(?i)[\n;.!?。；]+|\bbut\b'), lambda c: {sql_collapse("replace(c, ':', ' ')")}),
   lambda c: case when not ({WAIVED}) and regexp_matches(c, '{E.DEMAND}', 'i') then regexp_extract(c, '{E.DEMAND}', 0, 'i') end), lambda x: x is not null)[1] end), lambda x: x is not null)[1]"""
MONTHS = lambda s: rf"list_filter(list_transform(regexp_extract_all(' ' || {s}, '(?i)[^\p{{L}}\p{{N}}_](\d{{1,2}})\s*[-–]?\s*month', 1), lambda m: m::int), lambda m: m between 1 and 24)"
SENTENCE = rf"list_filter(list_transform([m_term, regexp_extract(m_detail, 'Work Term Duration:\s*\n(.{{0,120}})', 1), requirements, description, title], lambda s: list_filter(string_split_regex({sql_digits('s')}, '[\n;.](\s|$)'), lambda x: len({MONTHS('x')}) > 0)[1]), lambda x: x is not null)[1]"
TERM_SQL = f"""ts as (select *, {SENTENCE} as sentence from st),
 tm as (select *, list_min({MONTHS('sentence')}) as shortest, list_max({MONTHS('sentence')}) as longest, coalesce(regexp_matches(sentence, '{E.TERM_FIRM}', 'i') and not regexp_matches(sentence, '{E.TERM_OPEN}', 'i'), false) as firm, case when sentence is not null then {sql_collapse("sentence")}[:300] else '' end as quote from ts)"""
MERGED_SQL = f"""m as (select key, arg_max(r, {{'a': length(text), 'b': -pos}}) as row, min(pos) as first_pos, bool_or(closed) as any_closed, count(*) as copies from r group by key)"""
HITS = "concat_ws(', ', " + ", ".join(f"case when {sql_mentions('text', k)} then '{k}' end" for k in KEYWORDS) + ")"


def posting_documents(spark, sf_dir):
    df = rendered(spark, sf_dir)
    document = P.job_document(F.col("metadata"))
    return df.select("pos", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("text_hash"), P.cache_key(document).alias("cache_key"), F.sha2(P.retrieval_text(), 256).alias("retrieval_hash"), P.embedding_key("small", F.col("title")).alias("embedding_key"), F.array_join(P.leaves(F.col("metadata")), "|").alias("leaves"))


def dedupe_keys(spark, sf_dir):
    return rendered(spark, sf_dir).select("pos", "key")


def dedupe_merged(spark, sf_dir):
    return E.merged_duplicates(rendered(spark, sf_dir)).select("key", "pos", "first_pos", "closed", "copies")


def deadline_states(spark, sf_dir):
    return rendered(spark, sf_dir).select("pos", E.deadline_state(F.col("deadline"), inputs.NOW, inputs.ZONE).alias("state"))


def restrictions(spark, sf_dir):
    return rendered(spark, sf_dir).select("pos", E.restriction(E.rule_texts(F.col("metadata"))).alias("restriction"))


def term_facts(spark, sf_dir):
    df = rendered(spark, sf_dir).select("pos", E.term_sentence(F.col("metadata")).alias("sentence")).select("pos", E.term_facts(F.col("sentence")).alias("t"))
    return df.select("pos", F.col("t.shortest").cast("long").alias("shortest"), F.col("t.longest").cast("long").alias("longest"), F.col("t.firm").alias("firm"), F.col("t.quote").alias("quote"))


def posting_split(spark, sf_dir):
    """Rows that the rules exclude, those that stay with their warning, and repeated postings, in one table."""
    return E.split_duplicates(rendered(spark, sf_dir), inputs.NOW, inputs.ZONE, KEYWORDS, E.term_limit(None, [4, LIMIT]))


def result_search(spark, sf_dir):
    return rendered(spark, sf_dir).where(P.found_by(" DATA analyst", "title", "company", "location")).select("pos", "title")


def board_rows(spark, sf_dir):
    """Lookups of the board: by many ids at once, by one id, and the count on board."""
    df = inputs.postings(spark, sf_dir).where(F.coalesce("is_open", F.lit(True)))
    wanted = df.where("pos % 97 = 0 and id <> ''").select("id").distinct()
    many = df.join(wanted, "id", "left_semi").select(F.lit("many").alias("kind"), "pos")
    single = df.where("id = 'Job-6'").select(F.lit("one").alias("kind"), "pos")
    return many.unionByName(single).unionByName(df.agg(F.lit("count").alias("kind"), F.count("*").alias("pos")))


def address_kinds(spark, sf_dir):
    df = inputs.postings(spark, sf_dir).select("pos", F.when(F.col("url") == "", P.placeholder_url(F.col("pos").cast("string"))).otherwise(F.col("url")).alias("address"))
    return df.select("pos", "address", P.is_placeholder(F.col("address")).alias("placeholder"))


QUERIES = {f.__name__: f for f in (posting_documents, dedupe_keys, dedupe_merged, deadline_states, restrictions, term_facts, posting_split, result_search, board_rows, address_kinds)}
DOCUMENT = "concat_ws(chr(10), 'title: ' || title, 'company: ' || company, 'location: ' || location, 'description: ' || description, 'requirements: ' || requirements, " + meta("detail_text", "m_detail") + ", " + meta("Work Term Duration", "m_term") + ")"
REASON = f"case when closed then 'closed' when state = 'passed' then 'expired' when restricted is not null then 'restricted: ' || restricted when hits <> '' then 'keywords: ' || hits when shortest > {LIMIT} then 'term: ' || shortest || ' > {LIMIT}: ' || quote else '' end"
ORACLE_SQL = {
    "posting_documents": f"with {RENDERED_SQL} select pos, length(text) as chars, sha256(text) as text_hash, 'requirements:1:' || sha256({sql_collapse(DOCUMENT)}) as cache_key, sha256(concat_ws(' ', title, title, company, location, description, requirements)) as retrieval_hash, sha256('small' || chr(0) || title) as embedding_key, concat_ws('|', {', '.join(METADATA)}) as leaves from r",
    "dedupe_keys": f"with {RENDERED_SQL} select pos, key from r",
    "dedupe_merged": f"with {RENDERED_SQL}, {MERGED_SQL} select key, row.pos as pos, first_pos, any_closed as closed, copies from m",
    "deadline_states": f"with {RENDERED_SQL}, {STATE_SQL} select pos, state from st",
    "restrictions": f"with {RENDERED_SQL} select pos, {RESTRICTION} as restriction from r",
    "term_facts": f"with {RENDERED_SQL}, {STATE_SQL}, {TERM_SQL} select pos, shortest::bigint as shortest, longest::bigint as longest, firm, quote from tm",
    "posting_split": f"with {RENDERED_SQL.replace(' r as (', ' r0 as (')}, {MERGED_SQL.replace('arg_max(r,', 'arg_max(r0,').replace('from r ', 'from r0 ')}, r as (select row.* exclude (closed), any_closed as closed from m), {STATE_SQL}, {TERM_SQL}, z as (select pos, closed, state, shortest, quote, {RESTRICTION} as restricted, {HITS} as hits from tm), q as (select pos, state, {REASON} as reason from z) select r0.pos, 'duplicate' as reason, '' as warning from r0 join m on r0.key = m.key where r0.pos > first_pos union all select pos, reason, case when reason = '' and state in ('blank', 'unread') then 'deadline ' || state else '' end from q",
    "result_search": f"with p as ({inputs.POSTINGS_SQL}) select pos, title from p where contains(lower(concat_ws(' ', title, company, location)), 'data analyst')",
    "board_rows": f"with p as ({inputs.POSTINGS_SQL}), b as (select * from p where coalesce(is_open, true)) select 'many' as kind, pos from b where id in (select id from b where pos % 97 = 0 and id <> '') union all select 'one', pos from b where id = 'Job-6' union all select 'count', count(*) from b",
    "address_kinds": f"with p as ({inputs.POSTINGS_SQL}) select pos, case when url = '' then '{P.BOARD}#job-' || pos else url end as address, url = '' as placeholder from p",
}
