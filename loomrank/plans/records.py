"""Queries of rules, deduplication, merging, verification, structure and reporting, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomrank.functions import scores as S
from loomrank.functions import text as T
from loomrank.operators import retrieval as R
from loomrank.operators import rules, scoring
from loomrank.plans.matching import read, sql_collapse
from loomrank.plans.sqltext import sql_digits, sql_mentions
from loomrank.sources import html as H
from loomrank.streaming.upsert import stream_distinct, stream_upsert

NOW = "2024-01-20 12:00:00"
TERMS = [(1, "You stay for eight-month blocks, without a break."), (2, "Every term is 8 month long."), (3, "Twelve-month terms come first, though four-month ones count the same."), (4, "Four-month stay."), (5, "Plan for a 12 month contract."), (6, "Tea is free.")]
TERM_VALUES = ", ".join(f"({i}, '{t}')" for i, t in TERMS)
SKILLS = {"Th": ["the"], "On": ["on", "onto"], "Er": ["er"], "And": ["and"], "Python": ["python", "python3"]}


def dedupe_richest(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return rules.keep_richest(docs, T.content_hash(F.col("text")), F.col("n_chars"), "doc_id", F.col("source") == "src0")


def posting_rules():
    return [("closed", F.col("o_orderstatus") == "F"), ("expired", F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")), ("keyword", T.mentions(F.col("o_orderpriority"), "LOW")), ("term", F.col("o_totalprice") > 400000)]


def eligibility_split(spark, sf_dir):
    return rules.split_by_reason(read(spark, sf_dir, "orders"), posting_rules()).select("o_orderkey", "reason")


REASON_SQL = r"case when o_orderstatus = 'F' then 'closed' when o_orderdate < timestamp '1996-01-01' then 'expired' when regexp_matches(lower(o_orderpriority), '(^|[^\p{L}\p{N}_])low([^\p{L}\p{N}_]|$)') then 'keyword' when o_totalprice > 400000 then 'term' else '' end"


def run_counters(spark, sf_dir):
    df = rules.split_by_reason(read(spark, sf_dir, "orders"), posting_rules())
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("reason") == "").alias("eligible"), F.count_if(F.col("reason") != "").alias("excluded"), F.count_if(F.col("reason") == "closed").alias("closed"))


def keyword_mentions(spark, sf_dir):
    words = ["the", "que", "und", "les", "go"]
    docs = read(spark, sf_dir, "documents").select("doc_id", F.array_compact(F.array(*[F.when(T.mentions(F.col("text"), w), F.lit(w)) for w in words])).alias("hits"))
    return docs.select("doc_id", F.array_join("hits", ",").alias("hits")).where("hits <> ''")


def clause_rule_filter(spark, sf_dir):
    c = rules.offending_clause(F.col("text"), r"(?i)\blicensed\b|\blicense\b", r"(?i)\bnot\b|\bpreferred\b")
    return read(spark, sf_dir, "documents").select("doc_id", c.alias("clause")).where("clause is not null")


def shortest_term(spark, sf_dir):
    rows = spark.createDataFrame(TERMS, "id long, text string")
    docs = read(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), F.concat("text", F.lit(". "), (F.col("doc_id") % 30).cast("string"), F.lit(" months")).alias("text"))
    return rows.unionByName(docs).select("id", F.get(T.term_months(F.col("text")), F.lit(0)).cast("long").alias("shortest"))


def criteria(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    category = F.element_at(F.array(*[F.lit(c) for c in ("technical", "experience", "domain", "eligibility", "soft")]), (F.col("l_linenumber") % 5 + 1).cast("int"))
    months = (2000 - F.year("l_shipdate")) * 12
    return li.select("l_orderkey", category.alias("category"), F.when(F.col("l_linestatus") == "O", "must").otherwise("preferred").alias("importance"), F.when(F.col("l_returnflag") == "A", "direct").when(F.col("l_returnflag") == "N", "transferable").otherwise("missing").alias("status"), F.when(F.col("l_linenumber") != 4, S.recency_weight(months)).alias("recency"))


CRITERIA_SQL = """c as (select l_orderkey, (['technical','experience','domain','eligibility','soft'])[l_linenumber % 5 + 1] as cat, case when l_linestatus = 'O' then 'must' else 'preferred' end as imp, case when l_linestatus = 'O' then 2.0 else 1.0 end::double as w, case l_returnflag when 'A' then 1.0 when 'N' then 0.6 else 0.0 end::double as cr, case when l_linenumber <> 4 then round(0.4 + 0.6 * pow(0.5, (2000 - year(l_shipdate)) * 12 / 24.0), 4) end as rec from lineitem),
 g as (select l_orderkey, sum(w * cr) filter (cat = 'technical') as tc, sum(w) filter (cat = 'technical') as tw, sum(w * cr) filter (cat = 'experience') as ec, sum(w) filter (cat = 'experience') as ew, sum(w * cr) filter (cat = 'domain') as dc, sum(w) filter (cat = 'domain') as dw,
  round(sum(w * cr) filter (imp = 'must' and cat in ('technical','experience','domain')) / sum(w) filter (imp = 'must' and cat in ('technical','experience','domain')) + 1e-9, 6) as must_have_coverage, count(*) filter (imp = 'must') as must_have_count, round(sum(w * rec) filter (cr > 0 and rec is not null) / sum(w) filter (cr > 0 and rec is not null) + 1e-9, 6) as evidence_recency from c group by l_orderkey),
 p as (select *, case when tw > 0 then 35 else 0 end + case when ew > 0 then 40 else 0 end + case when dw > 0 then 25 else 0 end as present, 100 - case when evidence_recency is not null then 10 else 0 end as budget from g)"""


def score_criteria(spark, sf_dir):
    return scoring.score_criteria(criteria(spark, sf_dir), "l_orderkey").select("l_orderkey", "score", "must_have_count")


def must_have_coverage(spark, sf_dir):
    return scoring.coverage(criteria(spark, sf_dir), "l_orderkey").select("l_orderkey", "must_have_coverage", "must_have_count")


def evidence_recency(spark, sf_dir):
    return scoring.coverage(criteria(spark, sf_dir), "l_orderkey").select("l_orderkey", "evidence_recency")


def preference_fraction(spark, sf_dir):
    frac = scoring.preference_fraction([T.mentions(F.col("p_name"), "1") | T.mentions(F.col("p_type"), "steel"), T.mentions(F.col("p_brand"), "Brand#11")])
    return read(spark, sf_dir, "part").select("p_partkey", F.round(frac, 6).alias("fraction"))


def quote_verify(spark, sf_dir):
    """Quotes and documents meet on a hash; where they do, the whole quote is looked for in the body.

    The words of a long quote but its first and last are words of the body too, so quotes of five words meet on their
    second to fourth. Shorter ones meet on their first eight characters; bodies are cut so finely only if there are any.
    """
    quotes = read(spark, sf_dir, "benchmark").select("item_id", T.collapse(F.col("text")).alias("quote")).withColumn("q", F.split("quote", " ")).where("length(quote) >= 8")
    docs = read(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text")).alias("body")).withColumn("words", F.split("body", " "))
    grams = F.transform("words", lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1), F.get(F.col("words"), i + 2)))
    long = quotes.where("size(q) >= 5").select("item_id", F.xxhash64(F.get("q", F.lit(1)), F.get("q", F.lit(2)), F.get("q", F.lit(3))).alias("key"))
    hits = docs.select("doc_id", F.explode(F.array_distinct(grams)).alias("key")).join(R.small(long), "key").select("doc_id", "item_id")
    short = quotes.where("size(q) < 5").select("item_id", F.xxhash64(F.substring("quote", 1, 8)).alias("key"))
    if not short.isEmpty():
        places = F.sequence(F.lit(1), F.greatest(F.length("body") - 7, F.lit(1)))
        pieces = F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substring("body", i, F.lit(8)))))
        hits = hits.unionByName(docs.select("doc_id", F.explode(pieces).alias("key")).join(R.small(short), "key").select("doc_id", "item_id"))
    # bodies are fetched for the few that meet
    both = docs.select("doc_id", "body").join(hits.distinct(), "doc_id").join(R.small(quotes.select("item_id", "quote")), "item_id")
    return both.where(F.instr("body", F.col("quote")) > 0).select("item_id", "doc_id").distinct()


def quote_block_first(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.collapse(F.col("text")).alias("body"))
    quote = F.substring("body", 3, 12)
    quotes = turns.where("turn = 1").select("conv_id", quote.alias("quote")).where("length(quote) >= 8")
    hits = turns.join(quotes, "conv_id").where(F.instr("body", F.col("quote")) > 0)
    return hits.groupBy("conv_id", "quote").agg(F.min("turn").alias("first_turn"))


def interval_attribution(spark, sf_dir):
    """Each error belongs to the sign-up interval that it falls in: the latest sign-up before it."""
    ev = read(spark, sf_dir, "events").where("event_type in ('signup', 'error')").select("event_id", "user_id", "ts", "event_type")
    got = rules.latest_before(ev, "user_id", "ts", F.date_trunc("day", "ts"), F.col("event_type") == "signup", "event_id")
    return got.where("event_type = 'error' and latest is not null").select(F.col("event_id").alias("mention"), F.col("latest").alias("block_event"))


def segment_blocks(spark, sf_dir):
    turns = rules.islands(read(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")
    return turns.groupBy("conv_id", "block").agg(F.min("turn").alias("first_turn"), F.count("*").alias("lines"))


def skill_tiers(spark, sf_dir):
    """The strongest evidence of each skill: shown in a user's turn, attributed to an assistant's, or merely listed."""
    turns = read(spark, sf_dir, "conversations")
    tier = F.when(F.col("role") == "user", 3).when(F.col("role") == "assistant", 2).otherwise(1)
    hits = F.array_compact(F.array(*[F.when(sum((T.mentions(F.col("text"), a).cast("int") for a in names), F.lit(0)) > 0, F.lit(k)) for k, names in SKILLS.items()]))
    return turns.select("conv_id", tier.alias("tier"), F.explode(hits).alias("skill")).groupBy("conv_id", "skill").agg(F.max("tier").cast("long").alias("tier"))


def months_of(orders, li):
    """The month rules over all line items of ``orders``."""
    months = (F.year("l_shipdate") - F.year("o_orderdate")) * 12 + F.month("l_shipdate") - F.month("o_orderdate")
    return li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.when((months + 1).between(1, 600), months + 1).cast("long").alias("months"), F.greatest(F.lit(0), (2000 - F.year("l_shipdate")) * 12 + 1 - F.month("l_shipdate")).cast("long").alias("since"))


def months_between_incl(spark, sf_dir):
    return months_of(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"))


def event_rows(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("status"), F.when(F.col("event_id") % 3 != 0, F.round("value", 6)).alias("latency"))


def upsert_latest_nonblank(spark, sf_dir):
    return rules.upsert(event_rows(spark, sf_dir), "user_id", ["ts", "event_id"], ["status", "latency"])


UPSERT_SQL = "select user_id, arg_max(case when event_type = 'error' then '' else event_type end, {'a': ts, 'b': event_id}) filter (event_type <> 'error') as status, arg_max(round(value, 6), {'a': ts, 'b': event_id}) filter (event_id % 3 <> 0 and value is not null) as latency, min(ts) as first_seen, max(ts) as last_seen from events group by user_id"


def retire_off_board(spark, sf_dir):
    docs, keep = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("kept"))
    return docs.join(keep, "doc_id", "left").select("doc_id", F.coalesce("kept", F.lit(False)).alias("on_board"))


def fresh_details(spark, sf_dir):
    ev = read(spark, sf_dir, "events").where(F.col("ts").between(F.lit("2024-01-19 12:00:00").cast("timestamp"), F.lit(NOW).cast("timestamp")))
    return ev.where(rules.is_fresh(F.col("ts"), NOW)).select("event_id", "user_id")


def kind_counts(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


def content_hash_groups(spark, sf_dir):
    g = read(spark, sf_dir, "documents").groupBy(T.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return g.where("n > 1")


def csv_guard(spark, sf_dir):
    value = F.concat(F.element_at(F.array(F.lit("="), F.lit(""), F.lit(" +"), F.lit("a")), (F.col("doc_id") % 4 + 1).cast("int")), "source")
    return read(spark, sf_dir, "documents").select("doc_id", T.csv_guard(value).alias("guarded"))


def url_allowlist(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", H.allowed_url(F.col("url"), scheme="https", host=r"[a-z0-9.]+\.example\.(?:com|org|net)", path=r"/(?:en|fr|de|es)/\d+", keys=["page", "ref"]).alias("url")).where("url is not null")


def html_fields(spark, sf_dir):
    return H.page_fields(read(spark, sf_dir, "pages"))


def near_tie_pairs(spark, sf_dir):
    top = read(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("score")).orderBy(F.col("score").desc(), "o_orderkey").limit(1000)
    w = Window.orderBy(F.col("score").desc(), "o_orderkey")  # over the bounded top
    pairs = top.select(F.col("o_orderkey").alias("first"), F.lead("o_orderkey").over(w).alias("second"), F.round(F.col("score") - F.lead("score").over(w), 2).alias("gap"), F.row_number().over(w).cast("long").alias("pos"))
    return pairs.where(F.col("gap") <= 30 * S.NEAR_TIE)


def final_rank(spark, sf_dir):
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    best = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.round("o_totalprice", 2).alias("score"), F.lower("c_name").alias("company"), F.lower("o_orderpriority").alias("title"))
    order = [F.col("score").desc(), F.col("company"), F.col("title"), F.col("o_orderkey")]
    return best.orderBy(*order).limit(100).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


QUERIES = {f.__name__: f for f in (dedupe_richest, eligibility_split, run_counters, keyword_mentions, clause_rule_filter, shortest_term, score_criteria, must_have_coverage, evidence_recency, preference_fraction, quote_verify, quote_block_first, interval_attribution, segment_blocks, skill_tiers, months_between_incl, upsert_latest_nonblank, retire_off_board, fresh_details, kind_counts, content_hash_groups, csv_guard, url_allowlist, html_fields, near_tie_pairs, final_rank, stream_upsert, stream_distinct)}


SKILL_CASES = " union all ".join(f"select conv_id, role, '{k}' as skill from conversations where " + " or ".join(sql_mentions("text", a) for a in names) for k, names in SKILLS.items())
ORACLE_SQL = {
    "dedupe_richest": f"select sha256({sql_collapse('text')}) as grp, arg_max(doc_id, {{'a': n_chars, 'b': -doc_id}}) as kept, min(doc_id) as first_seen, count(*) as n, max(case when source = 'src0' then 1 else 0 end) as closed from documents group by 1",
    "eligibility_split": f"select o_orderkey, {REASON_SQL} as reason from orders",
    "run_counters": f"with r as (select {REASON_SQL} as reason from orders) select count(*) as total, count(*) filter (reason = '') as eligible, count(*) filter (reason <> '') as excluded, count(*) filter (reason = 'closed') as closed from r",
    "keyword_mentions": "select * from (select doc_id, concat_ws(',', " + ", ".join(f"case when {sql_mentions('text', w)} then '{w}' end" for w in ("the", "que", "und", "les", "go")) + ") as hits from documents) where hits <> ''",
    "clause_rule_filter": rf"select * from (select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '(?i)[\n;.!?。；]+|\bbut\b'), lambda c: {sql_collapse("replace(c, ':', ' ')")}), lambda c: regexp_matches(c, '(?i)\blicensed\b|\blicense\b') and not regexp_matches(c, '(?i)\bnot\b|\bpreferred\b'))[1] as clause from documents) where clause is not null",
    "shortest_term": rf"with s as (select * from (values {TERM_VALUES}) v(id, text) union all select doc_id + 1000, text || '. ' || (doc_id % 30) || ' months' from documents), p as (select id, list_filter(list_transform(string_split_regex({sql_digits('text')}, '[\n;.](\s|$)'), lambda x: list_filter(list_transform(regexp_extract_all(' ' || x, '(?i)[^\p{{L}}\p{{N}}_](\d{{1,2}})\s*[-–]?\s*month', 1), lambda m: m::int), lambda m: m between 1 and 24)), lambda l: len(l) > 0)[1] as months from s) select id::bigint as id, list_min(months)::bigint as shortest from p",
    "score_criteria": f"with {CRITERIA_SQL} select l_orderkey, round(case when tw > 0 then budget * 35.0::double / present * tc / tw else 0 end + case when ew > 0 then budget * 40.0::double / present * ec / ew else 0 end + case when dw > 0 then budget * 25.0::double / present * dc / dw else 0 end + coalesce(10 * evidence_recency, 0) + 1e-9, 4) as score, must_have_count from p",
    "must_have_coverage": f"with {CRITERIA_SQL} select l_orderkey, must_have_coverage, must_have_count from p",
    "evidence_recency": f"with {CRITERIA_SQL} select l_orderkey, evidence_recency from p",
    "preference_fraction": f"select p_partkey, round(((case when {sql_mentions('p_name', '1')} or {sql_mentions('p_type', 'steel')} then 1.0 else 0.0 end) + (case when {sql_mentions('p_brand', 'brand#11')} then 1.0 else 0.0 end))::double / 2, 6) as fraction from part",
    "quote_verify": f"with q as (select item_id, {sql_collapse('text')} as quote from benchmark), d as (select doc_id, {sql_collapse('text')} as body from documents) select item_id, doc_id from q, d where length(quote) >= 8 and contains(body, quote)",
    "quote_block_first": f"with t as (select conv_id, turn, {sql_collapse('text')} as body from conversations), q as (select conv_id, substr(body, 3, 12) as quote from t where turn = 1) select q.conv_id, quote, min(turn) as first_turn from t join q using (conv_id) where length(quote) >= 8 and contains(body, quote) group by all",
    "interval_attribution": "select m.event_id as mention, arg_max(b.event_id, {'a': b.ts, 'b': b.event_id}) as block_event from events m join events b on m.user_id = b.user_id and b.event_type = 'signup' and b.ts <= m.ts where m.event_type = 'error' group by m.event_id",
    "segment_blocks": "with s as (select conv_id, turn, greatest(1, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding))::bigint as block from conversations) select conv_id, block, min(turn) as first_turn, count(*) as lines from s group by all",
    "skill_tiers": f"select conv_id, skill, max(case role when 'user' then 3 when 'assistant' then 2 else 1 end)::bigint as tier from ({SKILL_CASES}) group by all",
    "months_between_incl": "with m as (select l_orderkey, l_linenumber, l_shipdate, (year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate) + 1 as months from lineitem join orders on l_orderkey = o_orderkey) select l_orderkey, l_linenumber::bigint as l_linenumber, case when months between 1 and 600 then months end as months, greatest(0, (2000 - year(l_shipdate)) * 12 + 1 - month(l_shipdate))::bigint as since from m",
    "upsert_latest_nonblank": UPSERT_SQL,
    "retire_off_board": "select d.doc_id, l.doc_id is not null as on_board from documents d left join labels l using (doc_id)",
    "fresh_details": f"select event_id, user_id from events where epoch(timestamp '{NOW}') - floor(epoch(ts)) >= 0 and epoch(timestamp '{NOW}') - floor(epoch(ts)) < 86400 and ts <= timestamp '{NOW}'",
    "kind_counts": "select event_type, count(*) as n from events group by 1",
    "content_hash_groups": f"select * from (select sha256({sql_collapse('text')}) as hash, count(*) as n, min(doc_id) as first from documents group by 1) where n > 1",
    "csv_guard": r"with v as (select doc_id, (['=', '', ' +', 'a'])[doc_id % 4 + 1] || source as v from documents) select doc_id, case when regexp_matches(ltrim(v), '^[=+\-@]') or regexp_matches(v, '^[\t\r]') then '''' || v else v end as guarded from v",
    "url_allowlist": r"select page_id, regexp_replace(url, '#.*$', '') as url from pages where regexp_full_match(regexp_replace(url, '#.*$', ''), 'https://[a-z0-9.]+\.example\.(com|org|net)/(en|fr|de|es)/\d+(\?(page|ref)=[^&=]*(&(page|ref)=[^&=]*)*)?')",
    "html_fields": r"select page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) as title, len(regexp_extract_all(html, '<a\s[^>]*href=')) as links from pages",
    "near_tie_pairs": "with t as (select o_orderkey, round(o_totalprice, 2) as score from orders order by score desc, o_orderkey limit 1000), p as (select o_orderkey as first, lead(o_orderkey) over (order by score desc, o_orderkey) as second, round(score - lead(score) over (order by score desc, o_orderkey), 2) as gap, row_number() over (order by score desc, o_orderkey) as pos from t) select * from p where gap <= 90",
    "final_rank": "with b as (select o_orderkey, round(o_totalprice, 2) as score, lower(c_name) as company, lower(o_orderpriority) as title from orders join customer on o_custkey = c_custkey order by score desc, company, title, o_orderkey limit 100) select *, row_number() over (order by score desc, company, title, o_orderkey) as rank from b",
    "stream_upsert": UPSERT_SQL,
    "stream_distinct": "select distinct user_id from events",
}
