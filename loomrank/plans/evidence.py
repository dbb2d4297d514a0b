"""Queries of nested metadata, requirement chunks, evidence under a budget, and the board as a table: replaced, looked up,
with failures, as JSON. Each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.operators import board as B
from loomrank.operators import eligibility as E
from loomrank.operators import evidence as V
from loomrank.operators import nested as N
from loomrank.operators import retrieval as R
from loomrank.operators.board import FIELDS
from loomrank.plans import crawl as C
from loomrank.plans import inputs
from loomrank.plans.matching import read, sql_collapse
from loomrank.plans.postings import METADATA, RESTRICTION
from loomrank.sources import exchange as X
from loomrank.streaming import crawl as K
from loomrank.streaming.upsert import shared_folder

# Metadata of some depth; keys in the order of their names.
NESTED = """select pos, '{{"Citizenship": "' || case pos % 5 when 0 then 'Required' when 1 then 'not required' else 'any' end || '", "details": {{"Level": ["Junior", ' || cast(pos as string) || ', null, {{"note": "' || requirements || '"}}, [["deep"]]], "empty": []}}, "open": '
 || case when pos % 2 = 0 then 'true' else 'null' end || ', "seats": ' || cast(m_seats as string) || ', "status": "open", "z": {{}}}}' as meta from {p}"""


def nested_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(NESTED, p=inputs.postings(spark, sf_dir)).select("pos", F.parse_json("meta").alias("meta"))
    got = N.nested_texts(df, "pos", "meta")
    return got.select("pos", F.array_join("leaves", "|").alias("leaves"), "flat", E.restriction(F.col("leaves")).alias("restriction"))


REMEMBERED = "case when pos % 3 = 0 then array(struct('Know  Python ' || cast(pos as string) as text, 'must' as importance), struct('' as text, 'must' as importance), struct('Like ' || company as text, 'preferred' as importance)) when pos % 3 = 1 then array() end"


def posting_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.postings(spark, sf_dir)
    memo = p.where("pos % 3 < 2").select("pos", F.expr(REMEMBERED).cast("array<struct<text: string, importance: string>>").alias("asked"))
    return V.chunk_rows(p, "pos", memo)


def requirement_chunks(spark, sf_dir):
    """Of each posting its remembered requirements, or else its sentences."""
    return posting_chunks(spark, sf_dir)


def requirement_similarity(spark, sf_dir):
    """Postings by the vectors of their chunks; recency from vocabulary where no chunk of any posting has one."""
    e = read(spark, sf_dir, "embeddings")
    n = e.count()
    chunks = posting_chunks(spark, sf_dir).withColumn("vec_id", (F.col("pos") * 7 + F.col("ord")) % n)
    profile = e.where("vec_id < 5").select(F.col("vec_id").alias("rid"), F.col("embedding").alias("rvec"), F.lit(1.0).alias("rweight"), F.lit(None).cast("double").alias("rrecency"))
    got = R.max_similarity(chunks.join(e, "vec_id").select(F.col("pos").alias("owner"), F.col("ord").alias("chunk"), F.col("embedding").alias("vec"), "weight"), profile)
    return V.recency_or(got.withColumn("overlap", F.round(F.col("owner") % 10 / 10, 6)), "recency", "overlap").select("owner", "semantic", "recency")


PROFILE_TEXT = "repeat(o_orderpriority || ' ', cast(o_orderkey % 9 * 250 as int))"
PIECE_TEXT = "repeat('evidence ', cast(l_partkey % 700 as int))"
PROFILES = "select o_orderkey as rid, case when o_orderkey % 4 = 0 then ' ' else 'Order ' || o_orderstatus end as headline, repeat(o_orderpriority || ' ', cast(o_orderkey % 9 * 250 as int)) as text, o_orderkey % 60 as total_months, o_orderkey % 40 as work_months from {orders}"
EXPERIENCES = """select l_orderkey as rid, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus) as bigint) as place, 'b' || cast(l_linenumber as string) as ref, case when l_linestatus = 'O' then 'work' else 'project' end as kind, case when l_linenumber % 4 = 2 then '' else 'Part ' || cast(l_partkey as string) end as title, 'Supplier ' || cast(l_suppkey as string) as organization,
 repeat('summed up ', cast(l_partkey % 30 as int)) as summary, case when l_linenumber % 3 = 0 then cast(null as bigint) else l_suppkey % 24 end as months, l_partkey % 48 as months_ago, repeat('evidence ', cast(l_partkey % 700 as int)) as text, l_returnflag as flag from {lineitem} where l_orderkey % 5 <> 0"""


def built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return C.shared(spark, sf_dir, PROFILES, "orders"), with_lists(C.shared(spark, sf_dir, EXPERIENCES, "lineitem"))


def with_lists(e: DataFrame) -> DataFrame:
    lists = {"highlights": F.array(F.lit("Shipped"), F.concat(F.lit("Returned "), F.col("flag"))), "technologies": F.array(F.col("flag"), F.lit("SQL"))}
    return e.withColumns(lists).drop("flag")


def seeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``built`` with the columns that texts are made from in place of the texts."""
    p, e = PROFILES.replace(PROFILE_TEXT, "o_orderpriority"), EXPERIENCES.replace(PIECE_TEXT, "l_partkey")
    return C.shared(spark, sf_dir, p, "orders"), with_lists(C.shared(spark, sf_dir, e, "lineitem"))


def rerank_queries(spark, sf_dir):
    return V.rerank_queries(*built(spark, sf_dir))


def evidence_payloads(spark, sf_dir):
    text = F.expr(PROFILE_TEXT.replace("o_orderpriority", "text").replace("o_orderkey", "rid"))
    piece = lambda key: F.repeat(F.lit("evidence "), (key % 700).cast("int"))
    return V.evidence_payloads(*seeds(spark, sf_dir), text, piece).select("rid", F.length("payload").cast("long").alias("chars"), F.sha2("payload", 256).alias("hash"))


def board_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    text = {"title": F.concat(F.lit("T"), F.col("doc_id").cast("string")), "company": F.col("source")}
    return d.select(F.concat(F.lit("J"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("seq"), *[text.get(c, F.lit("")).alias(c) for c in FIELDS], F.lit(True).alias("is_open"), F.create_map(F.lit("Level"), "lang").alias("metadata"))


def board_replaced(spark, sf_dir):
    """An import in place of the board: what a reader sees who began before it, and what one sees who came after."""
    rows, folder = board_rows(spark, sf_dir), shared_folder(spark)
    table = K.board_table(spark, folder)
    table.append(K.board_states(rows.where("seq % 3 <> 0")), 0)
    began = table.version()
    table.replace(K.board_states(rows.where("seq % 3 <> 1").withColumn("title", F.concat(F.lit("new "), F.col("title")))))
    states = {"before": table.read(began), "after": table.read()}
    before, after = (K.board_of(s).select(F.lit(k).alias("seen"), "id", "title", F.col("metadata")["Level"].alias("level")) for k, s in states.items())
    return before.unionByName(after)


def board_lookup(spark, sf_dir):
    """Three postings by id, each from one bucket of each run of the table."""
    rows, folder = board_rows(spark, sf_dir), shared_folder(spark)
    table = K.board_table(spark, folder)
    for n in range(2):
        table.append(K.board_states(rows.where(f"seq % 2 = {n}")), n)
    found = [K.board_of(table.lookup(i)).select("id", "title", "company") for i in ("J3", "J44", "none")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def detail_failures(spark, sf_dir):
    """Reasons of failed details over the board; a failed row keeps what else its metadata say."""
    board = board_rows(spark, sf_dir).select("id", "seq", F.lit("complete").alias("detail_status"), "metadata")
    failures = board.where("seq % 7 = 2").select("id", F.concat(F.lit("no answer from "), F.col("metadata")["Level"]).alias("error"))
    got = B.failed_details(board, failures)
    return got.select("id", "detail_status", F.col("metadata")["Level"].alias("level"), F.try_element_at("metadata", F.lit("detail_error")).alias("error"))


def json_export(spark, sf_dir):
    """Rows written as JSON lines with nulls in place and read back."""
    path = shared_folder(spark)
    X.write_json(inputs.postings(spark, sf_dir).select("pos", "title", "is_open", F.array("company", "location").alias("places")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


QUERIES = {f.__name__: f for f in (nested_metadata, requirement_chunks, requirement_similarity, rerank_queries, evidence_payloads, board_replaced, board_lookup, detail_failures, json_export)}

P_SQL = f"p as ({inputs.POSTINGS_SQL})"
CHUNKS_SQL = rf"""{P_SQL}, b as (select pos, trim(regexp_replace(title, '\s+', ' ', 'g')) as title, company, string_split_regex(regexp_replace(description || chr(10) || requirements, '([.;!?。；])[\s\x0b]+', '\1' || chr(10), 'g'), '\n+') as parts from p),
 s as (select *, list_transform(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '^\s*([-*•·▪◦‣]|\d+[.)])\s+', ''))), lambda x: length(x) >= 25), lambda x: {{'chunk': {sql_collapse('x[:600]')}, 'weight': 1.0::double}}) as body from b),
 k as (select pos, case when pos % 3 = 0 then list_filter([{{'chunk': 'Know Python ' || pos, 'weight': 2.0::double}}, {{'chunk': {sql_collapse("'Like ' || company")}, 'weight': 1.0::double}}], lambda c: c.chunk is not null) else list_concat(case when title <> '' then [{{'chunk': title, 'weight': 2.0::double}}] else [] end, body) end[:60] as ch from s),
 c as (select pos, unnest(range(len(ch))) as ord, unnest(ch, recursive := true) from k where len(ch) > 0)"""
E_SQL = f"pf as ({PROFILES.format(orders='orders')}), ex as (select * exclude (flag), ['Shipped', 'Returned ' || flag] as highlights, [flag, 'SQL'] as technologies from ({EXPERIENCES.format(lineitem='lineitem')}))"
LINE = """'{"pos":' || pos || ',"title":' || to_json(title) || ',"is_open":' || coalesce(is_open::varchar, 'null') || ',"places":[' || coalesce(to_json(company)::varchar, 'null') || ',' || to_json(location) || ']}'"""
ORACLE_SQL = {
    "nested_metadata": f"""with {P_SQL}, m as ({NESTED.format(p='p')}), t as (select m.pos, x.key, x.type, x.id, x.value, u.type as above, x.value ->> '$' as said from m, json_tree(m.meta) x left join (select pos as upos, y.id, y.type from m, json_tree(m.meta) y) u on u.upos = m.pos and u.id = x.parent),
 n as (select *, case when above = 'OBJECT' then key end as name, type in ('OBJECT', 'ARRAY') and value::varchar not in ('[]', '{{}}') as holds from t),
 g as (select pos, list(case when name is not null then name || ': ' else '' end || said order by id) filter (type = 'VARCHAR') as lv, string_agg(case when holds then name || ':' else concat_ws(' ', name || ':', case when type in ('OBJECT', 'ARRAY', 'NULL') then '' else said end) end, ' ' order by id) as flat from n group by pos)
 select pos, array_to_string(lv, '|') as leaves, flat, {RESTRICTION.replace(f"[title, description, requirements, {', '.join(METADATA)}]", 'lv')} as restriction from g""",
    "requirement_chunks": f"with {CHUNKS_SQL} select pos, ord::bigint as ord, chunk, weight from c",
    "requirement_similarity": f"with {CHUNKS_SQL}, v as (select pos as owner, ord, weight as w, embedding as v from c join embeddings on vec_id = (pos * 7 + ord) % (select count(*) from embeddings)), r as (select vec_id as rid, embedding as rv from embeddings where vec_id < 5), bb as (select owner, ord, w, max(round(list_sum(list_transform(list_zip(v, rv), lambda z: z[1]::double * z[2]::double)), 9)) as best from v, r group by all) select owner, round(sum(best * w) / greatest(sum(w), 1e-9), 6) as semantic, round(owner % 10 / 10.0::double, 6) as recency from bb group by owner",
    "rerank_queries": f"with {E_SQL}, t as (select rid, place, array_to_string(list_filter(list_concat([title, organization, summary], highlights, [array_to_string(technologies, ', ')]), lambda x: trim(x) <> ''), chr(10)) as piece from ex), j as (select rid, string_agg(piece, ' ' order by place) as body from t group by rid), q as (select pf.rid, text, concat_ws(' ', case when trim(headline) <> '' then headline end, body) as q from pf left join j using (rid)) select rid, substr(case when q <> '' then q else text end, 1, 1200) as query from q",
    "evidence_payloads": f"with {E_SQL}, j as (select rid, list({{'ref': ref, 'kind': kind, 'title': title, 'organization': organization, 'months': months, 'months_ago': months_ago, 'technologies': technologies, 'text': substr(text, 1, 4000)}} order by place) as pieces from ex group by rid), b as (select pf.rid, to_json({{'headline': headline, 'total_experience_months': total_months, 'work_experience_months': work_months, 'experiences': coalesce(pieces, [{{'ref': 'resume', 'kind': 'other', 'title': '', 'organization': '', 'months': null::bigint, 'months_ago': null::bigint, 'technologies': []::varchar[], 'text': substr(text, 1, 12000)}}])}})::varchar as payload from pf left join j using (rid)) select rid, length(payload) as chars, sha256(payload) as hash from b",
    "board_replaced": "select 'before' as seen, 'J' || doc_id as id, 'T' || doc_id as title, lang as level from documents where doc_id % 3 <> 0 union all select 'after', 'J' || doc_id, 'new T' || doc_id, lang from documents where doc_id % 3 <> 1",
    "board_lookup": "select 'J' || doc_id as id, 'T' || doc_id as title, coalesce(source, '') as company from documents where doc_id in (3, 44)",
    "detail_failures": "select 'J' || doc_id as id, case when doc_id % 7 = 2 and lang is not null then 'failed' else 'complete' end as detail_status, lang as level, case when doc_id % 7 = 2 then 'no answer from ' || lang end as error from documents",
    "json_export": f"with {P_SQL} select {LINE} as line from p",
}
