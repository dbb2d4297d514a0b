"""Queries of profiles that a model split: requests, experiences, skills and whole profiles, each with its SQL twin.

The model's answers are a table built by one SQL text that both engines run; some quote what isn't there, some are no JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.operators import drafts as D
from loomrank.operators import profile as R
from loomrank.plans import inputs
from loomrank.plans.matching import sql_collapse
from loomrank.plans.profiles import CLAIMS_SQL, EVIDENCE, HEAD_SQL, MONTH, MONTHS_SQL, TEXT_SQL, YEAR
from loomrank.plans.sqltext import sql_digits
from loomrank.streaming.upsert import written

#: Profiles, some of which are past what a model may be sent.
LONG = "select rid, text || case when rid % 97 = 0 then chr(10) || repeat('filler words ', 4000) else '' end as text from ({p}) as q"
ANSWERS = """select rid, case rid % 13 when 5 then '{{"headline": "cut off' when 7 then '{{"headline": "bare", "experiences": []}}' else '{{"headline": ' || case when rid % 3 = 0 then 'null' else '"Engineer ' || cast(rid as string) || '"' end
 || ', "domains": ["data", "infra"], "education": [{{"institution": "Northern", "graduation_year": null}}], "experiences": [{{"block_id": "' || case when rid % 11 = 3 then 'b99' when rid % 5 = 4 then 'b2' else 'b3' end
 || '", "anchor": "' || case when rid % 11 = 4 then 'Led a team of forty engineers' when rid % 11 = 5 then ' ' when rid % 5 = 4 then 'Built a  data service' else ' Wrote pipelines  in Python' end || '", "kind": "' || case when rid % 12 = 11 then 'hobby' else 'work' end
 || '", "title": "Engineer", "organization": null, "months": ' || case when rid % 29 = 8 then '601' else '7' end || ', "summary": "Built it", "highlights": ["Moved services"], "technologies": ["Python", "GraphQL", "services to"]}}'
 || case when rid % 5 <> 4 then ', {{"block_id": "b4", "anchor": "' || case when rid % 11 = 6 then 'Ran the moon' else 'Ran the linux cluster' end || '", "kind": null, "months": null, "technologies": null}}' else '' end
 || case when rid % 4 = 1 then ', {{"block_id": "b1", "anchor": "Sam Example", "kind": "other", "title": "Self", "months": 3}}' else '' end
 || '], "availability": ' || case rid % 4 when 0 then '{{"terms": ["2027 Winter"], "months": [4, 8]}}' when 1 then '{{"terms": [], "months": null}}' else 'null' end || '}}' end as answer from {p} where rid % 13 <> 6"""


def profiles(spark: SparkSession, sf_dir: str, long: bool = True) -> tuple[DataFrame, DataFrame]:
    """Profiles and a model's answers of them."""
    p = inputs.profiles(spark, sf_dir)
    return spark.sql(LONG.format(p="select * from {p}"), p=p) if long else p, spark.sql(ANSWERS, p=p)


def assembled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    p, answers = profiles(spark, sf_dir)
    blocks = R.blocks_of(p)
    return p, blocks, *D.assembled(p, blocks, answers, YEAR, MONTH)


def model_requests(spark, sf_dir):
    """What a model is sent of each profile; nothing of one that is too long."""
    p, _ = profiles(spark, sf_dir)
    return D.model_requests(p, R.blocks_of(p)).select("rid", "refused", F.length("payload").cast("long").alias("chars"), F.sha2("payload", 256).alias("hash"))


def model_experiences(spark, sf_dir):
    """Experiences of all profiles: by a model where its quotes hold, by rules elsewhere."""
    e = assembled(spark, sf_dir)[3]
    return e.select("rid", "place", "by_model", "block", "kind", "title", "organization", "months", "months_ago")


def model_profiles(spark, sf_dir):
    """Whole profiles, with where they come from and why."""
    w = assembled(spark, sf_dir)[2]
    schools = F.array_join(F.transform("education", lambda e: F.concat_ws(" ", e["institution"], e["graduation_year"])), "|")
    return w.select("rid", "source", F.coalesce("problem", F.lit("")).alias("problem"), "headline", F.array_join("domains", ",").alias("domains"), schools.alias("education"), F.array_join(F.col("months").cast("array<string>"), ",").alias("months"), F.array_join("terms", ",").alias("terms"), "total_months", "work_months", "n_experiences", "warning")


def model_skills(spark, sf_dir):
    """Skill claims where a model's technologies place skills in blocks."""
    p, answers = profiles(spark, sf_dir, long=False)
    blocks = written(R.blocks_of(p))
    return D.placed_claims(p, blocks, D.modelled(p, blocks, answers)).select("rid", "skill", "tier", F.array_join(F.col("blocks").cast("array<string>"), ",").alias("blocks"))


QUERIES = {f.__name__: f for f in (model_requests, model_experiences, model_profiles, model_skills)}

KINDS = ", ".join(f"'{k}'" for k in D.KINDS)
LONG_SQL = LONG.format(p=inputs.PROFILES_SQL)
#: Blocks of all kinds with their dates, then the answers, their items and what is wrong with them.
ITEMS_SQL = rf"""laid0 as (select rid, sum(length(line) + 1) - 1 as chars from l0 group by rid),
 an as ({ANSWERS.format(p='p')}),
 dr as (select rid, chars > {D.MOST} as refused, answer, case when json_valid(answer) then answer::json end as j from laid0 left join an using (rid)),
 it0 as (select rid, unnest(range(1, json_array_length(j, '$.experiences')::bigint + 1)) as nth, unnest(json_extract(j, '$.experiences[*]')) as e from dr where j is not null and not refused),
 it as (select rid, nth, e, e ->> '$.block_id' as ref, {sql_collapse("coalesce(e ->> '$.anchor', '')")} as anchor, coalesce(e ->> '$.kind', 'other') as kind, (e ->> '$.months')::bigint as months from it0),
 ms0 as (select rid from it where kind not in ({KINDS}) or coalesce(months, 0) not between 0 and 600 group by rid),
 mt as (select it.*, b.block, coalesce(anchor <> '' and contains({sql_collapse('b.text')}, anchor), false) as holds from it left join b on b.rid = it.rid and 'b' || b.block = it.ref),
 fb as (select rid, min(nth) as bad from mt where not holds group by rid),
 jd as (select dr.*, case when refused then 'refused' when answer is null then 'no answer' when j is null or ms0.rid is not null then 'misshapen' when bad is not null then 'experience ' || bad else '' end as problem from dr left join ms0 on ms0.rid = dr.rid left join fb on fb.rid = dr.rid)"""
ALL_HEADS = HEAD_SQL.replace(f" from b where kind in ({EVIDENCE})", " from b")
EXPERIENCES_SQL = rf"""{ALL_HEADS}, {ITEMS_SQL},
 ours as (select rid, row_number() over (partition by rid order by months_ago nulls last, block) as place, false as by_model, block, k as kind, title[:300] as title, organization[:300] as organization, months, months_ago from h join jd using (rid) where kind in ({EVIDENCE}) and problem <> ''),
 theirs as (select mt.rid, row_number() over (partition by mt.rid order by d.months_ago nulls last, nth) as place, true as by_model, mt.block, mt.kind, coalesce(e ->> '$.title', '') as title, coalesce(e ->> '$.organization', '') as organization, coalesce(d.months, mt.months) as months, d.months_ago from mt join jd on jd.rid = mt.rid and problem = '' join d on d.rid = mt.rid and d.block = mt.block),
 ex as (select * from ours where place <= {D.EXPERIENCES} union all select * from theirs)"""
long_ = lambda sql: sql.replace(inputs.PROFILES_SQL, LONG_SQL)
SCHOOL = sql_collapse("string_split(text, chr(10))[1]")
PLACED = "(values ('GraphQL', 'GraphQL'), ('Vue.js', 'Vue'), ('services to', 'services to')) v(name, skill)"
SKILLS_SQL = CLAIMS_SQL.replace(f"from b cross join {PLACED} where b.block = 3 and b.kind in ({EVIDENCE})", f"from mt join jd on jd.rid = mt.rid and problem = '' join b on b.rid = mt.rid and b.block = mt.block cross join (values ('GraphQL', 'GraphQL'), ('Python', 'Python'), ('services to', 'services to')) v(name, skill) where contains((e -> '$.technologies')::varchar, v.name) and b.kind in ({EVIDENCE})").replace("\n c1 as", f"\n {ITEMS_SQL},\n c1 as")
ORACLE_SQL = {
    "model_requests": long_(rf"""with {ALL_HEADS}, {ITEMS_SQL}, pc as (select rid, list({{'id': 'b' || block, 'kind': kind, 'heading': heading, 'text': text[:{D.BLOCK}]}} order by block) as bl from b where block <= {D.BLOCKS} group by rid),
 py as (select dr.rid, refused, case when not refused then to_json({{'blocks': bl}})::varchar end as payload from dr left join pc using (rid)) select rid, refused, length(payload) as chars, sha256(payload) as hash from py"""),
    "model_experiences": long_(f"with {EXPERIENCES_SQL} select rid, place, by_model, block, kind, title, organization, months, months_ago from ex"),
    "model_profiles": long_(rf"""with {EXPERIENCES_SQL},
 sm as (select rid, count(*) as n, sum(coalesce(months, 0))::bigint as total, sum(case when kind = 'work' then coalesce(months, 0) else 0 end)::bigint as work from ex group by rid),
 fc as (select rid, bool_or(kind in ({EVIDENCE})) as has_work, {sql_collapse("string_split(arg_min(text, block), chr(10))[1]")} as first_line, string_agg(concat_ws(' ', {SCHOOL}[:300], coalesce(list_max(regexp_extract_all(text, '\b20\d{{2}}\b')), '')), '|' order by block) filter (kind = 'education') as schools from b group by rid),
 av as (select rid, array_to_string({MONTHS_SQL}, ',') as months, array_to_string(list_transform(regexp_extract_all({sql_digits('text')}, '(?i){R.TERM}', 0), lambda t: regexp_extract(t, '20\d\d') || ' ' || upper(regexp_extract(t, '(?i)winter|spring|summer|fall|autumn')[1]) || lower(regexp_extract(t, '(?i)winter|spring|summer|fall|autumn')[2:])), ',') as terms from p),
 ld as (select *, problem = '' as model, coalesce(json_array_length(j, '$.availability.terms'), 0) > 0 or coalesce(json_array_length(j, '$.availability.months'), 0) > 0 as given from jd)
 select ld.rid, case when model then 'model' else 'rules' end as source, problem, case when model then coalesce(j ->> '$.headline', '') else first_line end as headline, case when model then coalesce(array_to_string(from_json(j -> '$.domains', '["varchar"]'), ','), '') else '' end as domains,
 case when not model then coalesce(schools, '') when json_array_length(j, '$.education') > 0 then j ->> '$.education[0].institution' else '' end as education,
 case when model and given then coalesce(array_to_string(from_json(j -> '$.availability.months', '["bigint"]'), ','), '') else av.months end as months, case when model and given then coalesce(array_to_string(from_json(j -> '$.availability.terms', '["varchar"]'), ','), '') else av.terms end as terms,
 coalesce(total, 0) as total_months, coalesce(work, 0) as work_months, coalesce(n, 0) as n_experiences, case when not coalesce(has_work, false) then 'no work' when model and coalesce(n, 0) = 0 then 'no experiences' else '' end as warning from ld left join sm using (rid) left join fc using (rid) left join av using (rid)"""),
    "model_skills": f"with {SKILLS_SQL} select c4.rid, c4.skill, c4.tier::bigint as tier, coalesce(array_to_string(list_sort(list_distinct(list(c3.block) filter (c3.block is not null and not (c3.tier = 2 and c4.tier = 3)))), ','), '') as blocks from c4 join c3 on c3.rid = c4.rid and c3.skill = c4.skill group by all",
}
