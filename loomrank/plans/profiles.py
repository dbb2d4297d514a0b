"""Queries over built profiles: skills, blocks, dates, headlines, claims and chunks, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrank.functions import skills as K
from loomrank.operators import profile as R
from loomrank.plans import inputs
from loomrank.plans.matching import sql_collapse
from loomrank.plans.postings import rendered, RENDERED_SQL
from loomrank.plans.sqltext import sql_digits

YEAR, MONTH = 2026, 3


def skill_lists(spark, sf_dir):
    return rendered(spark, sf_dir).select("pos", F.array_join(K.skills_of(F.col("text")), ", ").alias("skills"))


def profile_lines(spark, sf_dir):
    return R.lines_of(inputs.profiles(spark, sf_dir)).select("rid", F.col("no").cast("long").alias("no"), "start", "line", "kind", "heading")


def profile_blocks(spark, sf_dir):
    return R.blocks_of(inputs.profiles(spark, sf_dir)).select("rid", "block", "kind", "text", "start", "stop", F.array_join("bullets", "|").alias("bullets"))


def block_dates(spark, sf_dir):
    df = R.blocks_of(inputs.profiles(spark, sf_dir)).withColumn("d", R.date_range(F.col("text")))
    return df.where(F.col("kind").isin(R.EVIDENCE)).select("rid", "block", "d.start", "d.end", "d.ongoing", "d.months", R.months_ago(F.col("d"), YEAR, MONTH).alias("months_ago"))


def experience_months(spark, sf_dir):
    e = R.experiences_of(R.blocks_of(inputs.profiles(spark, sf_dir)), YEAR, MONTH)
    return e.groupBy("rid").agg(F.sum(F.coalesce("months", F.lit(0))).alias("total"), F.sum(F.when(F.col("kind") == "work", F.coalesce("months", F.lit(0))).otherwise(0)).alias("work"), F.min_by("block", "place").alias("newest"))


def entry_headlines(spark, sf_dir):
    e = R.experiences_of(R.blocks_of(inputs.profiles(spark, sf_dir)), YEAR, MONTH)
    return e.select("rid", "block", "title", "organization", "kind")


def availabilities(spark, sf_dir):
    df = inputs.profiles(spark, sf_dir).select("rid", R.availability(F.col("text")).alias("a"))
    return df.select("rid", F.array_join(F.col("a.months").cast("array<string>"), ",").alias("months"), F.array_join("a.terms", ",").alias("terms"))


def skill_mentions(spark, sf_dir):
    return R.mentions_in(inputs.profiles(spark, sf_dir)).select("rid", "start", "canonical")


def skill_claims(spark, sf_dir):
    profiles = inputs.profiles(spark, sf_dir)
    attributed = profiles.select("rid", F.lit(3).cast("long").alias("block"), F.explode(F.array(F.lit("GraphQL"), F.lit("Vue.js"), F.lit("services to"))).alias("name"))
    got = R.claims_of(profiles, R.blocks_of(profiles), attributed)
    return got.select("rid", "skill", "tier", F.array_join(F.col("blocks").cast("array<string>"), ",").alias("blocks"))


def profile_chunks(spark, sf_dir):
    profiles = inputs.profiles(spark, sf_dir)
    blocks = R.blocks_of(profiles)
    return R.chunks_of(R.experiences_of(blocks, YEAR, MONTH), R.claims_of(profiles, blocks)).withColumn("weight", F.round("weight", 4))


QUERIES = {f.__name__: f for f in (skill_lists, profile_lines, profile_blocks, block_dates, experience_months, entry_headlines, availabilities, skill_mentions, skill_claims, profile_chunks)}

quoted = lambda p: p.replace("'", "''")
ESCAPED = {a: "".join("\\" + c if not c.isalnum() and c != " " else c for c in a) for a in K.NAME_OF}
ALIAS_ROWS = ", ".join(f"('{a}', '{n}', '{quoted(ESCAPED[a])}')" for a, n in K.NAME_OF.items())
SHORT_CASES = " union all ".join(rf"select pos, '{s}' from r where regexp_matches(text, '(?:^|[,:;/|\n])\s*{s}\s*(?:$|[,:;/|\n])')" for s in K.SHORT)
HEADING = lambda x: rf"trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(trim({x}), '^#{{1,6}}\s*', ''), '^(?:\*+|_+)', ''), '(?:\*+|_+)$', '')), '[:：]+$', ''))"
KIND = lambda x: f"case when length(trim({x})) <= 70 and regexp_matches({HEADING(x)}, '\\p{{L}}') then case " + " ".join(rf"when regexp_matches({HEADING(x)}, '^[^\p{{L}}\p{{N}}_]*(?:{p})[^\p{{L}}\p{{N}}_]*$', 'i') then '{k}'" for k, p in R.SECTIONS) + " end end"
LINES_SQL = rf"""p as ({inputs.PROFILES_SQL}),
 l0 as (select rid, unnest(range(len(x))) as no, unnest(x) as line from (select rid, string_split(array_to_string(list_transform(string_split(text, chr(10)), lambda y: case when length(y) > 120 then regexp_replace(y, '([.;。；])\s*({R.LABEL})', '\1' || chr(10) || '\2', 'gi') else y end), chr(10)), chr(10)) as x from p)),
 l1 as (select *, coalesce(sum(length(line) + 1) over (partition by rid order by no rows between unbounded preceding and 1 preceding), 0) as loc, {KIND('line')} as head from l0),
 l2 as (select *, case when count(head) over (partition by rid) = 0 then nullif(regexp_extract(trim(line), '^{R.LABEL}', 1, 'i'), '') end as label from l1),
 l3 as (select *, {KIND('label')} as labelled from l2),
 l4 as (select *, coalesce(head, labelled) as opens, case when head is not null then '' when labelled is not null then regexp_replace(trim(line), '^{R.LABEL}\s*', '', 'i') else line end as content from l3),
 l5 as (select *, count(opens) over (partition by rid order by no) as section from l4),
 ln as (select rid, no, (case when labelled is not null then loc + length(line) - length(content) else loc end)::bigint as start, content as line, coalesce(max(opens) over (partition by rid, section), 'header') as kind, coalesce(max(case when opens is not null then regexp_replace(trim(coalesce(label, line)), '[:：]+$', '') end) over (partition by rid, section), '') as heading, section from l5)"""
RANGE = R.RANGE
SPLIT = ", ".join(f"'{k}'" for k in R.SPLIT_KINDS)
EVIDENCE = ", ".join(f"'{k}'" for k in R.EVIDENCE)
BLOCKS_SQL = rf"""{LINES_SQL},
 e0 as (select *, regexp_matches(line, '{R.BULLET}') as bullet from ln),
 e1 as (select *, regexp_matches(line, '{RANGE}', 'i') and not bullet as dated, not bullet and not regexp_matches(line, '^\s') and length(trim(line)) <= 120 and regexp_matches(trim(line), '^[\p{{L}}\p{{N}}]') and not regexp_matches(trim(line), '^\p{{Ll}}') as shaped from e0),
 e2 as (select *, max(case when bullet then no end) over w as last_bullet, max(case when dated or shaped then no end) over w as last_line from e1 window w as (partition by rid, section order by no rows between unbounded preceding and 1 preceding)),
 e3 as (select *, sum(case when kind in ({SPLIT}) and (dated or (shaped and coalesce(last_bullet > coalesce(last_line, -1), false))) then 1 else 0 end) over (partition by rid, section order by no) as entry from e2),
 lt as (select rid, string_agg(line, chr(10) order by no) as whole from l0 group by rid),
 b00 as (select rid, section, entry, kind, heading, min(start) as start, max(start + length(line)) as stop, coalesce(string_agg({sql_collapse(f"regexp_replace(line, '{R.BULLET}', '')")}, '|' order by no) filter (bullet), '') as bullets from e3 where trim(line) <> '' group by all),
 b0 as (select b00.*, substr(whole, start + 1, stop - start) as text from b00 join lt using (rid)),
 b as (select *, row_number() over (partition by rid order by section, entry) as block from b0)"""
POINT = lambda x: f"(regexp_extract({x}, '\\d{{4}}')::int * 12 + case when regexp_extract(lower({x}), '[a-z]{{3,}}') <> '' then case " + " ".join(f"when starts_with(regexp_extract(lower({x}), '[a-z]{{3,}}'), '{m}') then {i + 1}" for i, m in enumerate(R.MONTHS)) + " " + " ".join(f"when starts_with(regexp_extract(lower({x}), '[a-z]{{3,}}'), '{s}') then {m}" for s, m in R.SEASONS.items()) + f" else 1 end when regexp_matches({x}, '^\\d{{1,2}}[/-]') then least(12, greatest(1, regexp_extract({x}, '^\\d{{1,2}}')::int)) else 1 end)"
DATES_SQL = rf"""{BLOCKS_SQL},
 d0 as (select *, nullif(trim(regexp_extract(text, '{RANGE}', 1, 'i')), '') as a, nullif(trim(regexp_extract(text, '{RANGE}', 2, 'i')), '') as z from b where kind in ({EVIDENCE})),
 d1 as (select *, coalesce(regexp_matches(z, '^(?:{R.NOW_WORDS})$', 'i'), false) as ongoing from d0),
 d2 as (select *, case when a is not null then {POINT('a')} end as s, case when z is not null and not ongoing then {POINT('z')} end as f from d1),
 d as (select rid, block, kind, text, bullets, s::bigint as start, f::bigint as "end", ongoing, (case when f - s + 1 between 1 and 600 then f - s + 1 end)::bigint as months, (case when ongoing then 0 else case when f is not null then greatest(0, {YEAR * 12 + MONTH} - f) end end)::bigint as months_ago from d2)"""
BARE = rf"trim(regexp_replace(regexp_replace(line, '{R.DATE_IN_LINE}', '\1', 'gi'), '\s{{2,}}\S.*$', ''), ' ,|-–—')"
HEAD_SQL = rf"""{DATES_SQL},
 h0 as (select *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from d),
 h1 as (select *, ls[1] as line, length(ls[1]) <= 120 and len(ls) > 1 as headed from h0),
 h2 as (select *, {BARE} as bare from h1),
 h3 as (select *, regexp_matches(bare, '\s[—–]\s|\s-\s') as dashed, regexp_extract(bare, '^(.*?)(?:\s[—–]\s|\s-\s)(.*)$', 1) as d1, regexp_extract(bare, '^(.*?)(?:\s[—–]\s|\s-\s)(.*)$', 2) as d2 from h2),
 h4 as (select *, trim(case when dashed then d1 else regexp_extract(bare, '^[^,]*') end, ' ,|') as hd, trim(case when dashed then d2 else regexp_extract(bare, '^[^,]*,(.*)$', 1) end, ' ,|') as tl from h3),
 h5 as (select *, tl <> '' and regexp_matches(tl, '{R.ROLES}', 'i') and not regexp_matches(hd, '{R.ROLES}', 'i') as swap from h4),
 h as (select *, case when headed then {sql_collapse('case when swap then tl else hd end')} else '' end as title, case when headed then {sql_collapse('case when swap then hd else tl end')} else '' end as organization, case kind when 'experience' then 'work' when 'project' then 'project' when 'publication' then 'research' else 'leadership' end as k, row_number() over (partition by rid order by months_ago nulls last, block) as place from h5)"""
TEXT_SQL = "laid as (select rid, string_agg(line, chr(10) order by no) as text from l0 group by rid)"
FOLDED = "replace(lower(text), 'ß', 'ss')"
FOUND_SQL = rf"""al as (select * from (values {ALIAS_ROWS}) v(alias, name, pattern)),
 hit as (select rid, {FOLDED} as folded, alias, name, pattern from laid join al on contains({FOLDED}, alias)),
 spot as (select rid, alias, name, folded, unnest(range(1, length(folded) - length(alias) + 2)) as i from hit),
 mn as (select distinct rid, i - 1 as start, name as canonical from spot where substr(folded, i, length(alias)) = alias and not regexp_matches(substr(folded, i - 1, 1), '^[\p{{L}}\p{{N}}_+#]') and not regexp_matches(substr(folded, i + length(alias), 1), '^[\p{{L}}\p{{N}}_+#]'))"""
EDGES = r"[,:;/|\n]"
SHORT_MENTIONS = " union all ".join(rf"select rid, i - 1, '{x}' from place where (i = 1 and regexp_matches(text, '^\s*{x}\s*(?:$|{EDGES})') or regexp_matches(substr(text, i, 1), '{EDGES}') and regexp_matches(substr(text, i + 1, 100), '^\s*{x}\s*(?:$|{EDGES})')) and not regexp_matches(substr(text, 1, i - 1), '{EDGES}\s*$')" for x in K.SHORT)
MENTIONS_SQL = rf"""{BLOCKS_SQL}, {TEXT_SQL}, {FOUND_SQL},
 place as (select rid, text, i from (select rid, text, unnest(range(1, length(text) + 1)) as i from laid) where i = 1 or regexp_matches(substr(text, i, 1), '{EDGES}')),
 ms as (select rid, start, canonical from mn union all {SHORT_MENTIONS})"""
CLAIMS_SQL = f"""{MENTIONS_SQL},
 c1 as (select ms.rid, canonical as skill, case when b.kind in ({EVIDENCE}) then 3 else 1 end as tier, b.block from ms left join b on ms.rid = b.rid and ms.start >= b.start and ms.start < b.stop),
 c2 as (select b.rid, b.block, b.text, v.name, v.skill, exists (select 1 from c1 where c1.rid = b.rid and c1.skill = v.skill) as known from b cross join (values ('GraphQL', 'GraphQL'), ('Vue.js', 'Vue'), ('services to', 'services to')) v(name, skill) where b.block = 3 and b.kind in ({EVIDENCE})),
 c3 as (select * from c1 union all select rid, skill, case when known then 2 else 3 end, block from c2 where known or contains(lower(text), lower(name))),
 c4 as (select rid, skill, max(tier) as tier from c3 group by all)"""
MONTHS_SQL = f"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({sql_digits('text')}, '(?i){R.AVAILABLE}', 1), lambda m: m::int), lambda m: m between 1 and 24)))[:6]"

ORACLE_SQL = {
    "skill_lists": f"with {RENDERED_SQL}, al as (select * from (values {ALIAS_ROWS}) v(alias, name, pattern)), f as (select pos, name from r join al on contains(replace(lower(text), 'ß', 'ss'), alias) where regexp_matches(replace(lower(text), 'ß', 'ss'), '(^|[^\\p{{L}}\\p{{N}}_+#])' || pattern || '($|[^\\p{{L}}\\p{{N}}_+#])') union {SHORT_CASES}), g as (select pos, string_agg(name, ', ' order by lower(name)) as skills from f group by pos) select r.pos, coalesce(skills, '') as skills from r left join g on r.pos = g.pos",
    "profile_lines": f"with {LINES_SQL} select rid, no, start, line, kind, heading from ln",
    "profile_blocks": f"with {BLOCKS_SQL} select rid, block, kind, text, start, stop, bullets from b",
    "block_dates": f"with {DATES_SQL} select rid, block, start, \"end\", ongoing, months, months_ago from d",
    "experience_months": f"with {HEAD_SQL} select rid, sum(coalesce(months, 0))::bigint as total, sum(case when k = 'work' then coalesce(months, 0) else 0 end)::bigint as work, arg_min(block, place) as newest from h group by rid",
    "entry_headlines": f"with {HEAD_SQL} select rid, block, title[:300] as title, organization[:300] as organization, k as kind from h",
    "availabilities": rf"with p as ({inputs.PROFILES_SQL}) select rid, array_to_string({MONTHS_SQL}, ',') as months, array_to_string(list_transform(regexp_extract_all({sql_digits('text')}, '(?i){R.TERM}', 0), lambda t: regexp_extract(t, '20\d\d') || ' ' || upper(regexp_extract(t, '(?i)winter|spring|summer|fall|autumn')[1]) || lower(regexp_extract(t, '(?i)winter|spring|summer|fall|autumn')[2:])), ',') as terms from p",
    "skill_mentions": f"with {MENTIONS_SQL} select rid, start, canonical from ms",
    "skill_claims": f"with {CLAIMS_SQL} select c4.rid, c4.skill, c4.tier::bigint as tier, coalesce(array_to_string(list_sort(list_distinct(list(c3.block) filter (c3.block is not null and not (c3.tier = 2 and c4.tier = 3)))), ','), '') as blocks from c4 join c3 on c3.rid = c4.rid and c3.skill = c4.skill group by all",
}
