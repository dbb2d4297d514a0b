"""Queries of text, retrieval, fusion and local scoring, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrank.functions import scores as S
from loomrank.functions import text as T
from loomrank.operators import retrieval as R
from loomrank.operators import scoring as C

STOPS = ",".join(f"'{w}'" for w in T.STOP_WORDS)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_tokens(text: str) -> str:
    found = rf"regexp_extract_all(replace(lower(coalesce({text}, '')), 'ß', 'ss'), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_+#.\-]*')"
    return rf"list_filter(list_transform({found}, lambda t: trim(t, '.-')), lambda t: length(t) > 1 and not list_contains([{STOPS}], t) and not regexp_full_match(t, '\p{{N}}+'))"


def sql_collapse(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query side: benchmark texts as experiences, every fourth only listed, weighted by age in months."""
    return read(spark, sf_dir, "benchmark").select("item_id", "text", S.recency_weight(F.col("item_id")).alias("weight"), (F.col("item_id") % 4 == 3).alias("listed"))


TERMS_SQL = f"""t as (select unnest({sql_tokens('text')}) as term, round(0.4 + 0.6 * pow(0.5, item_id / 24.0), 4) as weight, item_id % 4 = 3 as listed from benchmark),
 q as (select term, coalesce(max(case when not listed then weight end), 0.3) as weight from t group by term)"""
BM25_SQL = f"""{TERMS_SQL},
 d as (select doc_id, {sql_tokens('text')} as toks from documents),
 st as (select count(*) as n, avg(len(toks)) as mean from d),
 tf as (select doc_id, len(toks) as len, term, count(*) as tf from (select doc_id, toks, unnest(toks) as term from d) group by all),
 hit as (select tf.*, q.weight from tf join q using (term)),
 df as (select term, count(*) as df from hit group by term),
 bm as (select doc_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) as score from hit join df using (term), st group by doc_id)"""


def tokenize_terms(spark, sf_dir):
    return R.term_counts(read(spark, sf_dir, "documents"), "doc_id", F.col("text"))


def weighted_query_terms(spark, sf_dir):
    return R.weighted_terms(experiences(spark, sf_dir))


def scored(spark, sf_dir):
    return R.bm25(read(spark, sf_dir, "documents"), "doc_id", F.col("text"), weighted_query_terms(spark, sf_dir))


def bm25_topk(spark, sf_dir):
    top = scored(spark, sf_dir).orderBy(F.col("score").desc(), "doc_id").limit(100)
    return top.select("doc_id", "score", F.round(S.saturated(F.col("score")), 6).alias("relevance"))


def similarity(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    weight = F.when(F.col("vec_id") % 5 == 0, 0.3).otherwise(1.0)
    profile = e.where("vec_id < 20").select(F.col("vec_id").alias("rid"), F.col("embedding").alias("rvec"), weight.alias("rweight"), F.when(F.col("vec_id") % 4 != 3, S.recency_weight(F.col("vec_id"))).alias("rrecency"))
    chunks = e.where("vec_id >= 20").select(F.col("label").alias("owner"), F.col("vec_id").alias("chunk"), F.col("embedding").alias("vec"), F.when(F.col("vec_id") % 2 == 0, 2.0).otherwise(1.0).alias("weight"))
    return R.max_similarity(chunks, profile)


def maxsim_by_group(spark, sf_dir):
    return similarity(spark, sf_dir)


MAXSIM_SQL = """with r as (select vec_id as rid, embedding as rv, case when vec_id % 5 = 0 then 0.3 else 1.0 end::double as rw, case when vec_id % 4 <> 3 then round(0.4 + 0.6 * pow(0.5, vec_id / 24.0), 4) end as rr from embeddings where vec_id < 20),
 c as (select label as owner, vec_id, embedding as v, case when vec_id % 2 = 0 then 2.0 else 1.0 end::double as w from embeddings where vec_id >= 20),
 s as (select owner, vec_id, w, rid, rw, rr, round(list_sum(list_transform(list_zip(v, rv), lambda z: z[1]::double * z[2]::double)), 9) as sim from c, r),
 b as (select owner, vec_id, w, max(sim * rw) as best, arg_max({'rec': rr}, {'s': sim, 'n': -rid}).rec as rec from s group by all)
 select owner, round(sum(best * w) / greatest(sum(w), 1e-9), 6) as semantic, round(sum(rec * w) filter (rec is not null) / sum(w) filter (rec is not null), 6) as recency from b group by owner"""


def fused_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("semantic"))
    both = docs.join(scored(spark, sf_dir), "doc_id", "left")
    return R.reciprocal_rank_fusion(both, "doc_id", "score", "semantic")


FUSED_SQL = f"""with {BM25_SQL}, r as (select doc_id, score, n_chars, row_number() over (order by score desc nulls last, doc_id) as r_lex, row_number() over (order by n_chars desc nulls last, doc_id) as r_sem from documents left join bm using (doc_id)),
 f as (select *, round(1 / (60.0::double + r_lex) + 1 / (60.0::double + r_sem), 9) as fused from r)"""


def rrf_fusion(spark, sf_dir):
    return fused_documents(spark, sf_dir).select("doc_id", "r_lex", "r_sem", "fused")


def cascade_pool(spark, sf_dir):
    """Every document in the order of the cascade; those outside the pool have no judge."""
    judged = fused_documents(spark, sf_dir).withColumn("logit", (F.col("doc_id") * 37 % 101).cast("double") / 10 - 5)
    return R.cascade(judged, "doc_id", "fused", "logit").select("doc_id", "fused", F.when(F.col("logit").isNotNull(), F.round(S.sigmoid(F.col("logit")), 6)).alias("judge"), "pos")


def calibrated_relevance(spark, sf_dir):
    sem = F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 100) / 100.0)
    return scored(spark, sf_dir).select("doc_id", S.relevance(F.col("score"), sem).alias("relevance"))


def score_local(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", T.tokens(F.col("text")).alias("toks"))
    skills = F.array_intersect("toks", F.array(*[F.lit(s) for s in ("idiot", "licensed", "que", "und", "les")]))
    df = docs.join(scored(spark, sf_dir), "doc_id", "left")
    overlap = C.overlap_credit(skills, ["que"], ["und"], ["les"])
    rec = F.when(F.col("doc_id") % 3 != 0, S.recency_weight(F.col("doc_id") % 48))
    pref = C.preference_fraction([F.col("lang") == "en", F.col("source") == "src0"])
    return C.score_local(df, S.relevance(F.coalesce("score", F.lit(0.0)), F.lit(None).cast("double")), rec, overlap, pref).select("doc_id", "score")


SCORE_LOCAL_SQL = f"""with {BM25_SQL}, s as (select d.doc_id, documents.lang, documents.source, list_intersect(list_distinct(d.toks), ['idiot','licensed','que','und','les']) as sk, round(coalesce(score, 0) / (coalesce(score, 0) + 12), 6) as rel, case when d.doc_id % 3 <> 0 then round(0.4 + 0.6 * pow(0.5, (d.doc_id % 48) / 24.0), 4) end as rec from d join documents on d.doc_id = documents.doc_id left join bm on d.doc_id = bm.doc_id),
 v as (select doc_id, greatest(0, least(1, rel))::double as rel, case when rec is not null then rec * greatest(0, least(1, rel)) end as rec, case when len(sk) > 0 then list_sum(list_transform(sk, lambda x: case x when 'que' then 1.0 when 'und' then 0.75 when 'les' then 0.5 else 0.0 end::double)) / len(sk) end as ov, ((case when lang = 'en' then 1 else 0 end) + (case when source = 'src0' then 1 else 0 end)) / 2.0::double as pf from s),
 b as (select *, 65.0::double + case when rec is null then 0 else 15 end + case when ov is null then 0 else 25 end as b from v),
 o as (select doc_id, round(100 * 55.0::double / b * rel + coalesce(100 * 15.0::double / b * rec, 0) + coalesce(100 * 25.0::double / b * ov, 0) + 100 * 10.0::double / b * pf, 4) as score from b)
 select doc_id, score from o"""


def lexical_overlap_winner(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    return R.most_shared(read(spark, sf_dir, "documents").select("doc_id", "text"), items)


def ndcg(spark, sf_dir):
    ranked = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars", F.col("quality").alias("rel"))
    ranked = R.global_rank(ranked, "pos", F.col("n_chars").desc(), F.col("doc_id").asc())
    ranked = R.global_rank(ranked, "best", F.col("rel").desc(), F.col("doc_id").asc())
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    return ranked.agg(F.round(F.sum(gain / F.log2(F.col("pos") + 1)) / F.sum(gain / F.log2(F.col("best") + 1)), 6).alias("ndcg"), F.count("*").alias("n"))


def chunk_sentences(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("ord", "chunk")).select("doc_id", F.col("ord").cast("long").alias("ord"), "chunk")


QUERIES = {f.__name__: f for f in (tokenize_terms, weighted_query_terms, bm25_topk, maxsim_by_group, rrf_fusion, cascade_pool, calibrated_relevance, score_local, lexical_overlap_winner, ndcg, chunk_sentences)}

ORACLE_SQL = {
    "tokenize_terms": f"select doc_id, term, count(*) as tf from (select doc_id, unnest({sql_tokens('text')}) as term from documents) group by all",
    "weighted_query_terms": f"with {TERMS_SQL} select term, weight from q",
    "bm25_topk": f"with {BM25_SQL} select doc_id, score, round(score / (score + 12), 6) as relevance from bm order by score desc, doc_id limit 100",
    "maxsim_by_group": MAXSIM_SQL,
    "rrf_fusion": f"{FUSED_SQL} select doc_id, r_lex, r_sem, fused from f",
    "cascade_pool": f"{FUSED_SQL}, h as (select doc_id, fused, (doc_id * 37 % 101)::double / 10 - 5 as logit, row_number() over (order by fused desc, doc_id) as r from f) select doc_id, fused, round(1 / (1 + exp(-logit)), 6) as judge, row_number() over (order by logit desc, fused desc, doc_id) as pos from h where r <= 150 union all select doc_id, fused, null, r from h where r > 150",
    "calibrated_relevance": f"with {BM25_SQL}, s as (select doc_id, score / (score + 12) as lex, case when doc_id % 7 <> 0 then (doc_id % 100) / 100.0::double end as sem from bm) select doc_id, round(case when sem is null then lex else 0.7 * greatest(0.0, least(1.0, (sem - 0.35) / (0.80::double - 0.35))) + (1 - 0.7::double) * lex end, 6) as relevance from s",
    "score_local": SCORE_LOCAL_SQL,
    "lexical_overlap_winner": f"with i as (select item_id, unnest(list_distinct({sql_tokens('text')})) as term from benchmark), d as (select doc_id, unnest(list_distinct({sql_tokens('text')})) as term from documents), s as (select doc_id, item_id, count(*) as shared from d join i using (term) group by all) select doc_id, item_id, shared from (select *, row_number() over (partition by doc_id order by shared desc, item_id) as rn from s) where rn = 1",
    "ndcg": "with r as (select quality as rel, row_number() over (order by n_chars desc, doc_id) as pos, row_number() over (order by quality desc, doc_id) as best from documents join labels using (doc_id)) select round(sum((pow(2.0, rel) - 1) / log2(pos + 1)) / sum((pow(2.0, rel) - 1) / log2(best + 1)), 6) as ndcg, count(*) as n from r",
    "chunk_sentences": r"""with p as (select doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '([.;!?。；])[\s\x0b]+', '\1' || chr(10), 'g'), '\n+') as parts from documents),
 c as (select doc_id, list_transform(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '^\s*([-*•·▪◦‣]|\d+[.)])\s+', ''))), lambda x: length(x) >= 25), lambda x: x[:600]) as ch from p)
 select doc_id, (unnest(range(1, len(ch) + 1)) - 1)::bigint as ord, unnest(ch) as chunk from c""",
}
