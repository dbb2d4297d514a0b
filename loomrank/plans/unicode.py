"""Queries of texts beyond ASCII: compatible forms, full case folding and what tokens and lists come of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomrank.functions import text as T
from loomrank.plans.matching import read, sql_tokens

# Words in forms that documents from files hold, and the same words in compatible form, folded.
FORMS = [("ﬁrmware", "firmware"), ("ＰＹＴＨＯＮ", "python"), ("Maße ẞ", "masse ss"), ("ÉCOLE école", "école école"), ("ΛΌΓΟΣ", "λόγοσ"), ("x² ①② ½", "x2 12 1⁄2"), ("Ⅷ-bit", "viii-bit"), ("co­ding", "coding"), ("ǅungla", "džungla"), ("ﬀort‑bound", "ffort‐bound"), ("ｶﾞｽ", "ガス"), ("plain C++", "plain c++"), ("İzmir", "i̇zmir")]


def unicode_tokens(spark, sf_dir):
    """Number and hash of each text's tokens once it is in compatible form and folded."""
    forms = F.array(*[F.lit(raw) for raw, _ in FORMS])
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.get(forms, (F.col("doc_id") % len(FORMS)).cast("int"))).alias("text"))
    folded = T.normalised(docs, "text").select("doc_id", T.full_casefold(F.col("text")).alias("text"))
    toks = folded.select("doc_id", T.folded_tokens(F.col("text")).alias("toks"))
    return toks.select("doc_id", F.size("toks").cast("long").alias("n"), F.md5(F.array_join("toks", " ").cast("binary")).alias("hash"))


def distinct_values(spark, sf_dir):
    """Kinds of a user's events of a day, each once, in the order they came."""
    seen = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    users = read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(seen.alias("seen"))
    extra = F.array(F.lit(" click"), F.lit(""), F.lit(None).cast("string"), F.lit("click"))
    return users.select("user_id", F.col("day").cast("string").alias("day"), F.array_join(T.ordered_distinct(F.concat(F.col("seen"), extra)), ",").alias("kinds"))


QUERIES = {f.__name__: f for f in (unicode_tokens, distinct_values)}

FOLDED = ", ".join(f"'{folded}'" for _, folded in FORMS)
ORACLE_SQL = {
    "unicode_tokens": f"with d as (select doc_id, coalesce(text, '') || ' ' || ([{FOLDED}])[doc_id % {len(FORMS)} + 1] as text from documents), t as (select doc_id, {sql_tokens('text')} as toks from d) select doc_id, len(toks) as n, md5(array_to_string(toks, ' ')) as hash from t",
    "distinct_values": "with e as (select user_id, ts::date::varchar as day, event_type as v, ts, event_id from events union all select distinct user_id, ts::date::varchar, unnest([' click', 'click']), timestamp '9999-01-01', unnest([0, 1]) from events), f as (select user_id, day, v, min({'a': ts, 'b': event_id}) as came from e group by all) select user_id, day, string_agg(v, ',' order by came) as kinds from f group by all",
}
