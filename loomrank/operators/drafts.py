"""Profiles split by a model: what it is asked, how its answer is checked against the text, and the profile that comes of it.

A model's answer is one JSON text a profile. What it says counts only where it names a block and quotes from it; a profile whose
answer doesn't hold is split by the local rules instead, and says why. All by joins and Columns: the model's call itself
is ``providers.answered`` with ``anchors_hold`` as its check, which gives the model its second try.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrank.functions import scores as S
from loomrank.functions import text as T
from loomrank.operators import profile as R
from loomrank.streaming.upsert import written

#: Characters of a profile that a model may be sent, of one of its blocks, and blocks.
MOST, BLOCK, BLOCKS = 40_000, 6_000, 60
#: Entries that a profile shows at most.
DOMAINS, EDUCATION, EXPERIENCES, LONGEST_ANCHOR, LONGEST_REF = 12, 10, 30, 800, 20
# Kinds of a model's experiences.
KINDS = ["work", "project", "research", "leadership", "other"]
ITEM = "struct<block_id: string, anchor: string, kind: string, title: string, organization: string, months: long, summary: string, highlights: array<string>, technologies: array<string>>"
DRAFT = f"headline string, domains array<string>, education array<struct<institution: string, graduation_year: string>>, experiences array<{ITEM}>, availability struct<terms: array<string>, months: array<long>>, unreadable string"


def model_requests(profiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rid, payload, refused``: the blocks of each profile as JSON; a text past MOST characters is refused, never cut.

    A refused profile has no payload, so no model is asked. Of a block BLOCK characters are sent, of a profile its first
    BLOCKS blocks. A profile without a block sends an empty list; a null text counts as empty.
    """
    piece = F.struct("block", F.concat(F.lit("b"), F.col("block")).alias("id"), "kind", "heading", F.substring("text", 1, BLOCK).alias("text"))
    listed = blocks.where(F.col("block") <= BLOCKS).groupBy("rid").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    sent = F.transform("pieces", lambda p: F.struct(*[p[c].alias(c) for c in ("id", "kind", "heading", "text")]))
    none = F.array().cast("array<struct<id: string, kind: string, heading: string, text: string>>")
    payload = F.to_json(F.struct(F.coalesce(sent, none).alias("blocks")))
    return refusals(profiles).join(listed, "rid", "left").select("rid", F.when(~F.col("refused"), payload).alias("payload"), "refused")


def refusals(profiles: DataFrame) -> DataFrame:
    """``rid, refused`` of ``model_requests``, without what would be sent."""
    return profiles.select("rid", (F.length(R.laid_out(F.col("text"))) > MOST).alias("refused"))


def anchors_hold(payload: str, answer: str) -> str:
    """What is wrong with a split: each experience must quote from the block that it names, white space aside; empty if nothing is."""
    text_of = {b["id"]: " ".join(b["text"].split()) for b in json.loads(payload)["blocks"]}
    for i, item in enumerate(json.loads(answer).get("experiences") or [], 1):
        anchor = " ".join((item.get("anchor") or "").split())
        if not anchor or anchor not in text_of.get(item.get("block_id"), ""):
            return f"experience {i} isn't quoted from its block"
    return ""


def misshapen(d: Column) -> Column:
    """Whether a draft is no such JSON, or past what a profile can hold. Nulls are things not stated; unknown fields are passed over."""
    none = F.array().cast(f"array<{ITEM}>")
    wrong = F.exists(F.coalesce(d["experiences"], none), lambda e: ~F.coalesce(e["kind"], F.lit("other")).isin(KINDS) | ~F.coalesce(e["months"], F.lit(0)).between(0, 600) | (F.length(F.coalesce(e["anchor"], F.lit(""))) > LONGEST_ANCHOR) | (F.length(F.coalesce(e["block_id"], F.lit(""))) > LONGEST_REF))
    many = (F.size(F.coalesce(d["experiences"], none)) > EXPERIENCES) | (F.coalesce(F.size(d["education"]), F.lit(0)) > EDUCATION) | (F.coalesce(F.size(d["domains"]), F.lit(0)) > DOMAINS)
    return d["unreadable"].isNotNull() | F.coalesce(wrong, F.lit(False)) | many


def checked_drafts(requests: DataFrame, blocks: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rid, draft, problem`` of each request, and the items ``rid, nth, item, block`` of the drafts that hold.

    ``answers(rid, answer)`` has one row a profile at most. A problem is ``refused`` (the text is too long to be sent), ``no answer``,
    ``misshapen`` or ``experience n`` (the first that isn't quoted from its block); a draft with a problem gives no items.
    """
    read = F.from_json("answer", DRAFT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "unreadable"})
    both = requests.select("rid", "refused").join(answers.select("rid", "answer"), "rid", "left").withColumn("draft", read)
    early = F.when(F.col("refused"), "refused").when(F.col("answer").isNull(), "no answer").when(misshapen(F.col("draft")), "misshapen")
    # the answers are looked at for their problems and again for their items
    drafts = written(both.select("rid", "draft", early.alias("early")))
    items = drafts.where("early is null").select("rid", F.posexplode("draft.experiences").alias("nth", "item")).withColumn("nth", F.col("nth") + 1)
    at = blocks.select("rid", F.concat(F.lit("b"), F.col("block")).alias("ref"), "block", T.collapse(F.col("text")).alias("body"), F.col("text").alias("b_text"))
    met = items.withColumn("ref", F.col("item.block_id")).join(at, ["rid", "ref"], "left")
    anchor = T.collapse(F.col("item.anchor"))
    met = written(met.select("rid", "nth", "item", "block", "b_text", F.coalesce((anchor != "") & F.contains("body", anchor), F.lit(False)).alias("holds")))
    first = met.where("not holds").groupBy("rid").agg(F.min("nth").alias("bad"))
    judged = drafts.join(first, "rid", "left").select("rid", "draft", F.coalesce("early", F.when(F.col("bad").isNotNull(), F.concat(F.lit("experience "), F.col("bad")))).alias("problem"))
    return judged, met.join(first, "rid", "left_anti").drop("holds")


def model_experiences(items: DataFrame, year: int, month: int) -> DataFrame:
    """The items as experiences, in the columns of ``profile.experiences_of``: dates that the block states beat the model's count of months.

    Months since the end come from the block alone. ``place`` is newest first, undated last, else as the model has them.
    """
    dates, said = R.date_range(F.col("b_text")), lambda c: F.coalesce(F.col(f"item.{c}"), F.lit(""))
    ago = R.months_ago(F.col("d"), year, month)
    listed = lambda c: F.coalesce(F.col(f"item.{c}"), F.array().cast("array<string>"))
    df = items.withColumn("d", dates).withColumn("months_ago", ago)
    df = df.select("rid", "nth", "block", F.coalesce("item.kind", F.lit("other")).alias("kind"), said("title").alias("title"), said("organization").alias("organization"), F.coalesce("d.months", "item.months").alias("months"), "months_ago", S.recency_weight(F.col("months_ago")).alias("recency"), said("summary").alias("summary"), listed("highlights").alias("highlights"), listed("technologies").alias("technologies"))
    return df.withColumn("place", F.row_number().over(Window.partitionBy("rid").orderBy(F.col("months_ago").asc_nulls_last(), "nth")).cast("long")).drop("nth")


def education_of(blocks: DataFrame) -> DataFrame:
    """``rid, education``: first line and latest year of each education block, EDUCATION at most."""
    years = F.regexp_extract_all("text", F.lit(r"\b(20\d{2})\b"), F.lit(1))
    line = F.substring(T.collapse(F.substring_index("text", "\n", 1)), 1, 300)
    item = F.struct("block", F.struct(line.alias("institution"), F.coalesce(F.array_max(years), F.lit("")).alias("graduation_year")).alias("e"))
    listed = blocks.where("kind = 'education'").groupBy("rid").agg(F.array_sort(F.collect_list(item)).alias("all"))
    return listed.select("rid", F.transform(F.slice("all", 1, EDUCATION), lambda x: x["e"]).alias("education"))


def placed_claims(profiles: DataFrame, blocks: DataFrame, experiences: DataFrame) -> DataFrame:
    """Skill claims (see ``profile.claims_of``) where the technologies of a model's experiences place skills in their blocks."""
    return R.claims_of(profiles, blocks, experiences.where("by_model").select("rid", "block", F.explode("technologies").alias("name")))


def modelled(profiles: DataFrame, blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """``rid, block, technologies, by_model`` of a model's experiences alone: what ``placed_claims`` reads, without what rules make of the other profiles."""
    items = checked_drafts(refusals(profiles), blocks, answers)[1]
    return items.select("rid", "block", F.col("item.technologies").alias("technologies"), F.lit(True).alias("by_model"))


def assembled(profiles: DataFrame, blocks: DataFrame, answers: DataFrame, year: int, month: int) -> tuple[DataFrame, DataFrame]:
    """Whole profiles, and their experiences with ``by_model``.

    ``rid, source, problem, headline, domains, education, months, terms, total_months, work_months, n_experiences, warning``: one row a
    profile. ``source`` is ``model`` where the answer holds; else ``rules``, with the problem, and all that is said comes from the
    text. Availability is the model's where it states any. Experiences are those of ``experiences_of`` (30 at most by rules) or
    ``model_experiences``. ``warning`` is ``no work`` (no block of work),
    ``no experiences`` (a model found none) or empty. An empty table gives two empty ones.
    """
    blocks = written(blocks)
    judged, items = checked_drafts(refusals(profiles), blocks, answers)
    judged = written(judged)
    by_rules = judged.where("problem is not null").select("rid")
    local = R.experiences_of(blocks.join(by_rules, "rid", "left_semi"), year, month).where(F.col("place") <= EXPERIENCES)
    theirs = model_experiences(items, year, month)
    experiences = written(local.withColumn("by_model", F.lit(False)).unionByName(theirs.withColumn("by_model", F.lit(True))))
    work = F.when(F.col("kind") == "work", F.coalesce("months", F.lit(0))).otherwise(0)
    sums = experiences.groupBy("rid").agg(F.count("*").alias("n_experiences"), F.sum(F.coalesce("months", F.lit(0))).alias("total_months"), F.sum(work).alias("work_months"))
    shown = F.col("kind").isin(R.EVIDENCE)
    facts = blocks.groupBy("rid").agg(F.max(shown).alias("has_work"), F.min_by(F.substring_index("text", "\n", 1), "block").alias("first_line"))
    df = judged.join(profiles.select("rid", R.availability(F.col("text")).alias("stated")), "rid").join(sums, "rid", "left").join(facts, "rid", "left").join(education_of(blocks).withColumnRenamed("education", "schools"), "rid", "left")
    model, d = F.col("problem").isNull(), F.col("draft")
    strings, longs = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    given = model & (F.coalesce(F.size(d["availability"]["terms"]) > 0, F.lit(False)) | F.coalesce(F.size(d["availability"]["months"]) > 0, F.lit(False)))
    education = F.when(model, d["education"]).otherwise(F.col("schools"))
    empty = F.array().cast("array<struct<institution: string, graduation_year: string>>")
    n = F.coalesce("n_experiences", F.lit(0)).cast("long")
    warning = F.when(~F.coalesce("has_work", F.lit(False)), "no work").when(model & (n == 0), "no experiences").otherwise("")
    whole = df.select("rid", F.when(model, "model").otherwise("rules").alias("source"), "problem", F.when(model, F.coalesce(d["headline"], F.lit(""))).otherwise(T.collapse(F.col("first_line"))).alias("headline"), F.when(model, F.coalesce(d["domains"], strings)).otherwise(strings).alias("domains"), F.coalesce(education, empty).alias("education"),
        F.when(given, F.coalesce(d["availability"]["months"], longs)).otherwise(F.col("stated.months").cast("array<bigint>")).alias("months"), F.when(given, F.coalesce(d["availability"]["terms"], strings)).otherwise(F.col("stated.terms")).alias("terms"), F.coalesce("total_months", F.lit(0)).cast("long").alias("total_months"), F.coalesce("work_months", F.lit(0)).cast("long").alias("work_months"), n.alias("n_experiences"), warning.alias("warning"))
    return whole, experiences
