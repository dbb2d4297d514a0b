"""The split of postings into those that are ranked and those that are not, each with its reason.

Rules are Columns over a posting's fields and its ``metadata`` map; nothing leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.functions import postings as P
from loomrank.functions import text as T
from loomrank.operators import rules

# Metadata keys that hold a status, keys that name a term (first one first), and the label of one in a posting's body.
STATUS_KEYS = ["status", "posting_status", "application_status"]
TERM_KEYS = ["Work Term Duration", "work_term_duration", "Work Term", "Level"]
TERM_LABEL = r"Work Term Duration:\s*\n(.{0,120})"
# Patterns of what a clause demands, waives and names.
IDENTITY = r"(?:citizenship|(?:Canadian |U\.?S\.? |American )?citizens?|permanent residen(?:ts?|cy|ce)|PR(?: status)?)"
DEMAND = (
    rf"\b(?:must|shall|need to|are required to|is required to)\s+(?:be|have|hold|possess)\s+(?:(?:a|an|the|either|valid|Canadian|U\.?S\.?)\s+){{0,3}}{IDENTITY}\b"
    rf"|\b(?:require(?:s|d)? that|only (?:accept|consider|hire)|restricted to|limited to|open only to)\s+(?:(?:applicants?|candidates?|students?|who|are|be|is|a|an|either|to)\s+){{0,7}}{IDENTITY}\b"
    rf"|\b(?:must|shall|are required to)\s+(?:be able to\s+)?(?:provide|show|present)\s+(?:valid\s+)?(?:documentation|proof|evidence)\s+(?:\w+\s+){{0,7}}{IDENTITY}\b"
    rf"|\b{IDENTITY}\b\s*(?:status\s+)?(?:(?:is|are)\s+)?(?:required|mandatory|only)\b"
)
PROGRAM = r"\bSWPP\b|\bStudent Work Placement Program(?:me)?\b"
WAIVERS = [r"\bnot\b|\b(?:preferred|preference|encouraged)\b", rf"\b(?:no|without)\s+(?:\w+\s+){{0,2}}{IDENTITY}\b", r"\bor\b.*\b(?:work permits?|international students?|student visas?)\b"]
# What a text holds that the patterns above can match once addresses are gone from it.
TELLING = r"(?i)citizen|permanent|SWPP|placement|\bPR(?:\b|https?://)"
TERM_FIRM = r"\b(?:must|required|requires|mandatory|only|need to)\b[^.;\n]{0,60}?\b\d{1,2}\s*[-–]?\s*month|\b\d{1,2}\s*[-–]?\s*month[^.;\n]{0,40}?\b(?:is\s+)?(?:required|mandatory|only|minimum)\b"
TERM_OPEN = r"\b(?:preferred|preference|ideally|nice to have|or\s+\d{1,2}\s*[-–]?\s*month|open to|flexible|either)\b"


def is_closed(metadata: Column) -> Column:
    """Any of four states closes a posting, and so does an ``is_open`` that is false in row or metadata."""
    states = [F.col("status"), *[F.element_at(metadata, F.lit(k)) for k in STATUS_KEYS]]
    said = reduce(lambda a, b: a | b, [F.coalesce(T.casefold(T.collapse(s)).isin(rules.CLOSED), F.lit(False)) for s in states])
    return said | F.coalesce(~F.col("is_open"), F.lit(False)) | F.coalesce(F.lower(F.element_at(metadata, F.lit("is_open"))) == "false", F.lit(False))


def deadline_text(value: Column) -> Column:
    text = F.trim(F.coalesce(value, F.lit("")))
    for pattern, by in ((r"(?i)\s*\((?:EST|EDT|ET)\)\s*$", ""), (r"(?i)\s+(?:EST|EDT|ET)$", ""), (r"(?i)\s+at\s+", " "), (r"(?i)(\d)(?:st|nd|rd|th)\b", "$1")):
        text = F.regexp_replace(text, pattern, by)
    return text


def deadline_state(value: Column, now: str, zone: str) -> Column:
    """``passed``, ``open``, ``blank`` or ``unread``: a date lasts to its end in the zone, a time without offset is of the zone.

    ISO texts come first, of any form; only ``yyyy-MM-dd`` is a whole day there, another date alone begins it.
    """
    text = deadline_text(value)
    day = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in rules.DATED]).cast("date")
    iso = T.iso_parts(text)
    wall = F.try_to_timestamp(F.concat(iso["date"], F.lit(" "), F.coalesce(iso["time"], F.lit("00:00:00"))))
    minutes = F.substring(iso["offset"], 2, 2).try_cast("bigint") * 60 + F.substring(iso["offset"], 5, 2).try_cast("bigint")
    away = F.when(F.substring(iso["offset"], 1, 1) == "-", -minutes).otherwise(minutes)
    local = F.to_timestamp(F.lit(now))
    utc = F.unix_micros(F.to_utc_timestamp(local, zone))
    moment = F.coalesce(F.when(iso["offset"].isNull(), wall), *[F.try_to_timestamp(text, F.lit(f)) for f in rules.TIMED])
    passed = F.coalesce(day < local.cast("date"), F.when(iso["offset"].isNotNull(), F.unix_micros(wall) - 60_000_000 * away < utc), moment < local)
    return F.when(text == "", "blank").when(passed.isNull(), "unread").when(passed, "passed").otherwise("open")


def restriction(texts: Column) -> Column:
    """Why the texts shut out who isn't a citizen or resident, or names the funded programme; null if they don't.

    Only texts that hold a telling word are parted into clauses.
    """

    def of_clause(c: Column) -> Column:
        waived = reduce(lambda a, b: a | b, [c.rlike("(?i)" + w) for w in WAIVERS])
        return F.when(~waived & c.rlike("(?i)" + DEMAND), F.regexp_extract(c, "(?i)" + DEMAND, 0))

    def of_text(t: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(t, r"https?://\S+", ""), r"(?i)\bU\.S\.(?:A\.)?", "US")
        clauses = F.transform(F.split(bare, r"(?i)[\n;.!?。；]+|\bbut\b"), lambda c: T.collapse(F.replace(c, F.lit(":"), F.lit(" "))))
        return F.when(bare.rlike("(?i)" + PROGRAM), F.lit("programme")).otherwise(F.get(F.filter(F.transform(clauses, of_clause), lambda x: x.isNotNull()), F.lit(0)))

    return F.get(F.filter(F.transform(F.filter(texts, lambda t: t.rlike(TELLING)), of_text), lambda x: x.isNotNull()), F.lit(0))


def rule_texts(metadata: Column) -> Column:
    return F.concat(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("title", "description", "requirements")]), P.leaves(metadata))


def term_sentence(metadata: Column) -> Column:
    """The first sentence that names a term of 1 to 24 months, of the first source that has one; null if none has."""
    labelled = F.regexp_extract(F.coalesce(F.element_at(metadata, F.lit("detail_text")), F.lit("")), TERM_LABEL, 1)
    sources = F.array(*[F.coalesce(F.element_at(metadata, F.lit(k)), F.lit("")) for k in TERM_KEYS], labelled, *[F.coalesce(F.col(c), F.lit("")) for c in ("requirements", "description", "title")])
    # most sources have no month at all, and aren't parted into sentences
    some = F.filter(sources, lambda s: s.rlike("(?i)month"))
    found = F.transform(some, lambda s: F.get(F.filter(F.split(T.digits_for_words(s), r"[\n;.](?:\s|$)"), T.names_months), F.lit(0)))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def term_facts(sentence: Column) -> Column:
    """``shortest, longest, firm, quote`` of a term's sentence, which should be a column of its own: each of the four reads it."""
    months = T.months_of(sentence)
    firm = sentence.rlike("(?i)" + TERM_FIRM) & ~sentence.rlike("(?i)" + TERM_OPEN)
    return F.struct(F.array_min(months).alias("shortest"), F.array_max(months).alias("longest"), F.coalesce(firm, F.lit(False)).alias("firm"), F.substring(T.collapse(sentence), 1, 300).alias("quote"))


def term_limit(preferred: object, stated: list[int]) -> int | None:
    """The longest term that is taken: a preference (0 turns the rule off) or else the longest that the profile states."""
    if isinstance(preferred, int) and not isinstance(preferred, bool):
        return preferred if preferred > 0 else None
    return max(stated) if stated else None


def merged_duplicates(df: DataFrame) -> DataFrame:
    """One row a ``key``: the row of the longest ``text`` (the first on ties), the first one's place, whether any is closed.

    The row travels as one struct through combinable aggregates; a key with a third of all rows is no window.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    best = F.max_by(row, F.struct(F.length("text"), -F.col("pos")))
    one = df.groupBy("key").agg(best.alias("row"), F.min("pos").alias("first_pos"), F.max(F.col("closed").cast("int")).alias("any_closed"), F.count("*").alias("copies"))
    return one.select(F.col("first_pos"), F.col("copies"), *[(F.col("any_closed") == 1).alias("closed") if c == "closed" else F.col(f"row.{c}").alias(c) for c in df.columns])


def split_postings(df: DataFrame, now: str, zone: str, keywords: list[str], limit: int | None, restricted: bool = True) -> DataFrame:
    """``df`` with ``reason`` (empty for rows that stay) and ``warning``; the first rule that holds names the reason."""
    metadata = F.col("metadata")
    words = [k for k in keywords if k.strip()]
    hits = F.array_compact(F.array(*[F.when(T.folded_mentions(F.col("folded"), k), F.lit(k)) for k in words])) if words else F.array().cast("array<string>")
    df = df.withColumns({"folded": T.casefold(F.coalesce("text", F.lit(""))), "sentence": term_sentence(metadata)})
    df = df.withColumns({"state": deadline_state(F.col("deadline"), now, zone), "restricted": restriction(rule_texts(metadata)) if restricted else F.lit(None).cast("string"), "hits": hits, "term": term_facts(F.col("sentence"))})
    reason = F.when(F.col("closed"), "closed").when(F.col("state") == "passed", "expired").when(F.col("restricted").isNotNull(), F.concat(F.lit("restricted: "), "restricted"))
    reason = reason.when(F.size("hits") > 0, F.concat(F.lit("keywords: "), F.array_join("hits", ", ")))
    if limit is not None:
        reason = reason.when(F.col("term.shortest") > limit, F.concat(F.lit("term: "), F.col("term.shortest").cast("string"), F.lit(f" > {limit}: "), F.col("term.quote")))
    warning = F.when(F.col("state").isin("blank", "unread"), F.concat(F.lit("deadline "), "state")).otherwise("")
    return df.withColumn("reason", reason.otherwise("")).withColumn("warning", F.when(F.col("reason") == "", warning).otherwise("")).drop("folded", "sentence", "state", "restricted", "hits", "term")


def split_duplicates(df: DataFrame, now: str, zone: str, keywords: list[str], limit: int | None) -> DataFrame:
    """``pos, reason, warning`` of each row: what ``split_postings`` says of ``merged_duplicates``, and the other rows of a key as duplicates of its first place.

    Rules read the rows before they are merged and only what they say is shuffled, so no text leaves the task that reads it.
    Closing alone belongs to the whole key, and it comes before all other reasons.
    """
    ruled = split_postings(df, now, zone, keywords, limit).select("key", "pos", "closed", F.length("text").alias("size"), "reason", "warning")
    best = F.max_by(F.struct("pos", "reason", "warning"), F.struct("size", -F.col("pos")))
    one = ruled.groupBy("key").agg(best.alias("row"), F.max("closed").alias("any_closed"))
    of_key = lambda otherwise, closed: F.when(F.col("any_closed"), closed).otherwise(F.col(otherwise))
    kept = one.select("row.pos", of_key("row.reason", "closed").alias("reason"), of_key("row.warning", "").alias("warning"))
    places = df.select("key", "pos")
    firsts = places.groupBy("key").agg(F.min("pos").alias("first_pos"))
    again = places.join(firsts, "key").where("pos > first_pos").select("pos", F.lit("duplicate").alias("reason"), F.lit("").alias("warning"))
    return again.unionByName(kept)
