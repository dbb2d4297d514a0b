"""Structure of a profile text: lines, sections, entries, blocks, dates and claims, by windows over a profile's lines.

A profile is bounded by its document, so its windows are small; profiles are dealt by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrank.functions import scores as S
from loomrank.functions import skills as K
from loomrank.functions import text as T
from loomrank.streaming.upsert import written

# Kinds of sections and how their headings read, first one first.
SECTIONS = [
    ("education", r"education|academic(?:\s+background)?|schooling|教育(?:背景|经历)?|学历"),
    ("experience", r"(?:[a-z][a-z&/+-]*(?:\s+[a-z][a-z&/+-]*)?\s+)?experiences?|employment(?:\s+history)?|internships?|co-?op(?:\s+experience)?|positions?\s+held|工作(?:经历|经验)|实习(?:经历|经验)?"),
    ("project", r"(?:technical|personal|academic|selected|side|key)?\s*projects?|portfolio|项目(?:经历|经验)?"),
    ("skills", r"(?:technical|core|professional|key|relevant)?\s*skills(?:\s*(?:&|and)\s*\w+)?|technolog(?:y|ies)|tools?(?:\s*(?:&|and)\s*technologies)?|competenc(?:y|ies)|programming\s+languages|tech\s+stack|技能|技术(?:技能|栈)?|专业技能"),
    ("award", r"awards?|honou?rs?|achievements?|certifications?|licen[cs]es?|scholarships?|获奖|证书"),
    ("publication", r"publications?|papers?|research|patents?|conferences?|论文|研究"),
    ("activity", r"(?:extracurricular|volunteer|leadership|community)\s*(?:activities|experience|work)?|activities|involvement|clubs?|societ(?:y|ies)|社团|志愿"),
    ("summary", r"summary|objective|profile|about(?:\s+me)?|highlights?|个人简介|自我评价"),
]
EVIDENCE = ["experience", "project", "publication", "activity"]
SPLIT_KINDS = [*EVIDENCE, "education"]
# Months, seasons and their months, the forms of a date and of a range, bullets, words of roles.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
SEASONS = {"winter": 1, "spring": 5, "summer": 5, "fall": 9, "autumn": 9}
MONTH_NAME = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"
POINT = rf"(?:(?:{MONTH_NAME}|(?:spring|summer|fall|autumn|winter))\.?\s*,?\s*)?(?:\d{{4}}|\d{{1,2}}[/-]\d{{4}})"
NOW_WORDS = "present|current|now|今"
RANGE = rf"(?:^|[^\p{{L}}\p{{N}}_])({POINT})\s*(?:[-–—]|to|至|~)\s*({POINT}|{NOW_WORDS})"
BULLET = r"^\s*(?:[-*•·▪◦‣]|\d+[.)])\s+"
DATE_IN_LINE = rf"(^|[^\p{{L}}\p{{N}}_])(?:{MONTH_NAME}\.?\s*,?\s*\d{{4}}|\d{{1,2}}[/-]\d{{4}}|(?:present|current)\b)|[-–—]\s*$"
ROLES = r"\b(?:intern(?:ship)?s?|co-?op|engineer|developer|programmer|analyst|scientist|researcher|assistant|associate|manager|director|lead|consultant|designer|architect|administrator|specialist|technician|officer|founder|instructor|tutor|fellow|trainee|volunteer|工程师|实习生?|助理|研究员|开发)\b"
AVAILABLE = r"(?:available|availability|seeking|looking for)[^.\n]{0,80}?(\d{1,2})\s*[- ]?\s*month"
TERM = r"\b(20\d{2})\s*[-–]?\s*(winter|spring|summer|fall|autumn)\b|\b(winter|spring|summer|fall|autumn)\s+(20\d{2})\b"
LABEL = r"((?:" + "|".join(p for _, p in SECTIONS) + r"))\s*[:：]"


def heading_text(line: Column) -> Column:
    bare = F.regexp_replace(F.trim(line), r"^#{1,6}\s*", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"^(?:\*+|_+)", ""), r"(?:\*+|_+)$", ""))
    return F.trim(F.regexp_replace(bare, r"[:：]+$", ""))


def heading_kind(line: Column) -> Column:
    """The kind of section that a line heads; null if it heads none."""

    def kind_of(bare: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name, pattern in reversed(SECTIONS):
            kind = F.when(bare.rlike(rf"(?i)^[^\p{{L}}\p{{N}}_]*(?:{pattern})[^\p{{L}}\p{{N}}_]*$"), F.lit(name)).otherwise(kind)
        # most lines head nothing, and are asked for all kinds at once
        return F.when(bare.rlike(rf"(?i)^[^\p{{L}}\p{{N}}_]*(?:{'|'.join(p for _, p in SECTIONS)})[^\p{{L}}\p{{N}}_]*$") & bare.rlike(r"\p{L}"), kind)

    # bound by an aggregate of nothing, or the planner writes the bare heading out once for each kind
    nothing = F.array().cast("array<int>")
    return F.when(F.length(F.trim(line)) <= 70, F.aggregate(nothing, heading_text(line), lambda bare, _: bare, kind_of))


def laid_out(text: Column) -> Column:
    """The text with labels inside lines of more than 120 characters, behind the end of a sentence, on lines of their own."""
    broken = lambda x: F.when(F.length(x) > 120, F.regexp_replace(x, rf"(?i)([.;。；])\s*({LABEL})", "$1\n$2")).otherwise(x)
    return F.array_join(F.transform(F.split(T.clean_unicode(F.coalesce(text, F.lit(""))), r"\r?\n"), broken), "\n")


def lines_of(profiles: DataFrame) -> DataFrame:
    """``rid, no, start, line, kind, label, section``: lines with the place where they begin and the section they are in.

    Where a document has headings of their own lines, labels before a colon are none.
    """
    # outer, or the planner lays all texts out once more to see whether there are any lines, and before they are dealt out
    rows = profiles.select("rid", F.split(laid_out(F.col("text")), "\n").alias("lines")).select("rid", F.posexplode_outer("lines").alias("no", "line"))
    of, before = Window.partitionBy("rid"), Window.partitionBy("rid").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")).withColumn("head", heading_kind(F.col("line")))
    label = F.regexp_extract(F.trim("line"), rf"(?i)^{LABEL}", 1)
    inline = F.max(F.col("head").isNotNull().cast("int")).over(of) == 0
    rows = rows.withColumn("label", F.when(inline & (label != ""), label)).withColumn("labelled", heading_kind(F.col("label")))
    rows = rows.withColumn("opens", F.coalesce("head", "labelled"))
    section = F.sum(F.col("opens").isNotNull().cast("int")).over(Window.partitionBy("rid").orderBy("no")).cast("long")
    rest = F.regexp_replace(F.trim("line"), rf"(?i)^{LABEL}\s*", "")
    rows = rows.withColumn("section", section).withColumn("content", F.when(F.col("head").isNotNull(), "").when(F.col("labelled").isNotNull(), rest).otherwise(F.col("line")))
    start = F.when(F.col("labelled").isNotNull(), F.col("start") + F.length("line") - F.length("content")).otherwise(F.col("start"))
    kind = F.coalesce(F.max("opens").over(Window.partitionBy("rid", "section")), F.lit("header"))
    heading = F.coalesce(F.max(F.when(F.col("opens").isNotNull(), F.regexp_replace(F.trim(F.coalesce("label", "line")), r"[:：]+$", ""))).over(Window.partitionBy("rid", "section")), F.lit(""))
    return rows.select("rid", "no", start.alias("start"), F.col("content").alias("line"), kind.alias("kind"), heading.alias("heading"), "section")


def entries_of(lines: DataFrame) -> DataFrame:
    """``lines`` with ``entry``: numbered in each section, from one boundary to the next.

    A line with a date range that is no bullet is a boundary. So is an unindented line that begins like a headline once
    bullets have come since the last line of either sort: if none came since that one, none came since the last boundary.
    """
    w = Window.partitionBy("rid", "section").orderBy("no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    stripped = F.trim(F.col("line"))
    bullet = F.col("line").rlike(BULLET)
    dated = F.col("line").rlike("(?i)" + RANGE) & ~bullet
    shaped = ~bullet & ~F.col("line").rlike(r"^\s") & (F.length(stripped) <= 120) & stripped.rlike(r"^[\p{L}\p{N}]") & ~stripped.rlike(r"^\p{Ll}")
    df = lines.withColumn("bullet", bullet).withColumn("dated", dated).withColumn("shaped", shaped)
    last_bullet, last_line = F.max(F.when(F.col("bullet"), F.col("no"))).over(before), F.max(F.when(F.col("dated") | F.col("shaped"), F.col("no"))).over(before)
    resumed = F.col("shaped") & F.coalesce(last_bullet > F.coalesce(last_line, F.lit(-1)), F.lit(False))
    df = df.withColumn("boundary", F.col("kind").isin(SPLIT_KINDS) & (F.col("dated") | resumed))
    return df.withColumn("entry", F.sum(F.col("boundary").cast("int")).over(w).cast("long")).drop("dated", "shaped", "boundary")


def point_of(text: Column) -> Column:
    """``year * 12 + month`` of one end of a range; null for a word like present."""
    low = F.lower(F.trim(text))
    word = F.regexp_extract(low, r"[a-z]{3,}", 0)
    month = F.lit(1)
    for name, m in SEASONS.items():
        month = F.when(word.startswith(name), m).otherwise(month)
    for i, name in enumerate(MONTHS):
        month = F.when(word.startswith(name), i + 1).otherwise(month)
    digits = F.regexp_extract(low, r"^(\d{1,2})[/-]\d{4}", 1)
    month = F.when(word != "", month).when(digits != "", F.least(F.lit(12), F.greatest(F.lit(1), digits.try_cast("int")))).otherwise(1)
    return F.regexp_extract(low, r"\d{4}", 0).try_cast("int") * 12 + month


def date_range(text: Column) -> Column:
    """``start, end, ongoing, months`` of the first range: ends as year * 12 + month, months inclusive and 1 to 600."""
    first, last = F.regexp_extract(text, "(?i)" + RANGE, 1), F.regexp_extract(text, "(?i)" + RANGE, 2)
    ongoing = last.rlike(rf"(?i)^(?:{NOW_WORDS})$")
    start, end = point_of(first), F.when(~ongoing, point_of(last))
    span = end - start + 1
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), ongoing.alias("ongoing"), F.when(span.between(1, 600), span).cast("long").alias("months"))


def months_ago(dates: Column, year: int, month: int) -> Column:
    """Months since the end; 0 while it goes on, null where no end is known."""
    return F.when(dates["ongoing"], F.lit(0)).when(dates["end"].isNotNull(), F.greatest(F.lit(0), year * 12 + month - dates["end"])).cast("long")


def blocks_of(profiles: DataFrame) -> DataFrame:
    """``rid, block, kind, heading, text, start, stop, bullets``: blocks of each profile, numbered from 1 in order."""
    df = entries_of(lines_of(profiles))
    row = F.struct("no", "start", "line", "bullet")
    df = df.groupBy("rid", "section", "entry", "kind", "heading").agg(F.array_sort(F.collect_list(row)).alias("all_rows"))
    df = df.withColumn("rows", F.filter("all_rows", lambda r: F.trim(r["line"]) != "")).where(F.size("rows") > 0)
    # blank lines inside a block are part of its text, so that it is the slice from start to stop
    inside = F.filter("all_rows", lambda r: r["no"].between(F.get("rows", F.lit(0))["no"], F.element_at("rows", -1)["no"]))
    text = F.array_join(F.transform(inside, lambda r: r["line"]), "\n")
    bullets = F.transform(F.filter("rows", lambda r: r["bullet"]), lambda r: T.collapse(F.regexp_replace(r["line"], BULLET, "")))
    last = F.element_at("rows", -1)
    df = df.select("rid", "section", "entry", "kind", "heading", text.alias("text"), F.get("rows", F.lit(0))["start"].alias("start"), (last["start"] + F.length(last["line"])).alias("stop"), bullets.alias("bullets"))
    return df.withColumn("block", F.row_number().over(Window.partitionBy("rid").orderBy("section", "entry")).cast("long")).drop("section", "entry")


def headline_parts(line: Column) -> Column:
    """``title, organization`` of an entry's first line, dates aside; where only the second part names a role they change places."""
    bare = F.regexp_replace(F.regexp_replace(line, "(?i)" + DATE_IN_LINE, "$1"), r"\s{2,}\S.*$", "")
    bare = F.btrim(bare, F.lit(" ,|-–—"))
    dashed = r"\s[—–]\s|\s-\s"
    head = F.when(bare.rlike(dashed), F.get(F.split(bare, dashed, 2), F.lit(0))).otherwise(F.regexp_extract(bare, "^[^,]*", 0))
    tail = F.when(bare.rlike(dashed), F.get(F.split(bare, dashed, 2), F.lit(1))).otherwise(F.regexp_extract(bare, "^[^,]*,(.*)$", 1))
    head, tail = F.btrim(head, F.lit(" ,|")), F.btrim(tail, F.lit(" ,|"))
    swap = (tail != "") & tail.rlike("(?i)" + ROLES) & ~head.rlike("(?i)" + ROLES)
    first, second = F.when(swap, tail).otherwise(head), F.when(swap, head).otherwise(tail)
    return F.struct(F.substring(T.collapse(first), 1, 300).alias("title"), F.substring(T.collapse(second), 1, 300).alias("organization"))


def availability(text: Column) -> Column:
    """``months, terms``: lengths that are said to be available, six at most, and named terms, twelve at most."""
    digits = T.digits_for_words(F.coalesce(text, F.lit("")))
    months = F.filter(F.transform(F.regexp_extract_all(digits, F.lit("(?i)" + AVAILABLE), F.lit(1)), lambda m: m.cast("int")), lambda m: m.between(1, 24))
    season = lambda t: F.initcap(F.regexp_extract(t, "(?i)(winter|spring|summer|fall|autumn)", 1))
    terms = F.transform(F.regexp_extract_all(digits, F.lit("(?i)" + TERM), F.lit(0)), lambda t: F.concat(F.regexp_extract(t, r"20\d{2}", 0), F.lit(" "), season(t)))
    return F.struct(F.slice(F.array_sort(F.array_distinct(months)), 1, 6).alias("months"), F.slice(F.array_distinct(terms), 1, 12).alias("terms"))


def experiences_of(blocks: DataFrame, year: int, month: int) -> DataFrame:
    """Evidence blocks as experiences: ``rid, block, kind, title, organization, months, months_ago, recency, summary, highlights, technologies, place``.

    ``place`` numbers a profile's experiences newest first, undated ones last.
    """
    kinds = F.create_map(*[F.lit(x) for pair in (("experience", "work"), ("project", "project"), ("publication", "research"), ("activity", "leadership")) for x in pair])
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    df = blocks.where(F.col("kind").isin(EVIDENCE)).withColumn("lines", lines).withColumn("dates", date_range(F.col("text")))
    headed = (F.length(F.get("lines", F.lit(0))) <= 120) & (F.size("lines") > 1)
    parts = F.when(headed, headline_parts(F.get("lines", F.lit(0))))
    body = F.when(headed, F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines"))
    ago = months_ago(F.col("dates"), year, month)
    df = df.select("rid", "block", F.element_at(kinds, F.col("kind")).alias("kind"), F.coalesce(parts["title"], F.lit("")).alias("title"), F.coalesce(parts["organization"], F.lit("")).alias("organization"), F.col("dates.months").alias("months"), ago.alias("months_ago"), S.recency_weight(ago).alias("recency"), F.substring(T.collapse(F.array_join(F.slice(body, 1, 3), " ")), 1, 800).alias("summary"), F.slice(F.transform("bullets", lambda b: F.substring(b, 1, 300)), 1, 12).alias("highlights"), F.slice(K.skills_of(F.col("text")), 1, 40).alias("technologies"))
    return df.withColumn("place", F.row_number().over(Window.partitionBy("rid").orderBy(F.col("months_ago").asc_nulls_last(), "block")).cast("long"))


def mentions_in(profiles: DataFrame) -> DataFrame:
    """``rid, start, canonical``: every mention of a skill in the profiles as they are laid out."""
    # laid out in a projection of its own, which is read several times; outer, or the planner asks for all mentions once
    # more to see whether there are any
    laid = profiles.select("rid", laid_out(F.col("text")).alias("laid"))
    laid = laid.withColumn("folded", K.folded_text(F.col("laid"))).withColumn("found", K.aliases_in(F.col("folded")))
    return laid.select("rid", F.inline_outer(K.mentions_at(F.col("laid"), F.col("folded"), F.col("found")))).where("canonical is not null")


def claims_of(profiles: DataFrame, blocks: DataFrame, attributed: DataFrame | None = None) -> DataFrame:
    """``rid, skill, tier, blocks``: shown in the work (3), placed in it by a model (2) or merely listed (1); blocks in order.

    ``attributed(rid, block, name)`` says which skill a model places in which block. A skill that the profile names
    nowhere counts only where the block's own text has it.
    """
    # blocks and mentions are looked at more than once: each is worked out once and written
    blocks = written(blocks.select("rid", "block", "kind", "text", "start", "stop"))
    # patterns cost far more than the texts are large: they are dealt out, however few files they come in
    dealt = profiles.repartition(int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rid")
    found = written(mentions_in(dealt))
    spans = blocks.select(F.col("rid").alias("b_rid"), "block", F.col("start").alias("b_start"), "stop", F.col("kind").isin(EVIDENCE).alias("evidence"), F.col("text").alias("b_text"))
    placed = found.join(spans, (F.col("rid") == F.col("b_rid")) & (F.col("start") >= F.col("b_start")) & (F.col("start") < F.col("stop")), "left")
    rows = placed.select("rid", F.col("canonical").alias("skill"), F.when(F.col("evidence"), 3).otherwise(1).alias("tier"), "block")
    if attributed is not None:
        known_as = attributed.select("rid", "block", "name", K.skills_of(F.col("name")).alias("as"))
        named = known_as.select("rid", "block", "name", F.explode_outer(F.when(F.size("as") > 0, F.col("as")).otherwise(F.array(T.collapse(F.col("name"))))).alias("skill"))
        named = named.join(spans.where("evidence").select(F.col("b_rid").alias("rid"), "block", "b_text"), ["rid", "block"])
        known = rows.select("rid", "skill").distinct().withColumn("known", F.lit(True))
        named = named.join(known, ["rid", "skill"], "left")
        inside = F.contains(T.casefold(F.col("b_text")), T.casefold(T.collapse(F.col("name"))))
        rows = rows.unionByName(named.where(F.col("known") | inside).select("rid", "skill", F.when(F.col("known"), 2).otherwise(3).alias("tier"), "block"))
    got = rows.groupBy("rid", "skill").agg(F.max("tier").cast("long").alias("tier"), F.collect_set(F.struct("tier", "block")).alias("at"))
    # where the work itself shows a skill, a model's placing adds nothing
    told = F.filter("at", lambda x: x["block"].isNotNull() & ~((x["tier"] == 2) & (F.col("tier") == 3)))
    return got.select("rid", "skill", "tier", F.array_sort(F.array_distinct(F.transform(told, lambda x: x["block"]))).alias("blocks"))


def chunks_of(experiences: DataFrame, claims: DataFrame, most: int = 200) -> DataFrame:
    """``rid, ord, chunk, weight``: an experience's summary, each highlight and its technologies, then the listed skills."""
    summary = T.collapse(F.concat_ws(" ", "title", "organization", "summary"))
    pieces = F.concat(F.array(F.struct(summary.alias("chunk"), F.col("recency").alias("weight"))), F.transform("highlights", lambda h: F.struct(T.collapse(h).alias("chunk"), F.col("recency").alias("weight"))), F.array(F.struct(F.array_join("technologies", ", ").alias("chunk"), F.round(0.8 * F.col("recency"), 6).alias("weight"))))
    rows = experiences.select("rid", F.col("place").alias("major"), F.posexplode(F.filter(pieces, lambda p: p["chunk"] != "")).alias("minor", "p")).select("rid", "major", "minor", "p.chunk", "p.weight")
    listed = claims.where("tier = 1").groupBy("rid").agg(F.array_join(K.sorted_names(F.collect_list("skill")), ", ").alias("chunk"))
    rows = rows.unionByName(listed.select("rid", F.lit(1 << 20).cast("long").alias("major"), F.lit(0).alias("minor"), "chunk", F.lit(S.LISTED_WEIGHT).alias("weight")))
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("rid").orderBy("major", "minor")).cast("long"))
    return rows.where(F.col("ord") <= most).select("rid", "ord", "chunk", "weight")
