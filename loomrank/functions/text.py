"""Text functions: Column in, Column out; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no content in a posting or a profile.
STOP_WORDS = """a an and are as at be been being by can co coop co-op company could did do does
each employer employment for from full have has had how i if in into is it its
job jobs join may more must of on one opportunity or our position relevant role
seeking some such team than that the their them then there these they this those
through to under up us using was we were what when where which who will with
would you your university waterloo resume email phone linkedin github apply about
able strong excellent including""".split()
# Spelled numbers of durations.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "sixteen": 16}
WORD = r"[\p{L}\p{N}_]"
BEYOND_ASCII = r"[^\x00-\x7f]"
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}_+#.\-]*"


def casefold(text: Column) -> Column:
    """Lower case with sharp s as ss, which is where case folding and lower case part in practice."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapse(text: Column) -> Column:
    """White-space runs as one blank, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def clean_unicode(text: Column) -> Column:
    """NUL as a blank, soft hyphens gone: what ``compatible`` does beyond NFKC, for texts that are in that form."""
    return F.replace(F.replace(text, F.lit("\x00"), F.lit(" ")), F.lit("\u00ad"), F.lit(""))


def by_icu(kind: str, method: str, text: Column) -> Column:
    """A text's form by a static method of the Unicode library that comes with the engine; texts of ASCII alone spare the call."""
    return F.when(text.rlike(BEYOND_ASCII), F.java_method(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), text, F.lit(True))).otherwise(text)


def compatible(text: Column) -> Column:
    """NFKC, NUL as a blank, soft hyphens gone; null stays null.

    The call is no pure function to the planner: select it in a projection of its own (``normalised``), not in join conditions
    or above filters that are to be pushed down.
    """
    return clean_unicode(by_icu("text.Normalizer", "compose", text))


def full_casefold(text: Column) -> Column:
    """Full case folding of all scripts; as with ``compatible``, in a projection of its own."""
    return by_icu("lang.UCharacter", "foldCase", F.when(text.rlike(BEYOND_ASCII), text).otherwise(F.lower(text)))


def normalised(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the named text columns in compatible form: ligatures and full-width letters read like plain ones from here on.

    One projection in the JVM. What follows, whether tokens, spans or quotes, sees the same text, so offsets and quotes agree.
    """
    return df.withColumns({c: compatible(F.col(c)) for c in columns})


def ordered_distinct(values: Column) -> Column:
    """Values, each once, in order of their first occurrence, without nulls and empty ones; null as none."""
    return F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v != ""))


def folded_tokens(folded: Column) -> Column:
    """Content tokens of a text that is in compatible form and folded."""
    stripped = F.transform(F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0)), lambda t: F.btrim(t, F.lit(".-")))
    return F.filter(stripped, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS) & ~t.rlike(r"^\p{N}+$"))


def tokens(text: Column) -> Column:
    """Content tokens: folded, stripped of dots and dashes, no stop words, no bare numbers, longer than one character."""
    return folded_tokens(casefold(clean_unicode(F.coalesce(text, F.lit("")))))


def mentions(text: Column, phrase: str) -> Column:
    """Whole-phrase containment without regard to case; a blank phrase is nowhere."""
    return folded_mentions(casefold(F.coalesce(text, F.lit(""))), phrase)


def folded_mentions(folded: Column, phrase: str) -> Column:
    """``mentions`` of a text that is folded; only one that holds the phrase at all is asked for its ends."""
    p = phrase.lower().replace("ß", "ss").strip()
    if not p:
        return F.lit(False)
    return F.contains(folded, F.lit(p)) & folded.rlike(f"(?<!{WORD})" + "".join("\\" + c if re.match(r"[^\w\s]", c) else c for c in p) + f"(?!{WORD})")


def verbatim(quote: Column, source: Column, least: int = 8) -> Column:
    """Whether a quote of some length lies in its source, white space aside."""
    q = collapse(quote)
    return (F.length(q) >= least) & (F.instr(collapse(source), q) > 0)


def digits_for_words(text: Column) -> Column:
    """``eight-month`` as ``8-month``, so one numeric rule reads both.

    Few texts have any such word: only those go through a pattern for each.
    """
    changed, low = text, F.lower(text)
    for word, n in NUMBER_WORDS.items():
        changed = F.regexp_replace(changed, rf"(?i)(?<![\p{{L}}\p{{N}}_-]){word}(\s*[-–]?\s*)(month|week|term)", f"{n}$1$2")
    unit = F.contains(low, F.lit("month")) | F.contains(low, F.lit("week")) | F.contains(low, F.lit("term"))
    spelled = unit & text.rlike(rf"(?i)(?:{'|'.join(NUMBER_WORDS)})\s*[-–]?\s*(?:month|week|term)")
    return F.when(spelled, changed).otherwise(text)


def months_of(sentence: Column) -> Column:
    """Different numbers of months, 1 to 24, of one sentence in which durations are digits, in order."""
    found = F.transform(F.regexp_extract_all(sentence, F.lit(rf"(?i)(?<!{WORD})(\d{{1,2}})\s*[-–]?\s*month"), F.lit(1)), lambda m: m.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda m: m.between(1, 24))))


def names_months(sentence: Column) -> Column:
    """Whether ``months_of`` finds any."""
    return sentence.rlike(rf"(?i)(?<!{WORD})(?:0?[1-9]|1\d|2[0-4])\s*[-–]?\s*month")


def term_months(text: Column) -> Column:
    """Months, 1 to 24, of the first sentence that names any; null if none does."""
    sentences = F.split(digits_for_words(F.coalesce(text, F.lit(""))), r"[\n;.](?:\s|$)")
    return F.get(F.filter(F.transform(sentences, months_of), lambda m: F.size(m) > 0), F.lit(0))


def sentences(text: Column, least: int = 25, longest: int = 600) -> Column:
    """Chunks of a text: lines and sentences without bullet marks, of ``least`` characters or more, cut at ``longest``."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?:\n+|(?<=[.;!?。；])\s+)")
    bare = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s*(?:[-*•·▪◦‣]|\d+[.)])\s+", "")))
    return F.transform(F.filter(bare, lambda p: F.length(p) >= least), lambda p: F.substring(p, 1, longest))


def csv_guard(value: Column) -> Column:
    """A quote mark before what a spreadsheet would run as a formula."""
    risky = F.ltrim(value).rlike(r"^[=+\-@]") | value.rlike(r"^[\t\r]")
    return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value)


def content_hash(text: Column) -> Column:
    return F.sha2(collapse(text), 256)


# Date, time and offset of an ISO text: with or without marks between the numbers, time and its lesser parts may be left out.
ISO = r"^(\d{4})(-?)(\d\d)\2(\d\d)(?:\D(\d\d)(?:(:?)(\d\d)(?:\6(\d\d)(?:[.,](\d{1,6})\d*)?)?)?(Z|[+-]\d\d(?::?\d\d(?::?\d\d)?)?)?)?$"


def iso_parts(text: Column) -> Column:
    """``date, time, offset`` of an ISO text as texts (``yyyy-MM-dd``, ``HH:mm:ss.f``, ``+HH:mm``); null where it has none."""
    g = lambda i: F.regexp_extract(text, ISO, i)
    day = F.when(text.rlike(ISO), F.concat_ws("-", g(1), g(3), g(4)))
    or_zero = lambda i: F.coalesce(F.nullif(g(i), F.lit("")), F.lit("00"))
    time = F.when(g(5) != "", F.concat(g(5), F.lit(":"), or_zero(7), F.lit(":"), or_zero(8), F.when(g(9) != "", F.concat(F.lit("."), g(9))).otherwise("")))
    digits = F.rpad(F.replace(F.substring(g(10), 2, 9), F.lit(":")), 4, "0")
    offset = F.when(g(10) == "Z", "+00:00").when(g(10) != "", F.concat(F.substring(g(10), 1, 1), F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2)))
    return F.struct(day.alias("date"), time.alias("time"), offset.alias("offset"))


def iso_instant(text: Column) -> Column:
    """The moment of an ISO text with time and offset; null without either, and where a number is out of its range."""
    p = iso_parts(text)
    return F.when(p["offset"].isNotNull(), F.try_to_timestamp(F.concat(p["date"], F.lit(" "), p["time"], p["offset"])))
