"""Renderings, keys and states of a posting; Columns of the posting's fields in, Column out.

A posting has ``id, title, company, location, description, requirements, deadline, url, status`` (strings), ``is_open``
(boolean or null) and ``metadata`` (a map of strings).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomrank.functions.text import casefold, collapse

# Bookkeeping keys that a rule doesn't read, keys that the canonical document has, fields of either text.
BOOKKEEPING = ["detail_status", "detail_collected_at", "detail_error"]
DOCUMENT_KEYS = ["detail_text", "Special Job Requirements", "Work Term Duration", "Targeted Degrees and Disciplines", "Level"]
FIELDS = ["title", "company", "location", "description", "requirements"]
VERSION = 1
BOARD = "https://waterlooworks.uwaterloo.ca/myAccount/co-op/full/jobs.htm"


def blank_as_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def flatten_list(values: Column) -> Column:
    return F.array_join(values, " ")


def flatten_map(values: Column) -> Column:
    """``key: value`` of each entry, parted by blanks."""
    return F.array_join(F.transform(F.map_entries(values), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), " ")


def leaves(metadata: Column) -> Column:
    """Strings of the metadata as rules read them, each behind its key."""
    return F.transform(F.filter(F.map_entries(metadata), lambda e: e["value"].isNotNull()), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))


def job_text(metadata: Column) -> Column:
    """All that a rule may read: the fields and the metadata without bookkeeping, one a line, blanks left out."""
    kept = F.map_filter(metadata, lambda k, v: ~k.isin(BOOKKEEPING))
    lines = F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.concat_ws("\n", *[blank_as_null(F.col(c)) for c in FIELDS], lines)


def job_document(metadata: Column) -> Column:
    """The canonical text that quotes are verified against."""
    named = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c), F.lit(""))) for c in FIELDS]
    more = [F.when(blank_as_null(F.element_at(metadata, F.lit(k))).isNotNull(), F.concat(F.lit(f"{k}: "), F.element_at(metadata, F.lit(k)))) for k in DOCUMENT_KEYS]
    return F.concat_ws("\n", *named, *more)


def retrieval_text() -> Column:
    """What BM25 reads: the title counts twice, metadata doesn't."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", *FIELDS)])


def cache_key(document: Column) -> Column:
    return F.concat(F.lit(f"requirements:{VERSION}:"), F.sha2(collapse(document), 256))


def embedding_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("\x00"), text), 256)


def sorted_json(values: Column) -> Column:
    """A map as JSON with its keys in order: what a hash can be taken of."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def dedupe_key() -> Column:
    """The id, else the address with scheme and host in lower case and no fragment, else title, company and location."""
    url = F.trim("url")
    shape = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^#]*)"
    address = F.when(url.rlike(shape), F.concat(F.lower(F.regexp_extract(url, shape, 1)), F.lit("://"), F.lower(F.regexp_extract(url, shape, 2)), F.regexp_extract(url, shape, 3))).otherwise(F.regexp_replace(url, "#.*$", ""))
    content = F.concat_ws("\x1f", *[casefold(collapse(F.col(c))) for c in ("title", "company", "location")])
    return F.when(F.trim("id") != "", F.concat(F.lit("id:"), casefold(F.trim("id")))).when(url != "", F.concat(F.lit("url:"), address)).otherwise(F.concat(F.lit("content:"), content))


def merged_metadata(old: Column, new: Column) -> Column:
    """The new values over the old ones, but for blanks."""
    given = F.map_filter(new, lambda k, v: v.isNotNull() & (v != ""))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(given), k))
    return F.map_concat(kept, given)


def placeholder_url(job_id: Column) -> Column:
    """Stands for a posting without an address of its own."""
    return F.concat(F.lit(BOARD + "#job-"), job_id)


def is_placeholder(url: Column) -> Column:
    return F.coalesce(url.startswith(BOARD + "#job-"), F.lit(False))


def found_by(needle: str, *fields: str) -> Column:
    """Whether a result shows the needle in one of its fields, case aside; a blank needle shows all."""
    return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(needle.strip().lower()))


def present(**components: Column) -> Column:
    """A map of the components that exist."""
    pairs = [x for k, v in components.items() for x in (F.lit(k), v.cast("double"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
