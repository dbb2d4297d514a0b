"""Fields and links of raw pages, by JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label(text: Column) -> Column:
    """A label's letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def page_fields(pages: DataFrame) -> DataFrame:
    """``page_id, title, links`` of each page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", F.trim(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)).alias("title"), F.size(F.regexp_extract_all(html, F.lit(r"<a\s[^>]*href="), F.lit(0))).cast("long").alias("links"))


def allowed_url(url: Column, scheme: str, host: str, path: str, keys: list[str]) -> Column:
    """The address without its fragment if scheme, host, path and query keys are allowed, else null."""
    bare = F.regexp_replace(url, "#.*$", "")
    pair = f"(?:{'|'.join(keys)})=[^&=]*"
    return F.when(bare.rlike(rf"^{scheme}://{host}{path}(?:\?{pair}(?:&{pair})*)?$"), bare)


def labelled_values(pages: DataFrame, key: str, html: Column) -> DataFrame:
    """``key, label, value`` of two-cell table rows and of terms with definitions; the first value of a label stays."""
    rows = F.concat(*[F.arrays_zip(F.regexp_extract_all(html, F.lit(p), F.lit(1)).alias("label"), F.regexp_extract_all(html, F.lit(p), F.lit(2)).alias("value")) for p in (r"(?is)<tr[^>]*>\s*<t[hd][^>]*>(.*?)</t[hd]>\s*<td[^>]*>(.*?)</td>\s*</tr>", r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>")])
    found = pages.select(key, F.posexplode(rows).alias("pos", "r"))
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    return found.groupBy(key, label(bare(F.col("r.label"))).alias("label")).agg(F.min_by(bare(F.col("r.value")), "pos").alias("value"))
