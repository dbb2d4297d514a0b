"""Sinks and sources of results: CSV for spreadsheets, JSON lines in and out, lookups of the board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrank.functions.text import csv_guard

# The columns of the export and the most rows that an import takes.
CSV_COLUMNS = "rank score id title company location deadline url eligibility must_have_coverage must_have_count evidence_coverage retrieval_score matched_skills missing_skills reasons warnings score_breakdown ai_status criteria pairwise_reviews".split()
MAX_IMPORT = 10_000
POSTING = "id string, title string, company string, location string, description string, requirements string, deadline string, url string, status string, is_open boolean, metadata map<string,string>"


def cell(df: DataFrame, name: str) -> Column:
    """A column as the text of a cell: lists of texts behind bars, other nested values as JSON, nulls empty, formulas guarded."""
    if name not in df.columns:
        return F.lit("")
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        text = F.array_join(name, " | ")
    elif isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        text = F.to_json(name)
    else:
        text = F.col(name).cast("string")
    return csv_guard(F.coalesce(text, F.lit("")))


def csv_cells(df: DataFrame) -> DataFrame:
    return df.select(*[cell(df, c).alias(c) for c in CSV_COLUMNS])


def write_csv(df: DataFrame, path: str) -> None:
    """The export's columns with a header and a byte order mark, one file a partition."""
    cells = csv_cells(df)
    first, *rest = CSV_COLUMNS
    cells.select(F.col(first).alias("﻿" + first), *rest).write.option("header", True).option("quoteAll", False).option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(", ".join(f"{c} string" for c in CSV_COLUMNS)).csv(path)


def stated(kind: str, text: Column, defaults: dict[str, object]) -> Column:
    """A JSON text as a struct in which null means the default; null where the text is none."""
    got = F.from_json(text, kind, {"mode": "PERMISSIVE"})
    fields = T._parse_datatype_string(kind).fields
    return F.when(F.try_parse_json(text).isNotNull(), F.struct(*[F.coalesce(got[f.name], F.lit(defaults[f.name]).cast(f.dataType)).alias(f.name) if f.name in defaults else got[f.name].alias(f.name) for f in fields]))


def imported(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lines(value)`` of JSON postings as rows that replace the board, and the lines that can't be taken (no JSON, no title).

    More than MAX_IMPORT lines are refused as a whole; nothing is cut.
    """
    if lines.limit(MAX_IMPORT + 1).count() > MAX_IMPORT:
        raise ValueError(f"an import holds at most {MAX_IMPORT} postings")
    texts = {f.name: "" for f in T._parse_datatype_string(POSTING).fields if isinstance(f.dataType, T.StringType)}
    df = lines.withColumn("posting", stated(POSTING, F.col("value"), texts))
    good = F.coalesce(F.length("posting.title") > 0, F.lit(False))
    return df.where(good).select("posting.*"), df.where(~good).select("value")


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def coerced(text: Column, kind: str, default: object) -> Column:
    """A wire value as a kind, or the default where it isn't one."""
    return F.coalesce(text.try_cast(kind), F.lit(default).cast(kind))
