"""Nested metadata as VARIANT: every node of it as a row, its strings as rules read them, and all of it as one text.

Keys of an object come in the order of their names, which is how a VARIANT holds them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrank.streaming.upsert import written


def kind_of(value: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING`` or what else a VARIANT is; ``VOID`` for a null."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def variant_nodes(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, path, name, kind, inner, text``: a row for each node of the VARIANT ``column``; a null one has none.

    ``path`` orders the nodes as they are written out, ``name`` is the key in an object, ``inner`` how many nodes lie right
    below, ``text`` what a scalar says. One round a level of nesting, over the containers of the level before only.
    """
    spark = df.sparkSession
    level = df.where(F.col(column).isNotNull()).select(F.col(key), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("name"), F.col(column).alias("value"))
    levels = []
    while True:
        level = written(level.withColumn("kind", kind_of(F.col("value"))))
        below = level.where(F.col("kind").isin("OBJECT", "ARRAY"))
        levels.append(level)
        if below.isEmpty():
            break
        inner = below.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).toDF("i", "k", "v"))
        level = inner.select(key, F.concat("path", F.array("i")).alias("path"), F.col("k").alias("name"), F.col("v").alias("value"))
    text = F.when(F.col("kind") == "STRING", F.variant_get("value", "$", "string")).when(~F.col("kind").isin("OBJECT", "ARRAY", "VOID"), F.to_json("value"))
    empty = F.when(F.col("kind") == "OBJECT", F.to_json("value") == "{}").when(F.col("kind") == "ARRAY", F.to_json("value") == "[]").otherwise(True)
    return reduce(DataFrame.unionByName, [n.select(key, "path", "name", "kind", empty.alias("ends"), text.alias("text")) for n in levels])


def nested_texts(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, leaves, flat``: the strings in order, those of an object behind their key; and all of it as one text.

    In ``flat`` a key stands before what it holds, numbers and truth values are written as in JSON, nulls and empty containers leave
    nothing but their place.
    """
    nodes = variant_nodes(df, key, column)
    leaf = F.when(F.col("kind") == "STRING", F.concat(F.coalesce(F.concat("name", F.lit(": ")), F.lit("")), F.col("text")))
    label = F.concat("name", F.lit(":"))
    token = F.when(F.col("ends"), F.concat_ws(" ", label, F.coalesce("text", F.lit("")))).otherwise(label)
    rows = nodes.select(key, F.struct("path", leaf.alias("leaf"), token.alias("token")).alias("n")).groupBy(key).agg(F.array_sort(F.collect_list("n")).alias("n"))
    kept = lambda field: F.filter(F.transform("n", lambda x: x[field]), lambda t: t.isNotNull())
    return rows.select(key, kept("leaf").alias("leaves"), F.array_join(kept("token"), " ").alias("flat"))
