"""Corpus reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_document(documents: DataFrame, parts: DataFrame, key: str, counted: str) -> DataFrame:
    """Parts of each document; documents without any stay with 0."""
    return documents.join(parts.groupBy(key).agg(F.count(counted).alias("parts")), key, "left").select(key, F.coalesce("parts", F.lit(0)).alias("parts"))


def heading_histogram(sections: DataFrame) -> DataFrame:
    return sections.groupBy("heading").agg(F.count("*").alias("sections")).orderBy(F.desc("sections"), F.asc_nulls_first("heading"))


def key_histogram(df: DataFrame, json_col: str, keys: list[str], missing: int = 9999) -> DataFrame:
    """Rows by JSON keys, the first in numeric order where it is a number."""
    cols = [F.get_json_object(json_col, f"$.{k}").alias(k) for k in keys]
    number = F.when(F.col(keys[0]).rlike("^[0-9]+$"), F.expr(f"try_cast({keys[0]} as int)")).otherwise(missing)
    return df.select(*cols).groupBy(*keys).agg(F.count("*").alias("rows")).withColumn("sort_key", F.coalesce(number, F.lit(missing)).cast("long")).orderBy("sort_key", *keys)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def require_unique(df: DataFrame, *keys: str, shown: int = 20) -> DataFrame:
    """The rows as they are; raises with the first duplicate keys if there are any."""
    again = duplicate_keys(df, *keys).limit(shown).collect()
    if again:
        raise ValueError(f"duplicate keys: {[tuple(r)[:-1] for r in again]}")
    return df


def tail(df: DataFrame, order: str, n: int = 20) -> DataFrame:
    """The last n rows, in ascending order."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)
