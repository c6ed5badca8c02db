"""Sections of a rule corpus from tables, and the sinks of the ingest jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section a document: key, label n/m, heading (a first line of at most 100 characters), path and text."""
    first = F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1)
    heading = F.when((F.length(first) <= 100) & (first != ""), first)
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("section_id"), F.col("source").alias("slug"), F.col("lang").alias("corpus"), F.col("doc_id").cast("string").alias("section_key"),
        F.concat(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("/"), (F.col("doc_id") % 100).cast("string")).alias("citation_label"),
        heading.alias("heading"), F.array_compact(F.array("lang", "source", heading)).alias("path"), F.coalesce("text", F.lit("")).alias("content"),
    )


SECTIONS_SQL = """
s0 as (select doc_id as section_id, source as slug, lang as corpus, cast(doc_id as varchar) as section_key,
  cast(doc_id // 100 as varchar) || '/' || cast(doc_id % 100 as varchar) as citation_label,
  split_part(coalesce(text, ''), chr(10), 1) as line1, coalesce(text, '') as content from documents),
s as (select *, case when length(line1) <= 100 and line1 <> '' then line1 end as heading,
  list_filter([corpus, slug, case when length(line1) <= 100 and line1 <> '' then line1 end], lambda x: x is not null) as path from s0)
"""


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace those of `old` with the same keys."""
    return old.join(new, keys, "left_anti").unionByName(new)


def with_ordinals(df: DataFrame, document: str, *order: str) -> DataFrame:
    """Ordinals 1..n in parse order, for each document."""
    return df.withColumn("ordinal", F.row_number().over(W.partitionBy(document).orderBy(*order)))


def replace_documents(df: DataFrame, path: str, document: str) -> None:
    """Replaces whole documents; others in the table stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(document).parquet(path)


def latest_builds(events: DataFrame) -> DataFrame:
    """The last state of each build, from its append-only events (build_id, at, status, notes)."""
    return events.groupBy("build_id").agg(F.min("at").alias("started_at"), F.max_by("status", "at").alias("status"), F.max_by("notes", "at").alias("notes"))


def chunk_table(chunks: DataFrame, path: str) -> None:
    """All chunks anew: the table is replaced as a whole."""
    chunks.write.mode("overwrite").parquet(path)


def merged_metadata(old: str, new: str):
    """Two JSON objects of text values as one; values of the new one win."""
    kind = "map<string,string>"
    every = F.map_concat(F.map_filter(F.from_json(old, kind), lambda k, v: ~F.map_contains_key(F.from_json(new, kind), k)), F.from_json(new, kind))
    return F.when(F.col(old).isNull(), F.col(new)).when(F.col(new).isNull(), F.col(old)).otherwise(F.to_json(every))


def joined(parts: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Sections or chunks with the columns of their document; those without one are left out."""
    names = [c for c in documents.columns if c not in parts.columns or c == key]
    return parts.join(documents.select(*names), key)


def catalog(spark: SparkSession) -> DataFrame:
    """(table_name, kind) of the tables and views that the session knows."""
    return spark.createDataFrame([(t.name, t.tableType) for t in spark.catalog.listTables()], "table_name string, kind string").orderBy("table_name")


def probe(spark: SparkSession) -> DataFrame:
    """One row: whether the engine answers, when, which database and version."""
    return spark.sql("select true as ok, current_timestamp() as at, current_database() as database, version() as version")
