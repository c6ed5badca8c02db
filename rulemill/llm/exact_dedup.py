"""Exact deduplication (native): group by a 128-bit content hash, keep one stable id, compare bytes inside the groups.

The hash is MD5 of the normalised text. Groups of one row are settled by the count alone; the texts of larger groups are
grouped by (hash, text), a comparison of whole byte strings that Spark combines before the shuffle. Hashes with more than one
text (collisions) are dealt again by hash and text.

Defined cases: null text is the empty text; a null id never wins against another id and is null as keep_id only where all ids
of the group are null; repeated rows with the kept id are all kept; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, attach_groups, free_name, lookup, numbered, row_salt, stage, table, without


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=normalised, hash_of=content_hash) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row; keep: "smallest" or "largest" id of equal texts."""
    best = F.min if keep == "smallest" else F.max
    rows = docs.select(F.col(id_col).alias("_id"), normalise(F.col(text_col)).alias("_text"))
    digests = stage(rows.select("_id", hash_of(F.col("_text")).alias("_hash"), F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_sha")), "digests")
    many = stage(digests.groupBy("_hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("_hash"), "many")
    suspects = lookup(rows.select("_id", "_text", hash_of(F.col("_text")).alias("_hash")), many, ["_hash"])
    variants = suspects.groupBy("_hash", "_text").agg(F.count("*").alias("_copies"))
    collided = stage(variants.groupBy("_hash").agg(F.count("*").alias("_texts")).filter("_texts > 1").select("_hash"), "collided")
    grouped = attach_groups(digests, "_hash", row_salt(F.col("_id")), [best("_id").alias("_best"), F.count("*").alias("_rows")], [best("_best").alias("keep_id"), F.sum("_rows").alias("group_size")])
    out = grouped.select("_id", "keep_id", "group_size", "_sha", "_hash")
    if not collided.isEmpty():
        again = lookup(suspects, collided, ["_hash"])
        exact = again.withColumn("_pair", F.struct("_hash", "_text"))
        exact = attach_groups(exact, "_pair", row_salt(F.col("_id")), [best("_id").alias("_best"), F.count("*").alias("_rows")], [best("_best").alias("keep_id"), F.sum("_rows").alias("group_size")])
        fixed = exact.select("_id", "keep_id", "group_size", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_sha"), "_hash")
        rest = lookup(out, collided, ["_hash"], "left_anti")
        out = rest.unionByName(fixed)
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of `docs`, one for each distinct text; all columns stay as they are. Rows are told apart by a staged row number:
    of equal texts the row with the largest (or smallest) id stays, one with a null id only if all ids are null, and of rows with
    that id the one with the lowest number."""
    name = free_name(docs, "_row")
    rows = numbered(docs, name)
    null, row = F.col(id_col).isNull(), F.col(name)
    pick = F.struct((~null).alias("some"), F.col(id_col).alias("id"), (-row).alias("row")) if keep == "largest" else F.struct(null.alias("none"), F.col(id_col).alias("id"), row.alias("row"))
    named = rows.select(pick.alias("_pick"), F.col(text_col).alias("_body"))
    gone = stage(exact_groups(named, "_pick", "_body", keep).filter("not kept").select(F.abs("_pick.row").alias("_row")), "gone")
    return without(rows, name, gone)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


OP8_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents),
g as (select body, max(doc_id) as keep_id, count(*) as group_size from t group by body)
select t.doc_id, g.keep_id, g.group_size, t.doc_id is not distinct from g.keep_id as kept, sha256(t.body) as text_sha256
from t join g using (body)
"""
