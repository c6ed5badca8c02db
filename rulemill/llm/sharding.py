"""Sharding by proportional stratified interleaving: every shard gets the same number of rows and the mixture of the whole.

Each source's rows are ranked in a seeded shuffle; a row's fractional rank is (rank - 1 + u) / rows of its source, with a start u in
0..1 drawn for each source, so small sources don't all meet in the middle. All rows, sorted by it, are cut into shards of equal count
(at most one apart), so a shard holds its part of each source within one or two rows. Both ranks are made in two steps: inside
buckets of hashes (then slices of the fractional rank), whose number follows the rows, and over the buckets' counts; a hot source is
spread over all tasks. Only numbers and keys are shuffled; texts stay where they are until `write_shards`.

Defined cases: a null text has no bytes (size 1, checksum 0); a null source is a source; a null id is shuffled by its text's
checksum; repeated rows each get a place of their own; fewer rows than shards leave shards empty; an empty table gives no rows; `shard`
and `slot` are named _shard or _slot where the table has such columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, lookup, numbered, stage, table

SHARDS, SEED = 8, 11
#: A bucket or slice has about so many rows, fewer where that would leave tasks without work.
BUCKET_ROWS = 1 << 17
PER_TASK = 8
HEX = 15


def hashed(*parts: Column) -> Column:
    """60 bits of MD5 over the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, HEX), 16, 10).cast("long")


def unit(hash_: Column) -> Column:
    return hash_.cast("double") / float(1 << 4 * HEX)


def ranked(rows: DataFrame, group: list[str], bucket: Column, order: list) -> DataFrame:
    """Adds _rank (from 1) inside each group by `order`; `bucket` never falls along it. Ranks inside buckets plus the counts of the
    buckets before."""
    own = rows.withColumn("_b", bucket)
    inside = own.withColumn("_in", F.row_number().over(W.partitionBy(*group, "_b").orderBy(*order)))
    counts = own.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = stage(counts.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "starts")
    return lookup(inside, starts, [*group, "_b"]).withColumn("_rank", F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")


def places(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, row: str | None = None) -> DataFrame:
    """(_row, _id, size, crc, shard, slot) of every row, without its text; `row` names the column that numbers the rows."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("_id"), key.alias("_src"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"), number.alias("_row"))
    rows = stage(rows.withColumn("_h", hashed(F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("crc"))), "sized")
    sources = stage(rows.groupBy("_src").agg(F.count("*").alias("_of")), "sources")
    total = sources.agg(F.sum("_of")).first()[0] or 0
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket_rows = max(1, min(BUCKET_ROWS, total // (PER_TASK * tasks)))
    rows = lookup(rows, sources, ["_src"])
    spread = F.floor(unit(F.col("_h")) * F.ceil(F.col("_of") / bucket_rows))
    rows = ranked(rows, ["_src"], spread, ["_h", F.col("_id").asc_nulls_first(), "size", "_row"])
    rows = rows.withColumn("_at", (F.col("_rank") - 1 + unit(hashed(F.lit(seed), F.col("_src")))) / F.col("_of"))
    slices = -(-total // bucket_rows)
    rows = rows.withColumn("_all", F.lit(0)).withColumnRenamed("_rank", "_own")
    rows = ranked(rows, ["_all"], F.floor(F.col("_at") * slices), ["_at", "_src", "_own"])
    rows = rows.withColumn("shard", F.expr(f"cast(cast(_rank - 1 as bigint) * {shards} div {max(total, 1)} as int)"))
    slot = F.expr(f"cast(_rank - 1 as bigint) - (cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return rows.select("_row", "_id", "size", "crc", "shard", slot.alias("slot"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, **columns) -> DataFrame:
    """`docs` with each row's shard and its slot in it."""
    row, shard, slot = (free_name(docs, x) for x in ("_row", "shard", "slot"))
    rows = numbered(docs, row)
    placed = stage(places(rows, shards, row=row, **columns).select(F.col("_row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot)), "placed")
    return rows.join(placed, row).drop(row)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **columns) -> None:
    """One folder shard=N a shard, its rows in the order of their slots, from file to file."""
    out = shard_rows(docs, shards, **columns)
    shard, slot = out.columns[-2:]
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = places(table(spark, sf_dir, "documents"))
    return rows.select(F.col("_id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _md5(*parts: str) -> str:
    return f"cast('0x' || substr(md5({' || \':\' || '.join(parts)}), 1, {HEX}) as bigint)"


OP12_SQL = f"""
with d as (select doc_id, coalesce('s' || source, 'n') as src, encode(coalesce(text, '')) as body from documents),
t as (select doc_id, src, octet_length(body) + 1 as size,
  xor(4294967295, list_reduce(flatten(list_transform(regexp_extract_all(hex(body), '..'), lambda h: [cast('0x' || h as bigint), 0, 0, 0, 0, 0, 0, 0])),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295)) as crc from d),
h as (select *, {_md5(f"'{SEED}'", "coalesce(cast(doc_id as varchar), '')", "cast(crc as varchar)")} as h from t),
r as (select *, row_number() over (partition by src order by h, doc_id nulls first, size) as own, count(*) over (partition by src) as n from h),
f as (select *, (own - 1 + cast({_md5(f"'{SEED}'", 'src')} as double) / {1 << 4 * HEX}.0) / n as frac from r),
g as (select *, row_number() over (order by frac, src, own) - 1 as place, count(*) over () as total from f),
s as (select *, place * {SHARDS} // total as shard from g)
select doc_id, cast(size as bigint) as size, crc as text_crc32, 'rows' as law, cast(shard as integer) as shard,
  place - (shard * total + {SHARDS - 1}) // {SHARDS} as slot, cast(null as integer) as grown_shard from s
"""
