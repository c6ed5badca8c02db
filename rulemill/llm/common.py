"""Helpers that the training-data operators share: tables, the shared folder, joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts of most operators cut them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How many rows a side may have to be broadcast; beyond it the join is dealt by salted keys.
BROADCAST_ROWS = 200_000
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests);
    on a cluster an error, as executors could not read it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rulemill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def staging(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is deleted when the application ends."""
    context = spark.sparkContext
    path = f"{shared_dir(spark).rstrip('/')}/staged-{context.applicationId}"
    if path not in _staging:
        _staging.add(path)
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(context._jsc.hadoopConfiguration())
        store.mkdirs(where)
        store.deleteOnExit(where)
    return path


_staging: set[str] = set()


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{staging(spark)}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes a table in the shared folder and reads it again, so lost executors cost a reread only."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `docs` is called so (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """`docs` as a staged table with a row number that stays the same at every reading."""
    return stage(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def without(rows: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """`rows` without those whose number stands in `gone` (a staged table with the one column _row), and without the number."""
    return lookup(rows, gone.withColumnRenamed("_row", row), [row], "left_anti").drop(row)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII (as many characters as bytes) takes the quick built-in."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_salt(*cols: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(F.lit("salt"), *cols), F.lit(salts)).cast("int")


def lookup(rows: DataFrame, unique: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins `rows` with `unique`, a staged table with one row a key. It is broadcast if it has at most `limit` rows; else
    both sides are shuffled by key, in a sort-merge join whose hot partitions adaptive execution splits on the `rows` side."""
    if unique.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(unique), keys, how)
    return rows.join(unique.hint("merge"), keys, how)


def attach_groups(rows: DataFrame, key: str, salt: Column, partial: list[Column], final: list[Column]) -> DataFrame:
    """The aggregates of each row's group, on the row. Rows are counted by (key, salt), then by key; the group's result goes
    back once to each (key, salt) that exists, so no task gets a hot group whole and no group is expanded into pairs."""
    salted = rows.withColumn("_salt", salt)
    parts = salted.groupBy(key, "_salt").agg(*partial)
    whole = parts.groupBy(key).agg(*final, F.collect_list("_salt").alias("_salts"))
    spread = whole.withColumn("_salt", F.explode("_salts")).drop("_salts").withColumnRenamed(key, "_key")
    own = salted.withColumnRenamed("_salt", "_own")
    return own.join(spread, (own[key] == spread["_key"]) & (own["_own"] == spread["_salt"])).drop("_key", "_own", "_salt")


def local_path(uri: str) -> str:
    """file:// folders as plain paths; other stores keep their address."""
    return uri[len("file://") :] if uri.startswith("file://") else uri[len("file:") :] if uri.startswith("file:/") else uri
