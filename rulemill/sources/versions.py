"""Tables that are replaced document by document, all or nothing, and the log of the jobs that do it.

A store is a folder with one folder a table. A write adds a batch of rows beside the older ones (`table/batch=...`), then a list of
live (document, batch) pairs, and last a pointer file that names the list; readers follow the last pointer. So readers see the old rows until
the pointer is there, a job that fails leaves them as they were, and a replaced document costs its own rows only.
"""

from __future__ import annotations

import json
import traceback
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIVE, POINTERS = "_live", "_pointers"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def current(spark: SparkSession, path: str) -> dict | None:
    """What the last pointer says: version, the live list, the batches in it; None before the first write. A pointer without text is
    one whose writer died, and is passed over."""
    fs, where = _fs(spark, f"{path}/{POINTERS}")
    if not fs.exists(where):
        return None
    for name in sorted((s.getPath().getName() for s in fs.listStatus(where)), reverse=True):
        stream = fs.open(_fs(spark, f"{path}/{POINTERS}/{name}")[1])
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        if text.endswith("\n"):
            return json.loads(text)
    return None


def _point(spark: SparkSession, path: str, state: dict) -> None:
    """Writes the pointer of a version; an error if another writer has been first."""
    fs, where = _fs(spark, f"{path}/{POINTERS}/{state['version']:012d}")
    stream = fs.create(where, False)
    stream.write(bytearray((json.dumps(state) + "\n").encode()))
    stream.close()


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], document: str = "document", whole: bool = False, options: dict | None = None) -> int:
    """Replaces the documents that occur in any of `tables` in all of them, or with `whole` all documents. Every table has the column
    `document`, and is written as it is dealt out and sorted. Returns the version."""
    old, batch = current(spark, path), uuid.uuid4().hex
    for name, df in tables.items():
        df.write.options(**(options or {})).parquet(f"{path}/{name}/batch={batch}")
    written = {name: spark.read.schema(df.schema).parquet(f"{path}/{name}/batch={batch}") for name, df in tables.items()}
    new = reduce(DataFrame.union, [df.select(F.col(document).cast("string").alias("document")).distinct() for df in written.values()]).distinct().withColumn("batch", F.lit(batch))
    if old and not whole:
        kept = spark.read.parquet(f"{path}/{LIVE}/{old['live']}")
        new = kept.join(new.select("document"), kept["document"].eqNullSafe(new["document"]), "left_anti").unionByName(new)
    version, live = (old["version"] + 1 if old else 1), uuid.uuid4().hex
    new.write.parquet(f"{path}/{LIVE}/{live}")
    batches = [r.batch for r in spark.read.parquet(f"{path}/{LIVE}/{live}").select("batch").distinct().collect()]
    _point(spark, path, {"version": version, "live": live, "batches": sorted({*batches, batch}), "document": document})
    return version


def read(spark: SparkSession, path: str, name: str, live: bool = True) -> DataFrame:
    """A table of the store; without `live` with the rows of replaced documents too."""
    state = current(spark, path)
    if state is None:
        raise FileNotFoundError(f"{path} has no version")
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/batch={b}" for b in state["batches"]])
    if live and len(state["batches"]) > 1:
        pairs = spark.read.parquet(f"{path}/{LIVE}/{state['live']}").withColumnRenamed("document", "_d").withColumnRenamed("batch", "_b")
        rows = rows.join(pairs, F.col(state["document"]).cast("string").eqNullSafe(F.col("_d")) & (F.col("batch") == F.col("_b")), "left_semi")
    return rows.drop("batch")


def compact(spark: SparkSession, path: str, names: list[str], order: dict[str, list[str]] | None = None) -> int:
    """All live rows as one batch, sorted by `order`; older batches are not read any more."""
    tables = {name: read(spark, path, name) for name in names}
    tables = {name: df.repartitionByRange(*order[name]).sortWithinPartitions(*order[name]) if order and name in order else df for name, df in tables.items()}
    return publish(spark, path, tables, current(spark, path)["document"], whole=True)


LOG = "build_id string, build_type string, at timestamp, status string, notes string, metadata map<string,string>"


def log_build(spark: SparkSession, log: str, build_id: str, build_type: str, status: str, notes: str | None = None, metadata: dict[str, str] | None = None) -> None:
    row = spark.createDataFrame([(build_id, build_type, status, notes, metadata or {})], "build_id string, build_type string, status string, notes string, metadata map<string,string>")
    row.select("build_id", "build_type", F.current_timestamp().alias("at"), "status", "notes", "metadata").coalesce(1).write.mode("append").parquet(log)


def tracked(spark: SparkSession, log: str, build_type: str, job: Callable[[str], dict], metadata: dict[str, str] | None = None) -> str:
    """Runs job(build_id) between a `running` row and a `completed` one with what it returns as more metadata. Where it raises, the log
    gets a `failed` row with the trace, outside of whatever the job had begun, and the error goes on."""
    build_id = uuid.uuid4().hex
    log_build(spark, log, build_id, build_type, "running", metadata=metadata)
    try:
        more = job(build_id)
    except Exception:
        log_build(spark, log, build_id, build_type, "failed", traceback.format_exc())
        raise
    log_build(spark, log, build_id, build_type, "completed", metadata={k: str(v) for k, v in (more or {}).items()})
    return build_id


def build_states(events: DataFrame) -> DataFrame:
    """(build_id, build_type, status, started_at, completed_at, notes, metadata) of each build from the rows of its log; later values of
    a metadata key win."""
    one = F.array_sort(F.collect_list(F.struct("at", "status", "notes", F.map_entries("metadata").alias("m"))))
    whole = events.groupBy("build_id").agg(F.max("build_type").alias("build_type"), one.alias("_e"))
    last = F.element_at("_e", -1)
    known = F.map_from_entries(F.array_distinct(F.transform(F.flatten(F.transform("_e", lambda e: e["m"])), lambda x: F.struct(x["key"].alias("key"), F.element_at(F.filter(F.flatten(F.transform("_e", lambda e: e["m"])), lambda y: y["key"] == x["key"]), -1)["value"].alias("value")))))
    done = last["status"].isin("completed", "failed")
    return whole.select("build_id", "build_type", last["status"].alias("status"), F.element_at("_e", 1)["at"].alias("started_at"), F.when(done, last["at"]).alias("completed_at"), F.array_max(F.transform("_e", lambda e: e["notes"])).alias("notes"), known.alias("metadata"))


def ingest_sections(spark: SparkSession, path: str, log: str, sections: DataFrame, document: str = "slug", order: tuple[str, ...] = ("section_id",), **metadata: str) -> str:
    """Replaces the documents of `sections`, with ordinals in parse order, as one tracked build."""
    from .corpus import with_ordinals

    def job(build_id: str) -> dict:
        rows = with_ordinals(sections, document, *order).withColumn("build_id", F.lit(build_id))
        publish(spark, path, {"sections": rows}, document)
        return {"insertedSections": read(spark, path, "sections").filter(F.col("build_id") == build_id).count()}

    return tracked(spark, log, "ingest_sections", job, metadata)


def ingest_chunks(spark: SparkSession, path: str, log: str, sections: DataFrame, document: str = "slug", target: int = 1200, most: int = 1800) -> str:
    """Cuts all sections anew; the chunks of every document are replaced at once, as one tracked build."""
    from ..operators.chunking import chunk_sections

    def job(build_id: str) -> dict:
        chunks = chunk_sections(sections, target, most).join(sections.select("section_id", document), "section_id").withColumn("build_id", F.lit(build_id))
        publish(spark, path, {"chunks": chunks}, document, whole=True)
        return {"insertedChunks": read(spark, path, "chunks").count()}

    return tracked(spark, log, "chunk_sections", job, {"strategy": "semantic_lexical_v2", "targetChars": str(target), "maxChars": str(most)})
