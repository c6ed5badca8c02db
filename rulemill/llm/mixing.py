"""Mixing sources to target weights (native): a low-discrepancy schedule over equal blocks of words.

Each source's documents lie in a shuffled order (by a hash of the id) on a word axis that repeats up to three times; the axis
is cut into blocks of equal size. Slot k of the schedule is the golden-ratio point frac((k + 1/2) / phi); the cumulative target
shares map it to a source, its rank among that source's slots is the block that it takes, and schedule and blocks are joined by
(source, block). The schedule gives the order only: each source is taken up to its target, rounded up to a whole word, so its last
block may be partial, and a block without a point (rare sources at a coarse block size) gets its even place among the slots, which
another block may have too. Prefix sums and ranks are made in two steps (inside a bucket, then over buckets), so that a hot source is
spread over many tasks.

Defined cases: null text has size 0; a null source is a source, the last; documents of size 0 are taken 0 times; repeated rows
count each; with no words at all all targets are 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, lookup, stage, table

#: 1 / phi.
GOLDEN = 0.6180339887498949
EPOCHS = 3
SLOTS = 1 << 20
CHUNK = 1 << 16
BUCKETS = 1024
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """(_src, source_size) -> with weight, target and share bounds (low, high). One row a source: a table of the mix's own size.
    Targets share all words by weight; those above `epochs` times their source stop there and the excess is dealt to the others,
    until none is above: with the sources ordered by cap / weight, those that stop are a prefix."""
    order = W.orderBy(F.col("_src").asc_nulls_last())
    every = W.partitionBy(F.lit(1))
    cycle = F.array(*[F.lit(w) for w in weights])
    s = sources.withColumn("_i", F.row_number().over(order)).withColumn("_w", F.element_at(cycle, (F.pmod(F.col("_i") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    s = s.withColumn("_cap", (F.col("source_size") * epochs).cast("double")).withColumn("_all", F.sum("source_size").over(every).cast("double")).withColumn("_wall", F.sum("_w").over(every))
    before = W.orderBy(F.col("_cap") / F.col("_w"), "_i").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_cb", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_wb", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_stop", (F.col("_all") - F.col("_cb")) / (F.col("_wall") - F.col("_wb")) * F.col("_w") > F.col("_cap"))
    free = F.sum(F.when(~F.col("_stop"), F.col("_w"))).over(every)
    left = F.col("_all") - F.coalesce(F.sum(F.when(F.col("_stop"), F.col("_cap"))).over(every), F.lit(0.0))
    s = s.withColumn("target", F.when(F.col("_stop"), F.col("_cap")).otherwise(F.least(F.col("_cap"), left / free * F.col("_w"))))
    run = F.sum("target").over(W.orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("target").over(every)
    s = s.withColumn("_high", F.when(total > 0, run / total).otherwise(0.0)).withColumn("_low", F.when(total > 0, (run - F.col("target")) / total).otherwise(0.0))
    last = F.col("_i") == F.max(F.when(F.col("target") > 0, F.col("_i"))).over(every)
    return s.select("_src", "source_size", F.col("_w").alias("weight"), "target", F.col("_all").cast("long").alias("_total"), "_low", F.when(last, 1.0).otherwise(F.col("_high")).alias("_high"))


def schedule(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(_src, block): which source each slot takes, and which of its blocks."""
    spark = targets.sparkSession
    wide = targets.filter("_high > _low")
    unit = F.greatest(F.lit(1), F.ceil(F.col("_total") / slots)).cast("long")
    cells = wide.select("_src", "_low", "_high", F.ceil(F.col("_total") / unit).alias("_slots"), F.explode(F.sequence(F.floor(F.col("_low") * CELLS).cast("int"), F.least(F.floor(F.col("_high") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("_cell"))
    points = spark.range(slots).select("id", (F.col("id") / CHUNK).cast("long").alias("_chunk"), F.expr(f"(id + 0.5D) * {GOLDEN!r}D % 1.0D").alias("_u"))
    points = points.withColumn("_cell", F.floor(F.col("_u") * CELLS).cast("int"))
    taken = points.join(cells, "_cell").filter("_u >= _low and _u < _high and id < _slots").select("id", "_chunk", "_src")
    local = taken.withColumn("_r", F.row_number().over(W.partitionBy("_chunk", "_src").orderBy("id")))
    counts = taken.groupBy("_chunk", "_src").agg(F.count("*").alias("_n"))
    starts = counts.select("_chunk", "_src", F.coalesce(F.sum("_n").over(W.partitionBy("_src").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(starts, ["_chunk", "_src"]).select("_src", (F.col("_before") + F.col("_r") - 1).cast("long").alias("block"), F.col("id").alias("slot"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, slots: int = SLOTS, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, targets, pieces): the sized rows, the sources' targets, and which words of which row each slot takes."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit(None).cast("string"))
    rows = docs.select(F.col(id_col).alias("_id"), key.alias("_src"), word_count(F.col(text_col)).alias("size"))
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "sized").withColumn("_none", F.col("_src").isNull()).withColumn("_key", F.coalesce("_src", F.lit("n")))
    sums = stage(rows.groupBy("_src").agg(F.sum("size").alias("source_size")), "sources")
    targets = stage(source_targets(sums, epochs=epochs).withColumn("_key", F.coalesce("_src", F.lit("n"))), "targets")
    rows = rows.drop("_src", "_none")
    order = F.xxhash64(F.lit(seed), F.col("_id"))
    spread = rows.filter("size > 0").withColumn("_h", order).withColumn("_b", F.pmod(F.shiftright("_h", 40), F.lit(BUCKETS)).cast("int"))
    sizes = spread.groupBy("_key", "_b").agg(F.sum("size").alias("_bsum"))
    offsets = sizes.select("_key", "_b", F.coalesce(F.sum("_bsum").over(W.partitionBy("_key").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inside = spread.withColumn("_in", F.coalesce(F.sum("size").over(W.partitionBy("_key", "_b").orderBy("_h", "_id", "size", "_row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = inside.join(offsets, ["_key", "_b"]).select("_key", "_row", "_id", "size", (F.col("_off") + F.col("_in")).alias("_start"))
    placed = lookup(placed, targets.select("_key", "source_size", "target", "_total"), ["_key"])
    unit = F.greatest(F.lit(1), F.ceil(F.col("_total") / slots)).cast("long")
    placed = placed.withColumn("_unit", unit).withColumn("_end", F.ceil(F.col("target") - 1e-6)).withColumn("_p", F.explode(F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: e.cast("long") * F.col("source_size") + F.col("_start"))))
    placed = placed.filter(F.col("_p") < F.col("_end")).withColumn("_stop", F.least(F.col("_p") + F.col("size"), "_end"))
    pieces = placed.select("_key", "_row", "_id", "_p", "_stop", "_end", "_unit", "_total", F.explode(F.sequence(F.floor(F.col("_p") / F.col("_unit")), F.floor((F.col("_stop") - 1) / F.col("_unit")))).alias("block"))
    words = F.least("_stop", (F.col("block") + 1) * F.col("_unit")) - F.greatest(F.col("_p"), F.col("block") * F.col("_unit"))
    even = F.floor((F.col("block") + 0.5) / F.ceil(F.col("_end") / F.col("_unit")) * F.ceil(F.col("_total") / F.col("_unit")))
    plan = schedule(targets.withColumn("_src", F.col("_key")), slots).withColumnRenamed("_src", "_key")
    pieces = pieces.withColumn("words", words).withColumn("_even", even).join(plan, ["_key", "block"], "left")
    return rows, targets, pieces.select("_key", "_row", "_id", F.coalesce("slot", "_even").alias("slot"), "block", "words")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, size, source_size, target, taken) of every row."""
    rows, targets, pieces = mixture(docs, id_col, text_col, source_col, **options)
    taken = pieces.groupBy("_row").agg(F.sum("words").alias("_taken"))
    out = rows.join(taken, "_row", "left")
    out = lookup(out, targets.select("_key", "source_size", "target"), ["_key"])
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
