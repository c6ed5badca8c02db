"""Hard-negative mining by distributed radix selection over integer scores.

Vectors are scaled and floored to integers, so scores (inner products) are exact integers. A search is an anchor with a window of
scores, [low, high], and either the rows of its own label or those of others; it wants the first k rows by score, then id. Selection goes
digit by digit: blocks of rows meet blocks of searches, each task counts the scores in a search's open interval by their top digit
(10 bits), Spark adds the counts, and the bucket that holds the kth row is the next, narrower interval. A search is done once its
bucket holds few rows or one score; then only rows up to that bucket are gathered, at most k from a block, and ranked. First each
anchor's positives are selected so, then the negatives of each anchor and positive, whose window follows from the positive's score.

Anchors meet all rows in blocks of bounded size, by an equi-join on block numbers; nothing is collected or broadcast whole, and a group
of equal vectors or one hot label changes neither the size of a block nor what a task returns.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; rows are told apart by number,
so repeated rows and ids are rows of their own, and a null id comes last of equal scores (a null id is no anchor); vectors of different lengths are
compared as if zeros followed; an anchor without positives, or a window without rows, gives no row, as does a positive with a
negative score (its window is empty); an empty table gives no rows; scores beyond 2^61 count as that; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage, table

ROW_BLOCK = SEARCH_BLOCK = 1 << 14
LEAST_BLOCK, PER_TASK = 256, 4
DIGIT = 10
TILE = 128
#: Beyond this sum of squares float64 holds no exact sums; such tables are scored with Python's integers.
EXACT, MOST = 1 << 53, 1 << 61


def scaled_rows(embeddings: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """(_row, id, label, anchor, v) of the rows that take part; staged."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    rows = embeddings.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), x.alias("_x"), v.alias("v"))
    return stage(rows.filter(F.col("label").isNotNull() & F.col("_x").isNotNull() & F.coalesce(finite, F.lit(False))).drop("_x"), "vectors")


def _matrix(column: pa.ChunkedArray, width: int, kind) -> np.ndarray:
    """Lists of numbers as a matrix of `width` columns, short ones padded by zeros."""
    lists = column.combine_chunks()
    lengths = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if kind is object:
        flat = np.array([int(x) for x in flat], dtype=object)
    out = np.zeros((len(lengths), width), dtype=kind)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _tiles(rows: pa.Table, searches: pa.Table, bound: int):
    """(numbers of searches, numbers of rows, u) of all hits of the searches in their open intervals, a tile at a time; u counts from
    the start of the interval, falling scores first."""
    width = max(int(np.max(np.asarray(t["v"].combine_chunks().value_lengths()), initial=0)) for t in (rows, searches))
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < EXACT else object
    right = _matrix(rows["v"], width, kind).T
    left = _matrix(searches["v"], width, kind)
    label, own = rows["label"].to_numpy(), rows["_row"].to_numpy()
    top = (searches["hi"].to_numpy() - searches["base"].to_numpy())[:, None]
    size, same = searches["width"].to_numpy()[:, None], searches["same"].to_numpy(zero_copy_only=False)[:, None]
    want, self_ = searches["label"].to_numpy()[:, None], searches["_row"].to_numpy()[:, None]
    for at in range(0, len(left), TILE):
        part = slice(at, at + TILE)
        scores = left[part] @ right
        scores = np.clip(scores, -MOST, MOST).astype(np.int64) if kind is object else scores.astype(np.int64)
        u = top[part] - scores
        hit = (u >= 0) & (u < size[part]) & ((label == want[part]) == same[part]) & (own != self_[part])
        s, r = np.nonzero(hit)
        yield at + s, r, u[s, r]


def counted(rows: pa.Table, searches: pa.Table, bound: int) -> pa.Table:
    """(q, digit, n): the histogram of each search's open interval over one block, up to the bucket with its kth row here."""
    q, shift, need = searches["q"].to_numpy(), searches["shift"].to_numpy(), searches["need"].to_numpy()
    out = []
    for s, _, u in _tiles(rows, searches, bound):
        if len(s):
            first = int(s[0]) // TILE * TILE
            many = np.bincount((s - first) * (1 << DIGIT) + (u >> shift[s]), minlength=TILE << DIGIT).reshape(TILE, 1 << DIGIT)
            wanted = np.zeros(TILE, dtype=np.int64)
            wanted[: len(need[first : first + TILE])] = need[first : first + TILE]
            a, digit = np.nonzero((many > 0) & (np.cumsum(many, axis=1) - many < wanted[:, None]))
            out.append((q[first + a], digit, many[a, digit]))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 3
    return pa.table({"q": cols[0].astype(np.int64), "digit": cols[1].astype(np.int64), "n": cols[2].astype(np.int64)})


def gathered(rows: pa.Table, searches: pa.Table, bound: int) -> pa.Table:
    """(q, score, id, _row): the rows of one block up to each search's bound, at most k, the first by score, then id."""
    q, hi, base, k = (searches[c].to_numpy() for c in ("q", "hi", "base", "k"))
    number = rows["_row"].to_numpy()
    ids = rows["id"].to_pandas()
    known, plain = ids.notna().to_numpy(), ids.fillna(0).astype("int64").to_numpy()
    out = []
    for s, r, u in _tiles(rows, searches, bound):
        order = np.lexsort((number[r], plain[r], ~known[r], u, s))
        s, r, u = s[order], r[order], u[order]
        place = np.arange(len(s)) - np.searchsorted(s, s)
        keep = place < k[s]
        s, r, u = s[keep], r[keep], u[keep]
        out.append((q[s], hi[s] - base[s] - u, r))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 3
    return pa.table({"q": cols[0].astype(np.int64), "score": cols[1].astype(np.int64), "id": pa.array(plain[cols[2]], mask=~known[cols[2]]), "_row": number[cols[2]]})


def _met(rows: DataFrame, searches: DataFrame, total: int, asked: int, work, bound: int, schema: str) -> DataFrame:
    """`work` on each block of rows with each block of searches."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = max(-(-total // ROW_BLOCK), min(PER_TASK * tasks, -(-total // LEAST_BLOCK)), 1)
    down = max(-(-asked // SEARCH_BLOCK), 1)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("_row", "id", "label", "v", block("_row", across).alias("_p"), each(down).alias("_s"))
    right = searches.withColumn("_s", block("q", down)).withColumn("_p", each(across))
    return left.groupBy("_p", "_s").cogroup(right.groupBy("_p", "_s")).applyInArrow(lambda a, b: work(a, b, bound), schema)


def _shift(width: Column) -> Column:
    """How far u is shifted so that its top digit has DIGIT bits: the bits of width - 1 beyond it."""
    bits = F.length(F.bin(F.greatest(width - 1, F.lit(0))))
    return F.greatest(bits - DIGIT, F.lit(0)).cast("int")


def select_top(rows: DataFrame, searches: DataFrame, k: int, total: int, bound: int) -> DataFrame:
    """(q, place, score, id, _row): the first k rows of each search (q, _row, label, v, same, lo, hi): its own row never is one."""
    state = searches.select("*", F.lit(k).cast("long").alias("k"), F.lit(k).cast("long").alias("need"), F.lit(0).cast("long").alias("base"), (F.col("hi") - F.col("lo") + 1).alias("width"))
    state = stage(state.withColumn("shift", _shift(F.col("width"))).withColumn("open", F.col("width") > 1), "searches")
    asked = state.count()
    while asked and not state.filter("open").isEmpty():
        hist = _met(rows, state.filter("open"), total, asked, counted, bound, "q long, digit long, n long").groupBy("q", "digit").agg(F.sum("n").alias("n"))
        run = hist.withColumn("_to", F.sum("n").over(W.partitionBy("q").orderBy("digit").rowsBetween(W.unboundedPreceding, 0)))
        found = run.join(state.filter("open").select("q", "need"), "q").filter("_to >= need and _to - n < need").select("q", "digit", "n", (F.col("_to") - F.col("n")).alias("_before"))
        next_ = state.join(found, "q", "left")
        hit, step = F.col("open") & F.col("digit").isNotNull(), F.expr("shiftleft(1L, shift)")
        base = F.when(hit, F.col("base") + F.col("digit") * step).otherwise(F.col("base"))
        width = F.when(hit, F.least(step, F.col("width") - F.col("digit") * step)).otherwise(F.col("width"))
        names = [c for c in state.columns if c not in ("base", "width", "need", "shift", "open")]
        next_ = next_.select(*names, base.alias("base"), width.alias("width"), F.when(hit, F.col("need") - F.col("_before")).otherwise(F.col("need")).alias("need"), (hit & (F.col("n") > 4 * k)).alias("_crowded"))
        state = stage(next_.withColumn("shift", _shift(F.col("width"))).withColumn("open", F.col("_crowded") & (F.col("width") > 1)).drop("_crowded"), "searches")
    upto = state.withColumn("width", F.col("base") + F.col("width")).withColumn("base", F.lit(0).cast("long"))
    rows_ = _met(rows, upto, total, asked, gathered, bound, "q long, score long, id long, _row long")
    order = W.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "_row")
    return rows_.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("q", "place", "score", "id", "_row")


def mine(embeddings: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row that `anchor` holds for and each of its
    first `positives` rows of the same label, the first `negatives` rows of other labels that score from `low` to `high` per cent of
    the positive."""
    rows = scaled_rows(embeddings, id_col, vector_col, F.col("label") if label is None else label, anchor, scale)
    total, bound = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).first()
    bound = int(min(bound or 0, MOST))
    own = rows.filter(F.col("anchor") & F.col("id").isNotNull()).select(F.col("_row").alias("q"), "_row", "id", "label", "v")
    first = own.drop("id").select("*", F.lit(True).alias("same"), F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"))
    near = stage(select_top(rows, first, positives, total, bound).select("q", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Of scores from 0, rounded up and down; by hundreds and the rest, so large scores don't overflow.
    hundreds, rest = "positive_score div 100", "positive_score % 100"
    least, most = F.expr(f"({hundreds}) * {low} + (({rest}) * {low} + 99) div 100"), F.expr(f"({hundreds}) * {high} + ({rest}) * {high} div 100")
    pairs = near.filter("positive_score >= 0").withColumn("lo", least).withColumn("hi", most).filter("lo <= hi").join(own, "q")
    pairs = stage(pairs.select((F.col("q") * positives + F.col("place") - 1).alias("q"), "_row", F.col("id").alias("anchor_id"), "positive_id", "positive_score", "label", "v", F.lit(False).alias("same"), "lo", "hi"), "pairs")
    found = select_top(rows, pairs.drop("anchor_id", "positive_id", "positive_score"), negatives, total, bound)
    out = found.join(pairs.select("q", "anchor_id", "positive_id", "positive_score"), "q")
    return out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


OP13_SQL = """
with e as (select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select * from e where vec_id % 50 = 0),
m as (select a.row as a_row, a.vec_id as anchor_id, e.row, e.vec_id as id, a.label = e.label as same, cast(list_dot_product(a.v, e.v) as bigint) as score
  from a join e on a.row <> e.row),
p as (select * from (select *, row_number() over (partition by a_row order by score desc, id nulls last, row) as place from m where same) where place <= 5),
n as (select p.anchor_id, p.id as positive_id, m.id as negative_id, p.score as positive_score, m.score as negative_score,
  row_number() over (partition by p.a_row, p.place order by m.score desc, m.id nulls last, m.row) as rank
  from p join m on p.a_row = m.a_row and not m.same and 50 * p.score <= 100 * m.score and 100 * m.score <= 95 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
