"""SimHash near-deduplication: an inverted index over byte positions with count filtering.

Fingerprints of 8 bytes that differ in at most 3 bits share at least 5 positional bytes. The index lists, for sets of byte
positions, the distinct fingerprints with the same bytes there. The 14 sets of 4 positions (complements of the blocks of the
Steiner system S(3,4,8)) are such that any 3 differing positions lie outside one of them, so each pair to be found meets in a
list. A list of more than `LIST_MOST` fingerprints is cut finer: its free bits are parted into four groups, of which a pair with
3 differing bits shares one, and each fingerprint is listed under each group; this goes on until no list is long (with 7 free
bits none can be). In each list the shared positional bytes of the pairs are tallied, pairs under the guaranteed minimum are
left out, and the others are verified by their differing bits. Only links leave a list, never its pairs.

Components: each task first reduces its links to a spanning forest, then the lowest label spreads along links with pointer
jumping, a staged table each round.

Defined cases: null and empty texts have the fingerprint zero and are linked like any other; repeated rows are answered each; a
null id never is a component's id unless all its ids are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import as_bytes
from .common import attach_groups, lookup, row_salt, stage, table

SHINGLE = 3
BITS_APART = 3
LIST_MOST = 128
#: Lists with fewer free bits are not cut: they have at most 2^7 fingerprints.
FREE_LEAST = 8
#: The 14 blocks of the Steiner system S(3,4,8) on positions 0-7; every 3 positions lie in exactly one block.
BLOCKS = ((0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7), (0, 2, 4, 6), (0, 2, 5, 7), (0, 3, 4, 7), (0, 3, 5, 6), (4, 5, 6, 7), (2, 3, 6, 7), (2, 3, 4, 5), (1, 3, 5, 7), (1, 3, 4, 6), (1, 2, 5, 6), (1, 2, 4, 7))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
PIECE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = text.lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    first, last = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    tally, n = np.zeros(64, np.int64), len(first)
    for i in range(0, n, PIECE):
        h = np.fromiter((digest(data[s:e], 42) for s, e in zip(first[i : i + PIECE], last[i : i + PIECE], strict=True)), np.uint64)
        own = h.astype(">u8").view(np.uint8).reshape(-1, 8)
        if len(own) < 256:
            tally += np.unpackbits(own, axis=1).sum(0, dtype=np.int64)
        else:
            for place in range(8):
                tally[8 * place : 8 * place + 8] += np.bincount(own[:, place], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * tally > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def compute(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_signed(fingerprint(t, shingle)) for t in as_bytes(batch.column(1))], pa.int64())], names=["_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col)).mapInArrow(compute, f"_id {kind}, fp long")


def _mask(positions) -> int:
    return sum(0xFF << (56 - 8 * p) for p in positions)


ROOTS = tuple(_mask(set(range(8)) - set(b)) for b in BLOCKS)


@lru_cache(maxsize=1 << 16)
def finer(mask: int) -> tuple[int, ...]:
    """The masks that add one of four groups of a mask's free bits (at least 4); the first cut adds a whole byte each."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    n = len(free)
    return tuple(mask | sum(free[i * n // 4 : (i + 1) * n // 4]) for i in range(4))


def _listed(batches):
    """(fp, mask) rows -> (mask, key, fp) rows under each finer mask; mask 0 stands for the roots."""
    for batch in batches:
        fp = np.asarray(batch.column(0).to_pylist(), np.int64)
        under = np.asarray(batch.column(1).to_pylist(), np.int64)
        masks, fps = [], []
        for m in np.unique(under):
            own = fp[under == m]
            for child in finer(int(m) & (1 << 64) - 1) if m else ROOTS:
                masks.append(np.full(len(own), _signed(child), np.int64))
                fps.append(own)
        if masks:
            masks, fps = np.concatenate(masks), np.concatenate(fps)
            yield pa.RecordBatch.from_pydict({"mask": masks, "key": fps & masks, "fp": fps})


def list_links(fps: np.ndarray, apart: int = BITS_APART) -> tuple[np.ndarray, np.ndarray]:
    """Of one list: the pairs that share the minimum of positional bytes and differ in at most `apart` bits."""
    a, b = np.triu_indices(len(fps), 1)
    x = (fps[a] ^ fps[b]).view(np.uint64)
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    good = shared >= 8 - apart
    good[good] = np.bitwise_count(x[good]) <= apart
    return fps[a[good]], fps[b[good]]


def _verified(batches):
    for batch in batches:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for fps in batch.column(0).to_pylist():
            own = list_links(np.asarray(fps, np.int64))
            a.append(own[0])
            b.append(own[1])
        yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})


def links(distinct: DataFrame, most: int = LIST_MOST) -> DataFrame:
    """(a, b): all pairs of distinct fingerprints (column fp) within 3 bits, some of them twice."""
    found, todo = [], distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        listed = todo.mapInArrow(_listed, "mask long, key long, fp long").distinct()
        sizes = stage(listed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"), "lists")
        own = stage(lookup(listed, sizes, ["mask", "key"]), "listed")
        done = (F.col("n") <= most) | (F.bit_count("mask") > 64 - FREE_LEAST)
        short = own.filter(done).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(stage(short.select("fps").mapInArrow(_verified, "a long, b long"), "links"))
        todo = own.filter(~done).select("fp", "mask").distinct()
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _forest(batches):
    """A spanning forest of a task's links: (a, b) rows from each node to its root."""
    root: dict[int, int] = {}

    def find(x):
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    own = [(x, find(x)) for x in root]
    own = [x for x in own if x[0] != x[1]]
    yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in own], pa.int64()), "b": pa.array([x[1] for x in own], pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes with a link (a, b); label is the lowest node that is reachable."""
    edges = stage(edges.mapInArrow(_forest, "a long, b long"), "forest")
    both = stage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("_heard"))
        heard = stage(labels.join(heard, "node").select("node", F.col("label").alias("_old"), F.least("label", "_heard").alias("label")), "heard")
        jump = heard.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        after = stage(heard.join(jump, "label", "left").select("node", "_old", F.least("label", "_next").alias("label")), "labels")
        if after.filter("label <> _old").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) of every row."""
    rows = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("_id").alias("_least")), "distinct")
    labels = components(links(distinct))
    least = labels.join(distinct, F.col("node") == F.col("fp")).groupBy("label").agg(F.min("_least").alias("_component"))
    named = stage(labels.join(least, "label").select(F.col("node").alias("fp"), "_component"), "components")
    own = attach_groups(rows, "fp", row_salt(F.col("_id")), [F.min("_id").alias("_part")], [F.min("_part").alias("_least")])
    out = lookup(own, named, ["fp"], "left")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("_component", "_least").alias("component_id"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
