"""What the two substring operators share: counting hashes over the corpus, a bounded filter of the repeated ones, and the
gathering of each document's repeated stretches.

A filter is a bit table of at most `FILTER_BITS` bits, whatever the corpus' size; a bit set by chance only lets a candidate
through to the next level, which counts exactly, so results don't depend on it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import runs
from .common import lookup, stage

FILTER_BITS = 1 << 29
PAGE_BITS = 1 << 18
#: Text that is hashed at a time, in bytes; a longer document is a group of its own.
GROUP_BYTES = 1 << 20


def groups_of(texts: list[bytes]):
    """Ranges of neighbouring texts of about GROUP_BYTES."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield start, len(texts)


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart: a 64-bit hash of id and text. Rows equal in both have the same repeats and the same result."""
    return F.xxhash64(F.lit("row"), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def counted(h: np.ndarray) -> pa.RecordBatch:
    """The distinct hashes of a batch with 1, or 2 for more than one: all that counting needs."""
    unique, n = np.unique(h.view(np.int64), return_counts=True)
    return pa.RecordBatch.from_pydict({"h": unique, "n": np.minimum(n, 2).astype(np.int32)})


class Seen:
    """A bit table of hashes."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64(self.bits - 1)).astype(np.int64)
        return self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def repeated_filter(rows: DataFrame) -> Seen:
    """From (h, n) rows: the bit table of the hashes whose counts add up to 2 or more."""
    again = stage(rows.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "repeated")
    bits = min(FILTER_BITS, max(PAGE_BITS, 1 << (32 * again.count()).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(PAGE_BITS, bool)
        flags[pdf["slot"].to_numpy() % PAGE_BITS] = True
        return pd.DataFrame({"page": [int(pdf["page"].iloc[0])], "flags": [np.packbits(flags, bitorder="little").tobytes()]})

    pages = again.select(slot.alias("slot")).distinct().withColumn("page", F.floor(F.col("slot") / PAGE_BITS)).groupBy("page").applyInPandas(page, "page long, flags binary")
    table = np.zeros(bits // 8, np.uint8)
    for r in pages.toLocalIterator():
        table[r["page"] * PAGE_BITS // 8 : (r["page"] + 1) * PAGE_BITS // 8] = np.frombuffer(r["flags"], np.uint8)
    return Seen(bits, table)


#: Rows of places to be counted. (h, g) are two 64-bit hashes of the string; place packs start << 32 | number of starts << 1 |
#: repeated already.
PLACES = "h long, g long, key long, place long"
#: How many hashes a task remembers to have announced.
ANNOUNCED = 1 << 20


#: Two 64-bit hashes of one string.
PAIR = np.dtype([("h", np.int64), ("g", np.int64)])


def distinct_pairs(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pairs, where each is first, the number of each row's pair, how often each occurs), ordered by h, then g."""
    order = np.argsort(h, kind="stable")
    if len(h) > 1 and (np.diff(h[order]) == 0).any():
        order = np.lexsort((g, h))
    x, y = h[order], g[order]
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(x) != 0) | (np.diff(y) != 0)
    at = np.flatnonzero(new)
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    unique = np.empty(len(at), PAIR)
    unique["h"], unique["g"] = x[at], y[at]
    return unique, order[at], inverse, np.diff(np.append(at, len(h)))


def known_pairs(pairs: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of some distinct pairs, ordered by h and g, occur in `known`. Pairs whose h occurs are compared whole."""
    found = np.isin(pairs["h"], known["h"])
    if found.any():
        have = set(known[np.isin(known["h"], pairs["h"][found])].tolist())
        found[found] = [p in have for p in pairs[found].tolist()]
    return found


class Places:
    """The places of one task's strings, combined before the shuffle. A string that the task sees once is a row that waits for others.
    One that it sees again is announced by one row (key 0), once a task, and its places are ready: runs of starts that are
    repeated already. So a string that occurs everywhere is a few rows of each task and never a hot group. Strings are told apart
    by both hashes throughout."""

    def __init__(self):
        self.known = np.zeros(0, PAIR)

    def rows(self, h: np.ndarray, g: np.ndarray, key: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        h, g = h.view(np.int64), g.view(np.int64)
        unique, first, inverse, n = distinct_pairs(h, g)
        told = known_pairs(unique, self.known)
        loud = (n > 1) & ~told
        many = ((n > 1) | told)[inverse]
        single, one = ~many, first[loud]
        self.known = np.concatenate((self.known, unique[loud]))[-ANNOUNCED:]
        zero = np.zeros(len(one), np.int64)
        out = [(h[single], g[single], key[single], start[single] << 32 | 2), (h[one], g[one], zero, zero + 1)]
        if many.any():
            order = np.lexsort((start[many], key[many]))
            k, s = key[many][order], start[many][order]
            cut = np.flatnonzero((np.diff(k) != 0) | (np.diff(s) > 1)) + 1
            a, b = np.concatenate(([0], cut)), np.concatenate((cut, [len(k)])) - 1
            out.append((k[a] ^ (s[a] * 0x9E3779B97F4A7C1 + 1), k[a], k[a], s[a] << 32 | (s[b] - s[a] + 1) << 1 | 1))
        return pa.RecordBatch.from_pydict(dict(zip(("h", "g", "key", "place"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))


def repeated_places(rows: DataFrame) -> DataFrame:
    """(key, place): the places whose string has another place. Rows were combined by task, so a window holds a few of each."""
    times = F.sum(F.col("place").bitwiseAND(F.lit(1)) + 1).over(W.partitionBy("h", "g"))
    return rows.withColumn("_times", times).filter("_times > 1 and shiftright(place, 1) > 0").select("key", "place")


def marks(found: DataFrame, width: int) -> DataFrame:
    """(key, runs): each document's covered stretches, as start << 32 | length; staged. A start covers `width`."""

    def merge(batches):
        for batch in batches:
            merged = []
            for own in batch.column(1).to_pylist():
                p = np.sort(np.asarray(own, np.int64))
                s, e = p >> 32, (p >> 32) + ((p & 0xFFFFFFFF) >> 1) - 1 + width
                top = np.maximum.accumulate(e)
                new = np.concatenate(([True], s[1:] > top[:-1]))
                first = np.flatnonzero(new)
                end = top[np.concatenate((first[1:] - 1, [len(s) - 1]))]
                merged.append(s[first] << 32 | (end - s[first]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, pa.list_(pa.int64()))], names=["key", "runs"])

    return stage(found.groupBy("key").agg(F.collect_list("place").alias("places")).mapInArrow(merge, "key long, runs array<long>"), "marks")


def with_marks(docs: DataFrame, marked: DataFrame, most: int = 2_000_000) -> DataFrame:
    """`docs` (with a column key) and runs, null for those without. The marks are broadcast if they are few runs, else joined by key."""
    total = marked.agg(F.sum(F.size("runs"))).first()[0] or 0
    return lookup(docs, marked, ["key"], "left", limit=most if total <= most else 0)


def removed_flags(own, n: int) -> np.ndarray:
    flags = np.zeros(n, bool)
    for r in own or ():
        flags[r >> 32 : (r >> 32) + (r & 0xFFFFFFFF)] = True
    return flags


__all__ = ["GROUP_BYTES", "PLACES", "Places", "Seen", "counted", "groups_of", "marks", "removed_flags", "repeated_filter", "repeated_places", "row_key", "runs", "with_marks"]
