"""Benchmark decontamination: an FM-index for each training shard, searched backward for all test phrases.

A shard holds whole documents, up to about `SHARD` symbols (a longer document is a shard of its own). Its text is the words' numbers in the benchmark's vocabulary; words that cannot lie in a
phrase (they or both their neighbour pairs occur in no item) become one separator, so that the index holds only what a phrase
may match. The index is a suffix array by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix, and suffix
positions sampled every `SAMPLE` places. All phrases are searched backward at once, by ranks; occurrences are located by
stepping back to a sampled position; overlapping spans are merged for each document.

The benchmark is the stated query set: it is read in blocks of at most `BLOCK_WORDS` words (a longer item is a block of its own);
each block is one pass over the documents, and a worker holds one block.

Defined cases: null and empty texts have no words and are clean; items without words are no phrase; items under the window are
one phrase; repeated items count each by their id; items with a null id are searched like
any other, so their hits count in the spans, n_hit and contaminated, but they have no name in items, n_items and items_sha256; repeated documents are answered each; an empty benchmark leaves all clean;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import as_bytes, covered, runs
from .common import numbered, stage, table

WINDOW = 10
SAMPLE = 16
BLOCK_WORDS = 1_000_000
SHARD = 1 << 19
PAIR_BITS = 24
#: Bytes that part words, after lower-casing: all ASCII but digits and small letters.
TO_SPACE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
EDGE = 1


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(TO_SPACE).split()


class Block:
    """A block of benchmark items: vocabulary, phrases (of symbols) and whose they are, and which neighbour pairs occur."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number: dict[tuple[int, ...], int] = {}
        self.owners: list[list[str | None]] = []
        pairs, singles = [], []
        for item, words in items:
            if not words:
                continue
            symbols = [self.vocabulary.setdefault(w, len(self.vocabulary) + EDGE + 1) for w in words]
            size = min(window, len(symbols))
            for i in range(len(symbols) - size + 1):
                phrase = tuple(symbols[i : i + size])
                at = number.setdefault(phrase, len(number))
                if at == len(self.owners):
                    self.owners.append([])
                if not self.owners[at] or self.owners[at][-1] != item:
                    self.owners[at].append(item)
            if size == 1:
                singles.append(symbols[0])
            pairs += zip(symbols, symbols[1:], strict=False)
        self.sizes = np.asarray([len(p) for p in number], np.int64)
        self.phrases = np.zeros((len(number), window), np.int64)
        for p, at in number.items():
            self.phrases[at, window - len(p) :] = p
        self.shortest = int(self.sizes.min()) if number else 0
        self.pair_flags = np.zeros(1 << PAIR_BITS, bool)
        if pairs:
            a = np.asarray(pairs, np.int64)
            self.pair_flags[self._pair(a[:, 0], a[:, 1])] = True
        self.single_flags = np.zeros(len(self.vocabulary) + EDGE + 1, bool)
        self.single_flags[singles] = True

    @staticmethod
    def _pair(a, b):
        return (a * 0x9E3779B1 + b) & ((1 << PAIR_BITS) - 1)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, places) of the words that may lie in a phrase, with an edge after each run of them."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        keep = self.single_flags[ids]
        if len(ids) > 1:
            pair = (ids[:-1] > 0) & (ids[1:] > 0)
            pair &= self.pair_flags[self._pair(ids[:-1], ids[1:])]
            keep[:-1] |= pair
            keep[1:] |= pair
        starts, ends = runs(keep)
        good = ends - starts >= self.shortest
        parts, places = [], []
        for s, e in zip(starts[good], ends[good], strict=True):
            parts += [ids[s:e], [EDGE]]
            places += [np.arange(s, e), [-1]]
        empty = np.zeros(0, np.int64)
        return (np.concatenate(parts), np.concatenate(places)) if parts else (empty, empty)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol is lower than all others and occurs once."""
    n, k = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1:
            return order


class FMIndex:
    def __init__(self, text: np.ndarray):
        """text: symbols over 0; 0 is put at its end."""
        text = np.concatenate((text, [0]))
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n, top = len(text), int(text.max())
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.marked = order % SAMPLE == 0
        self.sampled = order[self.marked]
        self.marks = np.concatenate(([0], np.cumsum(self.marked)))
        self.levels = []  # of the wavelet matrix, highest bit first: (bit, ones before each place, zeros in all)
        row = bwt
        for bit in range(max(top.bit_length(), 1) - 1, -1, -1):
            ones = (row >> bit & 1).astype(bool)
            before = np.zeros(len(row) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, before, len(row) - int(before[-1])))
            row = np.concatenate((row[~ones], row[ones]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        low, high = np.zeros_like(place), place
        for bit, ones, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def symbol(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros_like(place)
        for _, ones, zeros in self.levels:
            one = ones[place + 1] - ones[place]
            out = out * 2 + one
            place = np.where(one == 1, zeros + ones[place], place - ones[place])
        return out

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval [low, high) of each phrase; phrases stand at the right of their rows."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(1, phrases.shape[1] + 1):
            on = np.flatnonzero((sizes >= j) & (low < high))
            c = phrases[on, -j]
            known = c < len(self.less) - 1
            high[on[~known]] = low[on[~known]]
            on, c = on[known], c[known]
            low[on], high[on] = self.less[c] + self.rank(c, low[on]), self.less[c] + self.rank(c, high[on])
        return low, high

    def locate(self, place: np.ndarray) -> np.ndarray:
        out, steps, todo = np.zeros_like(place), 0, np.arange(len(place))
        while len(todo):
            done = self.marked[place]
            out[todo[done]] = self.sampled[self.marks[place[done]]] + steps
            todo, place, steps = todo[~done], place[~done], steps + 1
            c = self.symbol(place)
            place = self.less[c] + self.rank(c, place)
        return out


def search_shard(parts: list[tuple[np.ndarray, np.ndarray]], block: Block) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """Spans (word places, not merged) and items of each document of a shard, from the documents' (symbols, places)."""
    spans, items = [[] for _ in parts], [set() for _ in parts]
    sizes = np.asarray([len(p[0]) for p in parts])
    if not len(block.sizes) or not sizes.sum():
        return spans, items
    text, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    owner = np.repeat(np.arange(len(parts)), sizes)
    index = FMIndex(text)
    low, high = index.search(block.phrases, block.sizes)
    found = high - low
    rows = np.repeat(low - np.concatenate(([0], np.cumsum(found)[:-1])), found) + np.arange(int(found.sum()))
    phrase = np.repeat(np.arange(len(found)), found)
    at = index.locate(rows)
    for p, d, s in zip(phrase.tolist(), owner[at].tolist(), place[at].tolist(), strict=True):
        spans[d].append((s, s + int(block.sizes[p])))
        items[d].update(i for i in block.owners[p] if i is not None)
    return spans, items


def benchmark_blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str, most: int | None = None):
    """Blocks of items, read one partition at a time; the driver holds one block."""
    most = most or BLOCK_WORDS
    items, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = words_of((row["t"] or "").encode())
        items.append((row["i"], words))
        size += len(words)
        if size >= most:
            yield Block(items, window)
            items, size = [], 0
    if items:
        yield Block(items, window)


def _searched(batches, column: int, block: Block):
    """(batch, (words, span starts, span ends, items) of each row). Of a document's words only those that a phrase may match outlive its
    turn; a shard is searched when it is full."""

    def shard(totals, parts):
        for total, spans, items in zip(totals, *search_shard(parts, block), strict=True):
            if spans:
                a = np.asarray(spans)
                starts, ends = runs(covered(total, a[:, 0], a[:, 1] - a[:, 0]))
            else:
                starts = ends = np.zeros(0, np.int64)
            yield total, starts.tolist(), ends.tolist(), sorted(items)

    for batch in batches:
        out, totals, parts, size = [], [], [], 0
        for text in as_bytes(batch.column(column)):
            words = words_of(text)
            totals.append(len(words))
            parts.append(block.symbols(words))
            size += len(parts[-1][0])
            if size >= SHARD:
                out += shard(totals, parts)
                totals, parts, size = [], [], 0
        out += shard(totals, parts)
        yield batch, out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _block_rows(docs: DataFrame, block: Block, id_col: str, text_col: str) -> DataFrame:
    """(_id, n_words, spans, items) of every row, by one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def search(batches):
        for batch, rows in _searched(batches, 1, shared.value):
            spans = [[{"start": s, "end": e} for s, e in zip(r[1], r[2], strict=True)] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(spans, SPANS), pa.array([r[3] for r in rows], pa.list_(pa.string()))], names=["_id", "n_words", "spans", "items"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col)).mapInArrow(search, f"_id {kind}, {FOUND}")


def _joined(spans: Column) -> Column:
    """Sorted spans with those that overlap or touch made one."""
    kind = "array<struct<start:long,end:long>>"

    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last.isNotNull() & (s["start"] <= last["end"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, spans, items) of every row: spans are merged removal spans [start, end) of word places. A benchmark of one block
    is one pass; of more, each pass holds one block, its rows with hits are staged, and spans are merged by row at the end."""
    blocks = benchmark_blocks(benchmark, window, item_col, item_text_col)
    first, second = next(blocks, Block([], window)), next(blocks, None)
    if second is None:
        return _block_rows(docs, first, id_col, text_col).withColumnRenamed("_id", id_col)
    rows = numbered(docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text")))
    base = stage(_block_rows(rows, first, "_row", "_text"), "block")
    hits = [base.filter("size(spans) > 0").drop("n_words")]
    for block in chain([second], blocks):
        hits.append(stage(_block_rows(rows, block, "_row", "_text").filter("size(spans) > 0").drop("n_words"), "block"))
    merged = reduce(DataFrame.unionByName, hits).groupBy("_id").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    merged = merged.select("_id", _joined(F.col("spans")).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))
    out = rows.select("_row", "_own").join(base.select(F.col("_id").alias("_row"), "n_words"), "_row").join(merged.withColumnRenamed("_id", "_row"), "_row", "left")
    return out.select(F.col("_own").alias(id_col), "n_words", *(F.coalesce(c, F.array().cast(k)).alias(c) for c, k in (("spans", "array<struct<start:long,end:long>>"), ("items", "array<string>"))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs` without a hit; all columns stay as they are. Each block of the benchmark is one pass over what is left."""
    at, left = docs.columns.index("text"), docs
    for i, block in enumerate(benchmark_blocks(benchmark, window, "item_id", "text")):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches, shared=shared):
            for batch, rows in _searched(batches, at, shared.value):
                yield batch.filter(pa.array([not r[1] for r in rows], pa.bool_()))

        left = (stage(left, "left") if i else left).mapInArrow(clean, docs.schema)
    return left


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as ws from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as ws from benchmark),
bw as (select item, least({WINDOW}, len(ws)) as size, ws, unnest(range(1, len(ws) - least({WINDOW}, len(ws)) + 2)) as i from b where len(ws) > 0),
phrases as (select distinct item, size, array_to_string(ws[i:i + size - 1], ' ') as phrase from bw),
sizes as (select distinct size from phrases),
placed as (select r, size, ws, unnest(range(1, len(ws) - size + 2)) as i from d, sizes where len(ws) >= size),
hits as (select a.r, a.i, a.size, p.item from placed a join phrases p on p.size = a.size and p.phrase = array_to_string(a.ws[a.i:a.i + a.size - 1], ' ')),
places as (select r, count(distinct place) as n_hit from (select r, unnest(range(i, i + size)) as place from (select distinct r, i, size from hits)) group by r),
named as (select r, count(item) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from hits) group by r)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join places using (r) left join named using (r)
"""
