"""Substring dedup over words, by level-wise doubling.

Windows of `size` words that occur more than once are found by levels of about a quarter, half and the whole of that length.
The lowest-hashed quarter-length gram of each window stands for it: equal windows have the same one, so a gram that occurs once
settles all windows that it stands for as alone. Only windows of repeated grams are extended to twice the length (to the right
where the window has room, else to the left), counted again, and the survivors are counted at full length, with their places.
Each level is one pass over the texts, one count by hash, and a filter of bounded size for the next one.

A word covered by a repeated window is removed. Windows are judged on the input and never cross documents.

Defined cases: null and empty texts have no words; texts under the window are kept whole; equal rows are repeats of each other;
an empty table gives an empty result; other columns are ignored. Windows are told apart by 128 bits of hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import WORD_MUL2, as_bytes, lowest_in_windows, window_hashes, word_hashes, word_ranges
from .common import table
from .repeats import GROUP_BYTES, PLACES, Places, counted, groups_of, marks, removed_flags, repeated_filter, repeated_places, row_key, with_marks

WINDOW = 35
#: How many windows of the last level a task gathers before it combines and ships them.
HELD = 1 << 19


def level_sizes(size: int) -> tuple[int, int, int]:
    quarter = -(-size // 4)
    return quarter, min(2 * quarter, size), size


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, place in the text) of each word."""
    hashes, owner, place = [], [], []
    for i, j in groups_of(texts):
        data, first = b"\n".join(texts[i:j]), np.cumsum([0, *(len(t) + 1 for t in texts[i:j])])
        at = 0
        while at < len(data):  # a long document goes through in pieces that end at white space
            end = min(len(data), at + 4 * GROUP_BYTES)
            while end < len(data) and not data[end - 1 : end].isspace():
                more = data[end : end + 4096]
                cut = next((x for x, c in enumerate(more) if c in b" \t\n\r\x0b\x0c"), None)
                end += len(more) if cut is None else cut + 1
            values = np.frombuffer(data[at:end], np.uint8)
            starts, ends = word_ranges(values)
            hashes.append(word_hashes(values, starts, ends))
            owner.append(np.searchsorted(first, starts + at, "right") - 1 + i)
            at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.concatenate(owner)
    counts = np.bincount(owner, minlength=len(texts))
    return np.concatenate(hashes), owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def candidates(texts: list[bytes], size: int, filters: list, blocks: int = 1 << 18):
    """See `_candidates`; texts go through in groups, so that only what is left of them is held together."""
    for i, j in groups_of(texts):
        for h, owner, place in _candidates(texts[i:j], size, filters, blocks):
            yield h, (owner + i).astype(np.int32), place.astype(np.int32)


def _candidates(texts: list[bytes], size: int, filters: list, blocks: int):
    """At level len(filters): (hashes of this level, text number, place of the window) for the windows that are left; below the
    last level, of each gram once, at the last one two hashes of each window."""
    words, owner, place = hashed_words(texts)
    quarter, half, _ = level_sizes(size)
    for at in range(0, max(len(words) - size + 1, 0), blocks):
        w = words[at : at + blocks + size - 1]
        n = len(w) - size + 1
        start = np.flatnonzero(owner[at : at + n] == owner[at + size - 1 : at + size - 1 + n])
        if not len(start):
            continue
        grams = window_hashes(w, quarter)
        lowest = lowest_in_windows(grams, size - quarter + 1)[start]
        if not filters:
            one = np.unique(lowest)
            yield grams[one], owner[at + one], place[at + one]
            continue
        known = filters[0].value.has(grams[lowest])
        start, lowest = start[known], lowest[known]
        right = lowest + half <= start + size
        left = np.maximum(lowest + quarter - half, 0)
        doubled = window_hashes(w, half)
        wide = np.where(right, lowest, left)
        h = doubled[wide] ^ np.where(right, np.uint64(0), np.uint64(0x5851F42D4C957F2D))
        if len(filters) == 1:
            one = np.unique(wide * 2 + right, return_index=True)[1]
            yield h[one], owner[at + wide[one]], place[at + wide[one]]
            continue
        start = start[filters[1].value.has(h)]
        yield np.stack((window_hashes(w, size)[start], window_hashes(w, size, WORD_MUL2)[start])), owner[at + start], place[at + start]


def repeated_words(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(key, runs) of the documents (columns key, text) that have repeated windows."""
    filters: list = []

    def level(batches):
        for batch in batches:
            parts = [h for h, _, _ in candidates(as_bytes(batch.column(0)), size, filters)]
            if parts:
                yield counted(np.concatenate(parts))

    for _ in range(2):
        seen = repeated_filter(docs.select("text").mapInArrow(level, "h long, n int"))
        filters.append(docs.sparkSession.sparkContext.broadcast(seen))

    def last(batches):
        own = Places()
        for batch in batches:
            keys = np.asarray(batch.column(0).to_pylist(), np.int64)
            parts, held = [], 0
            for h, owner, place in candidates(as_bytes(batch.column(1)), size, filters):
                parts.append((h[0], h[1], keys[owner], place.astype(np.int64)))
                held += len(place)
                if held >= HELD:
                    yield own.rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                    parts, held = [], 0
            if parts:
                yield own.rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return marks(repeated_places(docs.select("key", "text").mapInArrow(last, PLACES)), size)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(id, kept, n_words, n_removed) of every row; kept: the remaining words joined by one space."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    kind = docs.schema[id_col].dataType.simpleString()

    def kept(batches):
        for batch in batches:
            out, total, gone = [], [], []
            for text, own in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                flags = removed_flags(own, len(words))
                total.append(len(words))
                gone.append(int(flags.sum()))
                out.append(b" ".join(words if not own else [words[i] for i in np.flatnonzero(~flags)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["_id", "kept", "n_words", "n_removed"])

    marked = with_marks(rows, repeated_words(rows, size)).select("_id", "text", "runs")
    return marked.mapInArrow(kept, f"_id {kind}, kept binary, n_words long, n_removed long").withColumnRenamed("_id", id_col)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select r, unnest(range(1, len(ws) - {WINDOW - 2})) as i from d where len(ws) >= {WINDOW}),
named as (select w.r, w.i, md5(array_to_string(d.ws[w.i:w.i + {WINDOW - 1}], ' ')) as h from w join d using (r)),
again as (select h from named group by h having count(*) > 1),
gone as (select distinct r, unnest(range(i, i + {WINDOW})) as p from named semi join again using (h)),
words as (select r, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from d),
kept as (select w.r, string_agg(w.word, ' ' order by w.p) as body, count(*) as n from words w anti join gone g on g.r = w.r and g.p = w.p group by w.r)
select d.doc_id, len(d.ws) as n_words, len(d.ws) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.body, '')) as kept_sha256
from d left join kept k using (r)
"""
