"""Suffix-array dedup of byte strings: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Strings of `size` bytes that start at more than one place of the corpus are found in blocks that Spark deals out so that equal
strings meet: each string is owned by its lowest-hashed gram of 64 bytes (among places that a hash of 4 bytes picks). A gram's
strings are parted by where the gram lies in them; all strings of a part have a longer extension of the gram in common. Their
span - the bytes of all of them, the extension left out - goes to the block of the extension. Grams and extensions that occur
once are filtered out before anything is shipped; equal spans that a task holds at a time are shipped once.

In a block, the spans are joined with separators, a mark and a number in place of each extension, and sorted to a suffix array; the transform's intervals are extended backward,
breadth first: the queue holds the intervals of all strings of one length, each extension whose right border has no common-prefix
value yet gets the current length, and the search stops at the minimum length. Borders without a value have common prefixes of
at least that length: their suffixes are the repeated strings.

Extensions that occur more than `HOT` times are not sent to one block: their strings are counted by 128 bits of hash, each start a
row, combined by task, which spreads any group. Strings are judged on the input and never cross documents.

Defined cases: null and empty texts have no bytes; texts under the minimum are kept whole; equal rows are repeats of each other;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import BYTE_MUL, BYTE_MUL2, as_bytes, inverse, mixed, powers, runs
from .common import stage, table
from .repeats import Places, groups_of, marks, removed_flags, repeated_places, row_key, with_marks
from .repeats import repeated_filter as seen_filter

SIZE = 400
GRAM = 64
PARTS = 4
MARK, DIGITS = 257, 3  # what stands for an extension in a block: a symbol of its own and its number's bytes
PICK = 15  # of 4 bytes' hash: one place in 16
BLOCK_BYTES = 1 << 20
HOT = 2_000
#: Spans and rows of hot strings that a task holds before it ships them.
HELD, HELD_HOT = 1 << 15, 1 << 19


class Hashes:
    """Hashes of any byte ranges of one buffer."""

    def __init__(self, values: np.ndarray, base: int = BYTE_MUL):
        n = len(values)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, n))))
        self.back = powers(inverse(base), n + 1)

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[starts + length] - self.sums[starts]) * self.back[starts])


def _lower_neighbour(h: np.ndarray, at: np.ndarray, reach: int, step: int, strict: bool) -> np.ndarray:
    """For each picked place the next one (step 1 or -1) within reach whose hash is lower (or as low); far away if there is none."""
    n = len(h)
    out = np.full(n, 1 << 60 if step > 0 else -(1 << 60), np.int64)
    todo, k = np.arange(n), 1
    while len(todo):
        other = todo + k * step
        inside = (other >= 0) & (other < n)
        todo, other = todo[inside], other[inside]
        near = np.abs(at[other] - at[todo]) <= reach
        todo, other = todo[near], other[near]
        low = h[other] < h[todo] if strict else h[other] <= h[todo]
        out[todo[low]] = at[other[low]]
        todo, k = todo[~low], k + 1
    return out


def owners(values: np.ndarray, first: np.ndarray, last: np.ndarray, hashes: Hashes, size: int, gram: int):
    """(place, low, high, text) of the grams that own strings: the strings that start in [low, high]. Text t lies in
    [first[t], last[t]). Strings without a picked place own themselves."""
    reach = size - gram
    with np.errstate(over="ignore"):
        v = values.astype(np.uint32)
        local = v[:-3] * np.uint32(0x9E3779B1) + v[1:-2] * np.uint32(0x85EBCA77) + v[2:-1] * np.uint32(0xC2B2AE3D) + v[3:] * np.uint32(0x27D4EB2F) if len(v) > 3 else np.zeros(0, np.uint32)
        local = (local ^ (local >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    at = np.flatnonzero(local >> np.uint32(20) & np.uint32(PICK) == 0)
    text = np.searchsorted(first, at, "right") - 1
    fits = at + gram <= last[text]
    at, text = at[fits], text[fits]
    h = hashes.of(at, gram)
    before, after = _lower_neighbour(h, at, reach, -1, False), _lower_neighbour(h, at, reach, 1, True)
    low = np.maximum(np.maximum(before + 1, at - reach), first[text])
    high = np.minimum(np.minimum(at, after - reach - 1), last[text] - size)
    own = low <= high
    at, low, high, text = at[own], low[own], high[own], text[own]
    n = len(values)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, low, 1)
    np.add.at(change, high + 1, -1)
    long = np.flatnonzero(last - first >= size)
    np.add.at(change, first[long], -(1 << 20))
    np.add.at(change, last[long] - size + 1, 1 << 20)
    alone = np.flatnonzero(np.cumsum(change[:-1]) == -(1 << 20))
    if len(alone):
        at, low, high = (np.concatenate((x, alone)) for x in (at, low, high))
        text = np.concatenate((text, np.searchsorted(first, alone, "right") - 1))
    return at, low, high, text


def part_width(size: int, gram: int) -> int:
    """How many places a gram has in the strings of one part; their extension has size - width + 1 bytes."""
    return (size - gram) // PARTS + 1


def extended(at, low, high, text, hashes: Hashes, size: int, gram: int):
    """Each owner's strings parted by the gram's place in them: (extension's hash, its place, low, high, text)."""
    width = part_width(size, gram)
    out = []
    for part in range(PARTS):
        place = at - part * width
        first, last = np.maximum(low, place - width + 1), np.minimum(high, place)
        has = first <= last
        h = hashes.of(place[has], size - width + 1) ^ mixed(np.full(1, part + 1, np.uint64))
        out.append((h, place[has], first[has], last[has], text[has]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _parts(texts: list[bytes], size: int, gram: int, filters: list):
    """Of each group of texts: (buffer, hashes, first places, extension hashes, their places, low, high, text numbers); with no
    filter yet, the grams stand for the extensions."""
    for i, j in groups_of(texts):
        data = b"".join(texts[i:j])
        first = np.cumsum([0, *map(len, texts[i:j])])
        values = np.frombuffer(data, np.uint8)
        if len(values) < size:
            continue
        hashes = Hashes(values)
        at, low, high, text = owners(values, first[:-1], first[1:], hashes, size, gram)
        if not len(at):
            continue
        h = hashes.of(at, gram)
        if filters:
            known = filters[0].value.has(h)
            h, at, low, high, text = extended(at[known], low[known], high[known], text[known], hashes, size, gram)
            if len(filters) > 1:
                known = filters[1].value.has(h)
                h, at, low, high, text = h[known], at[known], low[known], high[known], text[known]
        yield data, hashes, first, h, at, low, high, text + i


def transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, Burrows-Wheeler transform) of bytes + 1 and marks, with 0 as separator, sorted by `depth` symbols at least."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(7, text.dtype))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = key * np.uint64(MARK + 1) + padded[j : j + n]
    k = 7
    while True:
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        sorted_ = key[order]
        new[order] = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
        if k >= depth or new[order[-1]] == n - 1:
            return order, text[order - 1]
        after = np.zeros(n, np.int64)
        after[: n - k] = new[k:] + 1
        key, k = new * (n + 1) + after, 2 * k


def repeated_suffixes(text: np.ndarray, size: int) -> np.ndarray:
    """Which places of `text` start a string of `size` symbols that starts elsewhere in it too (separators are 0)."""
    n = len(text)
    order, bwt = transform(text, size)
    step = np.empty(n, np.int64)  # from the place of a suffix to that of the suffix one symbol longer
    step[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(n)
    cuts = np.concatenate(([True], bwt[1:] != bwt[:-1]))
    run = np.cumsum(cuts) - 1
    begins = np.flatnonzero(cuts)
    ends = np.concatenate((begins[1:], [n])) - 1
    symbol = bwt[begins].astype(np.int64)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(size):
        if not len(low):
            break
        of = run[low]
        count = run[high] - of + 1
        one = count == 1
        first, last = [low[one]], [high[one]]
        if not one.all():  # the first and the last place of each symbol in the interval, from the transform's runs
            l, h, of, count = low[~one], high[~one], of[~one], count[~one]
            which = np.repeat(np.arange(len(l)), count)
            r = np.repeat(of - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
            order_ = np.argsort(which * (MARK + 1) + symbol[r], kind="stable")
            which, r = which[order_], r[order_]
            cut = np.flatnonzero((np.diff(which) != 0) | (np.diff(symbol[r]) != 0))
            a, b = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(r) - 1]))
            first.append(np.maximum(begins[r[a]], l[which[a]]))
            last.append(np.minimum(ends[r[b]], h[which[b]]))
        low, high = step[np.concatenate(first)], step[np.concatenate(last)]
        fresh = ~known[high + 1]
        low, high = low[fresh], high[fresh]
        known[high + 1] = True
    out = np.zeros(n, bool)
    out[order] = ~known[:-1] | ~known[1:]
    return out


def collapsed(data: bytes, low: int, high: int, place: int, size: int, width: int) -> bytes:
    """The span of the strings that start in [low, high], without their extension: the length of what lies before it, in two
    bytes, then what lies before and after it."""
    return (place - low).to_bytes(2, "big") + data[low:place] + data[place + size - width + 1 : high + size]


def block_answers(spans: list[tuple[int, bytes]], width: int) -> list[np.ndarray]:
    """For each span (number of its extension, bytes) of a block, which of its strings are repeated in the block."""
    parts, ends = [], []
    total = 0
    for number, span in spans:
        before = 2 + int.from_bytes(span[:2], "big")
        parts += (span[2:before], b"\0", number.to_bytes(DIGITS, "big"), span[before:], b"\0")
        total += len(span) + DIGITS  # two bytes of length less, a mark and a separator more
        ends.append(total)
    text = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + 1
    ends = np.asarray(ends)
    starts = np.concatenate(([0], ends[:-1]))
    text[ends - 1] = 0
    text[starts + np.asarray([int.from_bytes(span[:2], "big") for _, span in spans])] = MARK
    size = width + DIGITS
    found = repeated_suffixes(text, size)
    return [found[s : e - size] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


SPANS = "h long, g long, span binary, key long, place long"


def _span_rows(spans: dict) -> pa.RecordBatch:
    """The rows of (extension, span) -> owners: one with the span, and one without for each owner where there are several."""
    out = {"h": [], "g": [], "span": [], "key": [], "place": []}

    def add(h, span, key, place):
        for name, value in zip(out, (h, 0, span, key, place), strict=True):
            out[name].append(value)

    for (x, span), where in spans.items():
        if len(where) == 1:
            add(x, span, where[0][0], where[0][1] << 32 | where[0][2] << 1)
            continue
        add(x, span, 0, 1)
        for key, start, n in where:
            add(key ^ start, None, key, start << 32 | n << 1 | 1)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "span" else pa.int64()) for k, v in out.items()], names=list(out))


def _hot_rows(own: Places, held: list) -> pa.RecordBatch:
    """The rows of hot strings, with an empty span."""
    rows = own.rows(*(np.concatenate(x) for x in zip(*held, strict=True)))
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([b""] * rows.num_rows, pa.binary()), rows.column(2), rows.column(3)], names=["h", "g", "span", "key", "place"])


def repeated_bytes(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT, held: int = HELD, held_hot: int = HELD_HOT) -> DataFrame:
    """(key, runs) of the documents (columns key, text) that have repeated strings."""
    context = docs.sparkSession.sparkContext
    width = part_width(size, gram)
    filters: list = []

    def level(batches):
        for batch in batches:
            parts = [p[3] for p in _parts(as_bytes(batch.column(0)), size, gram, filters)]
            if parts:
                unique, n = np.unique(np.concatenate(parts).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": unique, "n": n.astype(np.int32)})

    filters.append(context.broadcast(seen_filter(docs.select("text").mapInArrow(level, "h long, n int"))))
    counts = stage(docs.select("text").mapInArrow(level, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"), "extensions")
    filters.append(context.broadcast(seen_filter(counts)))
    filters.append(context.broadcast(seen_filter(counts.filter(F.col("n") > hot))))

    def ship(batches):
        own = Places()
        spans: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        hot_rows: list = []
        for batch in batches:
            texts, keys = as_bytes(batch.column(1)), np.asarray(batch.column(0).to_pylist(), np.int64)
            for data, hashes, first, h, at, low, high, text in _parts(texts, size, gram, filters):
                base = first[np.searchsorted(first, low, "right") - 1]
                many = filters[2].value.has(h)
                for x, p, a, b, t, o in zip(*(y[~many].tolist() for y in (h.view(np.int64), at, low, high, text, base)), strict=True):
                    spans.setdefault((x, collapsed(data, a, b, p, size, width)), []).append((int(keys[t]), a - o, b - a + 1))
                if many.any():
                    n = (high - low + 1)[many]
                    starts = np.repeat(low[many] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
                    second = Hashes(np.frombuffer(data, np.uint8), BYTE_MUL2).of(starts, size)
                    hot_rows.append((hashes.of(starts, size), second, keys[np.repeat(text[many], n)], starts - np.repeat(base[many], n)))
                if len(spans) >= held:
                    yield _span_rows(spans)
                    spans.clear()
                if sum(len(x[0]) for x in hot_rows) >= held_hot:
                    yield _hot_rows(own, hot_rows)
                    hot_rows.clear()
        yield _span_rows(spans)
        if hot_rows:
            yield _hot_rows(own, hot_rows)

    rows = stage(docs.select("key", "text").mapInArrow(ship, SPANS), "spans")
    counted = repeated_places(rows.filter("length(span) = 0").select("h", "g", "key", "place"))
    ready = rows.filter("span is null").select("key", "place")
    dealt = rows.filter("length(span) > 0").select("h", "span", "key", "place").repartition("h").sortWithinPartitions("h", "span")
    found = dealt.mapInArrow(lambda batches: _answered(batches, width), "key long, place long")
    return marks(found.unionByName(ready).unionByName(counted), size)


def _answered(batches, width: int):
    """Rows sorted by extension and span -> (key, place) of the repeated strings. Spans of whole extensions are gathered to
    blocks; an extension with one span, or with none that occurs once, is
    settled by the number of rows."""
    block: list[tuple[int, bytes, list[tuple[int, int]], bool]] = []
    group: list[tuple[bytes, list[tuple[int, int]], bool]] = []
    weight = 0
    keys_out: list[int] = []
    places_out: list[int] = []

    def emit(owners_, flags=None):
        for key, place in owners_:
            start, n = place >> 32, (place & 0xFFFFFFFF) >> 1
            if not n:
                continue
            if flags is None:
                keys_out.append(key)
                places_out.append(place | 1)
                continue
            for s, e in zip(*(x.tolist() for x in runs(flags[:n])), strict=True):
                keys_out.append(key)
                places_out.append(start + s << 32 | (e - s) << 1 | 1)

    def close():
        nonlocal weight
        if len(group) == 1 or all(g[2] for g in group):
            for _, owners_, many in group:
                if many:
                    emit(owners_)
        else:
            number = block[-1][0] + 1 if block else 0
            block.extend((number, *g) for g in group)
            weight += sum(len(g[0]) for g in group)
        group.clear()

    def solve():
        nonlocal weight
        if block:
            for (*_, owners_, many), flags in zip(block, block_answers([b[:2] for b in block], width), strict=True):
                emit(owners_, None if many else flags)
        block.clear()
        weight = 0

    def flush():
        out = pa.RecordBatch.from_pydict({"key": pa.array(keys_out, pa.int64()), "place": pa.array(places_out, pa.int64())})
        keys_out.clear()
        places_out.clear()
        return out

    last = None
    for batch in batches:
        for h, span, key, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if h != last:
                close()
                last = h
                if weight >= BLOCK_BYTES:
                    solve()
                    yield flush()
            if group and group[-1][0] == span:
                group[-1][1].append((key, place))
                group[-1] = (span, group[-1][1], True)
            else:
                group.append((span, [(key, place)], bool(place & 1)))
    close()
    solve()
    yield flush()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, **options) -> DataFrame:
    """(id, kept, n_bytes, n_removed, n_spans) of every row; kept: the remaining bytes."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    kind = docs.schema[id_col].dataType.simpleString()

    def kept(batches):
        for batch in batches:
            out, total, gone, spans = [], [], [], []
            for text, own in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                flags = removed_flags(own, len(text))
                total.append(len(text))
                gone.append(int(flags.sum()))
                spans.append(len(runs(flags)[0]))
                out.append(text if not own else np.frombuffer(text, np.uint8)[~flags].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), *(pa.array(x, pa.int64()) for x in (total, gone, spans))], names=["_id", "kept", "n_bytes", "n_removed", "n_spans"])

    marked = with_marks(rows, repeated_bytes(rows, size, **options)).select("_id", "text", "runs")
    return marked.mapInArrow(kept, f"_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long").withColumnRenamed("_id", id_col)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
