"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word gives its character n-grams (3 to 5 characters, the spaces around it included), each hashed to a row of an embedding
table; a window of `WINDOW` words is the mean of its n-grams' rows, put through a linear softmax over two classes (a word counts once in a row of repeats). An unseen
misspelling shares most n-grams with the word it comes from. A document's score comes from its most toxic window, by a logistic
calibration fitted on the training documents. Table and softmax are trained together: first each window with its document's
label, then toxic documents by their highest window only.

Training reads at most `PER_CLASS` labelled documents of each class and at most `TRAIN_CHARS` characters in all, half for each
class: whole texts in the order of a hash of the id, those over `TEXT_SHARE` of their class's half after all others, and a text
that does not fit is passed over for the next. The first pass trains on at most `FIRST_WINDOWS` windows of each class, drawn at
random; each later pass on every document's highest window and twice as many random clean ones. These bounds are the only ones.
The driver holds the sample's texts and the n-grams of one pass's windows, never those of all texts. Every whole text is scored; a
task holds one text's arrays at a time, and very long texts go through in blocks of whole windows.

Defined cases: null and empty texts have no n-grams and get the score of an empty bag; a null id counts as the empty text in the
fold; without labelled documents of both classes all scores are 0; with them, a class without a text that fits is an error; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

GRAMS = (3, 4, 5)
BITS = 18
ROWS = 1 << BITS
DIMS = 8
WINDOW = 10
#: A window of fewer n-grams is filled up with empty ones.
LEAST = 70
PER_CLASS = 3000
TRAIN_CHARS = 40_000_000
TEXT_SHARE = 0.05
FIRST_WINDOWS = 30_000
BLOCK_CHARS = 1 << 20
#: Marks that end a word; others inside a word stay, as misspellings use them.
PAUSES = '.,;:!?"()'


def _words(text: str) -> list[str]:
    """Lower-case words; one that repeats the word before it is left out."""
    text = text.lower()
    for mark in PAUSES:
        text = text.replace(mark, " ")
    words = text.split()
    return [a for a, b in zip(words, [None, *words], strict=False) if a != b]


def _blocks(text: str) -> list[list[str]]:
    """The words of a text; those of a very long one in blocks of whole windows."""
    words = _words(text)
    step = WINDOW * 4096 if len(text) > BLOCK_CHARS else max(len(words), 1)
    return [words[i : i + step] for i in range(0, len(words), step)]


def _grams(words: list[str]):
    """(positions of the spaces, [(table row, whether it lies in a word) of the n-gram at each position, for each n])."""
    chars = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    space = chars == 32
    inner = np.concatenate((np.zeros(1, np.int32), np.cumsum(space, dtype=np.int32)))
    h, out = chars.astype(np.uint64), []
    with np.errstate(over="ignore"):
        for n in range(2, GRAMS[-1] + 1):
            m = len(chars) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :]
            if n in GRAMS:
                out.append(((h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int32), inner[n - 1 : n - 1 + m] == inner[1 : m + 1]))  # no space but at the ends
    return np.flatnonzero(space), out


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram rows, the window number of each) of a block of words."""
    spaces, grams = _grams(words)
    at = [np.searchsorted(spaces, np.flatnonzero(good), "right") - 1 for _, good in grams]
    return np.concatenate([rows[good] for rows, good in grams]), np.concatenate(at) // WINDOW


def window_logits(text: str, weight: np.ndarray) -> np.ndarray:
    """The mean weight of each window's n-grams; weight: by table row, embeddings and softmax multiplied out."""
    out = []
    for words in _blocks(text):
        spaces, grams = _grams(words)
        starts = spaces[:-1:WINDOW]
        total, n = np.zeros(len(starts)), np.zeros(len(starts))
        for rows, good in grams:
            own = starts[starts < len(rows)]
            total[: len(own)] += np.add.reduceat(weight[rows] * good, own)
            n[: len(own)] += np.add.reduceat(good, own, dtype=np.int32)
        out.append(total / np.maximum(n, LEAST))
    return np.concatenate(out) if out else np.zeros(1)


def _bags(texts: list[str], begins: np.ndarray, pick: np.ndarray, weight: np.ndarray | None = None) -> tuple[list[np.ndarray], list[int]]:
    """(n-gram rows, document) of the windows numbered in `pick` (sorted; begins: each text's first number) and, with a weight,
    of the window with the highest mean of each text that has words."""
    bags, doc = [], []
    bounds = np.searchsorted(pick, np.append(begins, np.iinfo(np.int64).max))
    for d, text in enumerate(texts):
        own = pick[bounds[d] : bounds[d + 1]] - begins[d]
        if weight is None and not len(own):
            continue
        before, best, highest = 0, None, -np.inf
        for words in _blocks(text):
            rows, at = subwords(words)
            rows = rows[np.argsort(at, kind="stable")]
            ends = np.cumsum(np.bincount(at))
            starts = np.concatenate(([0], ends[:-1]))
            if weight is not None:
                means = np.add.reduceat(weight[rows], starts) / np.maximum(ends - starts, LEAST)
                top = int(means.argmax())
                if means[top] > highest:
                    highest, best = means[top], rows[starts[top] : ends[top]].copy()
            here = own[(own >= before) & (own < before + len(ends))] - before
            bags += [rows[starts[i] : ends[i]].copy() for i in here]
            before += len(ends)
        doc += [d] * len(own)
        if best is not None:
            bags.append(best)
            doc.append(d)
    return bags, doc


def train(texts: list[str], labels: list[int], epochs: int = 6, batch: int = 64, rate: float = 1.0, min_docs: int = 8, decay: float = 5e-4, damp: float = 1e-3, seed: int = 11, first_windows: int = FIRST_WINDOWS) -> dict:
    """The table, softmax, offset and calibration, from labelled texts."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float64)
    model = {"table": rng.uniform(-1 / DIMS, 1 / DIMS, (ROWS, DIMS)), "softmax": rng.normal(0, 1, DIMS), "offset": 0.0, "scale": 1.0, "shift": 0.0, "flat": len(set(labels)) < 2}
    if model["flat"]:
        return model
    docs_with, counts = np.zeros(ROWS, np.int32), np.zeros(len(texts), np.int64)
    for d, text in enumerate(texts):
        seen = [np.unique(subwords(words)[0]) for words in _blocks(text)]
        if seen:
            docs_with[np.unique(np.concatenate(seen))] += 1
            counts[d] = -(-len(_words(text)) // WINDOW)
    begins, kind = np.cumsum(counts) - counts, np.repeat(y, counts)
    pos, neg = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
    e, w = model["table"], model["softmax"]
    squares = np.full(ROWS, damp)
    common = docs_with >= min_docs
    e[~common] = 0
    for epoch in range(epochs):
        step = rate if epoch else rate / 4
        if epoch:
            few = rng.choice(neg, min(len(neg), 2 * int((counts > 0).sum())), replace=False)
            bags, doc = _bags(texts, begins, np.sort(few), e @ w)
        else:
            few = np.concatenate([rng.choice(x, min(len(x), first_windows), replace=False) for x in (pos, neg)])
            bags, doc = _bags(texts, begins, np.sort(few))
        doc, lengths = np.asarray(doc, np.int64), np.asarray([len(b) for b in bags], np.int64)
        sizes, pick = np.maximum(lengths, LEAST), np.arange(len(bags))
        pick = rng.permutation(pick)
        for i in range(0, len(pick), batch):
            chosen = pick[i : i + batch]
            rows = np.concatenate([bags[b] for b in chosen])
            where = np.repeat(np.arange(len(chosen)), lengths[chosen])
            n = sizes[chosen]
            unique, inv = np.unique(rows, return_inverse=True)
            own = e[unique]
            scalar = own @ w
            logit = np.bincount(where, scalar[inv], len(chosen)) / n + model["offset"]
            miss = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[doc[chosen]]
            pull = np.bincount(inv, (miss / n)[where], len(unique))
            grad_w = pull @ own
            squares[unique] += pull**2
            e[unique] -= (common[unique] * step * pull / np.sqrt(squares[unique]))[:, None] * w / np.abs(w).max() + decay * own
            w -= 0.05 * grad_w / len(chosen)
            model["offset"] -= 0.02 * float(miss.mean())
    weight = e @ w
    best = np.asarray([window_logits(t, weight).max() for t in texts])
    model["scale"], model["shift"] = _logistic(best, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Newton steps for P(y) = 1 / (1 + exp(-(a x + b))), slightly regularised."""
    mean, spread = x.mean(), x.std() + 1e-9
    z = np.stack(((x - mean) / spread, np.ones_like(x)), 1)
    t = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ t, -30, 30)))
        grad = z.T @ (p - y) + 0.1 * t
        t -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), grad)
    return float(t[0] / spread), float(t[1] - t[0] * mean / spread)


def score(text: str, weight: np.ndarray, model: dict) -> float:
    if model["flat"]:
        return 0.0
    return float(1 / (1 + np.exp(-np.clip(model["scale"] * window_logits(text, weight).max() + model["shift"], -30, 30))))


def fold(id_col: str, parts: int) -> Column:
    return F.pmod(F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)), F.lit(parts))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, per_class: int = PER_CLASS, chars: int = TRAIN_CHARS, share: float = TEXT_SHARE) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled texts, the same at every run: of the labels that have a document the lowest hashes of each class,
    then whole texts that fit in half of `chars`, in hash order; texts over `share` of that half come after all others. A class may
    have no document; training then gives the flat model. One whose texts are all too long for `chars` is an error."""
    present = docs.select("doc_id").distinct()
    known = labels.filter(keep & F.col(label_col).isin(0, 1)).join(present, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(label_col).alias("_y")).withColumn("_h", F.xxhash64(F.lit("sample"), "doc_id"))
    classes = [known.filter(F.col("_y") == y).orderBy("_h", "doc_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(classes[0].unionByName(classes[1]))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).join(chosen, "doc_id").withColumn("_t", F.xxhash64("_text"))
    texts = stage(texts.dropDuplicates(["doc_id", "_t"]), "sample")
    half, taken, found = chars // 2, [], set()
    for y in (0, 1):
        sized = texts.filter(F.col("_y") == y).select("_h", "doc_id", "_t", F.length("_text").alias("n")).withColumn("_long", F.col("n") > share * half)
        left = half
        for r in sized.orderBy("_long", "_h", "doc_id", "_t").limit(per_class).collect():
            if r["n"] <= left:
                left -= r["n"]
                taken.append((r["_h"], r["doc_id"], r["_t"]))
                found.add(y)
    if len(found) < 2 and known.select("_y").distinct().count() == 2:
        raise ValueError(f"documents labelled with both classes, but of class {min({0, 1} - found)} no text of at most {half} characters")
    pick = set(taken)
    keys = F.broadcast(docs.sparkSession.createDataFrame([(h, t) for h, _, t in sorted(pick, key=str)], "_h long, _t long").distinct())
    rows = sorted((r["_h"], r["doc_id"], r["_t"], r["_text"], r["_y"]) for r in texts.join(keys, ["_h", "_t"]).select("_h", "doc_id", "_t", "_text", "_y").toLocalIterator())
    rows = [r for r in rows if r[:3] in pick]
    return [r[3] for r in rows], [int(r[4]) for r in rows]


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column | None = None, **options) -> dict:
    return train(*training_sample(docs, labels, "toxic", F.lit(True) if keep is None else keep, **options))


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    spark = docs.sparkSession
    weight = (model["table"] @ model["softmax"]).astype(np.float32)
    shared = spark.sparkContext.broadcast((weight, {k: model[k] for k in ("scale", "shift", "flat")}))

    def scored(batches):
        table_, rest = shared.value
        for batch in batches:
            values = [score(t or "", table_, rest) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col)).mapInArrow(scored, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def drop_toxic(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows of `docs` that score under `least`; all columns stay as they are."""
    weight = (model["table"] @ model["softmax"]).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((weight, {k: model[k] for k in ("scale", "shift", "flat")}))
    at = docs.columns.index("text")

    def kept(batches):
        table_, rest = shared.value
        for batch in batches:
            yield batch.filter(pa.array([score(t or "", table_, rest) < least for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scores = score_toxicity(docs, model)
    return scores.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
