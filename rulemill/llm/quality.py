"""Quality: a regularised quadratic discriminant over transformed document statistics.

One pass over the whole texts gives each document's statistics (transformed by log, square root or logit) as a staged table.
The class means and covariances are sums over all labelled training rows, made by Spark; each covariance is shrunk towards a
multiple of the identity, and its Cholesky factor is computed once and kept. The score is the logistic of the difference of the
two classes' Mahalanobis log-densities and log-shares.

Defined cases: null and empty texts have the statistics of no words; a null id counts as the empty text in the fold; without
training rows of both classes all scores are the share of class 1 (0.5 without rows); repeated rows are scored each; a document
with several labels counts with the highest; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import as_bytes
from .common import lookup, stage, table
from .toxicity import fold

SHRINK = 0.05
FEATURES = ("words", "length", "length_spread", "letters", "capitals", "digits", "marks", "symbols", "distinct", "top_word", "row_repeats", "line_repeats", "line_words", "sentence_ends")
_CLASS = np.zeros(256, np.int8)  # 0 space, 1 letter, 2 capital, 3 digit, 4 mark, 5 symbol
_CLASS[33:127] = 5
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 4
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 3, 2, 1, 1


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text, in the order of FEATURES."""
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=6)
    words = text.split()
    n, seen = len(words), int(kinds[1:].sum())
    lengths = np.fromiter(map(len, words), np.int32, n) if n else np.zeros(1)
    counts = Counter(words)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = sum(text.count(c) for c in (b". ", b".\n", b"? ", b"! "))
    return [
        float(np.log1p(n)),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        _logit(kinds[1] + kinds[2], seen),
        _logit(kinds[2], seen),
        _logit(kinds[3], seen),
        _logit(kinds[4], seen),
        _logit(kinds[5], seen),
        _logit(len(counts), n),
        _logit(max(counts.values(), default=0), n),
        _logit(repeats, max(n - 1, 0)),
        _logit(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        float(np.sqrt(ends / max(1, n))),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row."""

    def compute(batches):
        for batch in batches:
            rows = [statistics(t) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(compute, f"doc_id {kind}, stats array<double>")


def _moments(batches):
    """Counts, sums and sums of products of each class, as (y, place, value) rows of this task."""
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        y = np.asarray(batch.column(0).to_pylist(), np.int64)
        x = np.asarray(batch.column(1).to_pylist(), np.float64).reshape(len(y), d)
        for c in (0, 1):
            own = x[y == c]
            sums[c] += np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel()))
    y, place = np.divmod(np.arange(sums.size), sums.shape[1])
    yield pa.RecordBatch.from_pydict({"y": pa.array(y, pa.int32()), "place": pa.array(place, pa.int32()), "value": pa.array(sums.ravel(), pa.float64())})


def fit_quality(stats: DataFrame, labels: DataFrame, keep: Column | None = None, shrink: float = SHRINK) -> dict:
    """Means, Cholesky factors of the inverse's inverse, log-determinants and log-shares of both classes."""
    known = labels.filter((F.lit(True) if keep is None else keep) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("_y"))
    rows = lookup(stats, stage(known, "known"), ["doc_id"]).select("_y", "stats")
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    for r in rows.mapInArrow(_moments, "y int, place int, value double").groupBy("y", "place").agg(F.sum("value").alias("value")).collect():
        sums[r["y"], r["place"]] = r["value"]
    share = (sums[1, 0] + 0.5) / (sums[:, 0].sum() + 1)
    model: dict = {"share": float(share), "flat": bool((sums[:, 0] < 2).any()), "classes": []}
    if not model["flat"]:
        for s in sums:
            mean = s[1 : 1 + d] / s[0]
            cov = s[1 + d :].reshape(d, d) / s[0] - np.outer(mean, mean)
            cov = (1 - shrink) * cov + shrink * max(np.trace(cov) / d, 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(cov)
            model["classes"].append((mean, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()), float(np.log(s[0] / sums[:, 0].sum()))))
    return model


def quality_scores(x: np.ndarray, model: dict) -> np.ndarray:
    if model["flat"]:
        return np.full(len(x), model["share"])
    density = [part - logdet - 0.5 * (((x - mean) @ unfactor.T) ** 2).sum(1) for mean, unfactor, logdet, part in model["classes"]]
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -50, 50)))


def score_quality(stats: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row of the statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(quality_scores(x, shared.value), pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(scored, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stage(document_statistics(table(spark, sf_dir, "documents")), "statistics")
    model = fit_quality(stats, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return score_quality(stats, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
