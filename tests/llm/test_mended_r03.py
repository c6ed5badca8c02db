"""Toxicity labels without documents, and places of strings that share a folded hash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemill.llm import repeats, toxicity
from tests.llm.test_operators import docs

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("labels", [[(i, 1, 0) for i in range(10)] + [(99, 1, 1)], [(99, 1, 1), (98, 1, 0)], [(i, 1, 1) for i in range(10)], []])
def test_a_class_without_documents_gives_the_flat_model(spark, labels):
    d = docs(spark, [f"word{i} text" for i in range(10)])
    model = toxicity.fit_toxicity(d, spark.createDataFrame(labels, LABELS))
    assert model["flat"] and {r.score for r in toxicity.score_toxicity(d, model).collect()} == {0.0}
    assert toxicity.drop_toxic(d, model).count() == 10


def test_a_class_whose_texts_do_not_fit_is_an_error(spark):
    d = docs(spark, ["bad " * 200, "good", "fine"])
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, 1, 0)], LABELS)
    with pytest.raises(ValueError):
        toxicity.fit_toxicity(d, labels, chars=400)
    assert not toxicity.fit_toxicity(d, labels)["flat"]


def test_labels_of_absent_documents_take_no_place_in_the_sample(spark):
    d = docs(spark, [f"text {i}" for i in range(8)])
    rows = [(i, 1, i % 2) for i in range(8)] + [(i, 1, i % 2) for i in range(100, 1100)]
    texts, y = toxicity.training_sample(d, spark.createDataFrame(rows, LABELS), "toxic", F.lit(True), per_class=4)
    assert sorted(texts) == [f"text {i}" for i in range(8)] and sorted(y) == [0] * 4 + [1] * 4


def folded(h, g):
    return (np.int64(h) ^ (np.array([g], np.int64) * 0x2545F4914F6CDD1D))[0]


def test_strings_with_one_folded_hash_stay_apart():
    """Two pairs of hashes whose 64-bit fold is the same, and two with the same first hash: none is taken for repeated."""
    g1, g2 = 5, 9
    with np.errstate(over="ignore"):
        h1 = 7
        h2 = int(folded(h1, g1) ^ (np.array([g2], np.int64) * 0x2545F4914F6CDD1D)[0])
        assert folded(h1, g1) == folded(h2, g2) and (h1, g1) != (h2, g2)
    own = repeats.Places()
    rows = lambda *x: own.rows(*(np.array(c, np.int64) for c in zip(*x, strict=True))).to_pylist()
    first = rows((h1, g1, 1, 0), (h2, g2, 2, 0), (7, 6, 3, 4))
    assert [(r["h"], r["g"], r["place"] & 1) for r in first] == [(h1, g1, 0), (h2, g2, 0), (7, 6, 0)]
    # One pair repeats: announced once, its places are ready; the other pairs still wait.
    second = rows((h1, g1, 1, 0), (h1, g1, 4, 8), (h2, g2, 2, 0), (7, 6, 3, 4))
    ready = [r for r in second if r["place"] & 1 and r["key"]]
    assert {(r["key"], r["place"] >> 32) for r in ready} == {(1, 0), (4, 8)} and sum(r["key"] == 0 for r in second) == 1
    third = rows((h1, g1, 5, 3), (h2, g2, 6, 1), (7, 6, 7, 1))
    assert [r["place"] & 1 for r in third] == [0, 0, 1]


def test_distinct_pairs_equal_brute_force():
    rng = np.random.default_rng(1)
    h, g = rng.integers(0, 5, 200), rng.integers(0, 4, 200)
    unique, first, inverse, n = repeats.distinct_pairs(h, g)
    want = sorted(set(zip(h.tolist(), g.tolist(), strict=True)))
    assert unique.tolist() == want and [(h[i], g[i]) for i in first] == want
    assert [unique.tolist()[i] for i in inverse] == list(zip(h.tolist(), g.tolist(), strict=True)) and n.sum() == 200
    known = unique[::3]
    assert repeats.known_pairs(unique, known).tolist() == [x in known.tolist() for x in unique.tolist()]
