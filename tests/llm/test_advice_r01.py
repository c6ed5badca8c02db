
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemill.llm import decontamination, exact_dedup, mixing, near_dedup, toxicity
from tests.llm.test_operators import docs, words


def shingle_set(text, size=5):
    w = (text or "").lower().split()
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_near_stage_reaches_similarity_of_four_fifths(spark):
    """Copies with a few words changed: over 3 bits apart, but with a similarity of 0.8 or more."""
    texts = []
    for i in range(40):
        base = words(1000 + i, 300, 10**6).split()
        other = list(base)
        for k in range(1 + i % 9):
            other[20 + 30 * k] = f"changed{k}"
        texts += [" ".join(base), " ".join(other)]
    hot = words(7, 400, 10**6).split()
    texts += [" ".join([*hot[: 5 * k], f"own{k}", *hot[5 * k :]]) for k in range(30)]
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    want = {i for i in range(len(texts)) if label[i] == i}
    assert 41 < len(want) < 80
    assert {r.doc_id for r in near_dedup.drop_near(docs(spark, texts)).collect()} == want
    assert near_dedup.drop_near(docs(spark, texts).limit(0)).count() == 0
    few = docs(spark, [None, "", " ", "a b", "A  b", "a c"])
    assert {r.doc_id for r in near_dedup.drop_near(few).collect()} == {0, 3, 5}


def test_long_text_does_not_starve_its_class(spark):
    texts = [words(i, 30) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    ranked = [r.doc_id for r in labels.filter("toxic = 1").orderBy(F.xxhash64(F.lit("sample"), "doc_id")).collect()]
    texts[ranked[0]] = words(99, 3000)
    got, y = toxicity.training_sample(docs(spark, texts), labels, "toxic", F.lit(True), chars=6000)
    assert sum(y) == 9 and len(y) == 19 and texts[ranked[0]] not in got
    whole, y = toxicity.training_sample(docs(spark, texts), labels, "toxic", F.lit(True), chars=10**6)
    assert sorted(whole) == sorted(texts) and sum(y) == 10
    with pytest.raises(ValueError):
        toxicity.training_sample(docs(spark, texts), labels, "toxic", F.lit(True), chars=8)


def test_long_text_has_the_windows_of_the_unsplit_path(monkeypatch):
    text = " ".join(["la.la", "x!", "y", "y"] * 15_000) + " " + words(3, 60_000, 10**5)
    weight = np.random.default_rng(1).normal(size=toxicity.ROWS)
    split = toxicity.window_logits(text, weight)
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 1 << 40)
    assert np.allclose(split, toxicity.window_logits(text, weight), rtol=0, atol=1e-9)


def test_dedup_stages_drop_rows_and_not_ids(spark):
    a, b, c = words(1, 60, 10**6), words(2, 60, 10**6), words(3, 60, 10**6)
    given = [(1, a), (1, b), (2, a), (4, c), (4, c), (None, c), (None, "n"), (None, "n")]
    df = spark.createDataFrame(given, "doc_id long, text string")
    for keep, first in (("largest", 2), ("smallest", 1)):
        want = [(first, a), (1, b), (4, c), (None, "n")]
        assert sorted(map(tuple, exact_dedup.drop_exact(df, keep=keep).collect()), key=str) == sorted(want, key=str)
    want = [(1, a), (1, b), (4, c), (None, "n")]
    assert sorted(map(tuple, near_dedup.drop_near(df).collect()), key=str) == sorted(want, key=str)


def test_benchmark_items_without_id_are_searched(spark):
    text = words(1, 100, 10**6)
    passage = " ".join(text.split()[20:40])
    bench = spark.createDataFrame([(None, passage), ("a", " ".join(text.split()[35:50]))], "item_id string, text string")
    df = docs(spark, [text, passage, words(2, 50, 10**6)])
    got = {r.doc_id: ([(s.start, s.end) for s in r.spans], r["items"]) for r in decontamination.find_contamination(df, bench).collect()}
    assert got == {0: ([(20, 50)], ["a"]), 1: ([(0, 20)], []), 2: ([], [])}
    assert [r.doc_id for r in decontamination.drop_contaminated(df, bench).collect()] == [2]


def test_rare_sources_stay_in_a_coarse_mix(spark):
    """Blocks of about 600 words; the rare sources have targets of less than one."""
    given = [(i, words(i, 300), "big") for i in range(100)] + [(100 + i, words(i, 20 + i), f"rare{i}") for i in range(6)]
    df = spark.createDataFrame(given, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(df, slots=50).collect()}
    assert all(got[100 + i].taken == got[100 + i].target == 3 * (20 + i) for i in range(6))
    assert abs(sum(got[i].taken for i in range(100)) - got[0].target) <= 1
    _, _, pieces = mixing.mixture(df, slots=50)
    assert all(0 <= r.slot < 51 for r in pieces.collect())
