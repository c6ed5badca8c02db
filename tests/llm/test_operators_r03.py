"""Conversation repair, sharding and hard negatives: brute force, defined cases, the queries against their SQL."""

import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rulemill.llm import hard_negatives, repair, sharding
from tests.llm.test_cases_r02 import CLASH

GRAMMAR = re.compile(r"(s?(ua)+)?")


def every_repair(tokens, most):
    """(cost, audit) of all edits that cost at most `most` and give a legal sequence."""
    found = []

    def go(i, roles, audit, cost):
        if cost > most:
            return
        if i == len(tokens) and GRAMMAR.fullmatch(roles):
            found.append((cost, audit))
        for r in "ua":
            go(i, roles + r, audit + "I", cost + 5)
        if i == len(tokens):
            return
        t = tokens[i]
        go(i + 1, roles, audit + "D", cost + 2)
        if t != repair.BAD:
            more = 5 if t.isupper() else 0
            go(i + 1, roles + t.lower(), audit + "K", cost + more)
            for r in "ua":
                go(i + 1, roles + r, audit + "R", cost + 1 + more)

    go(0, "", "", 0)
    return min(found)


def test_parse_finds_the_cheapest_and_least_audit():
    rng = random.Random(5)
    cases = ["".join(t) for n in range(4) for t in itertools.product("suaoUAx", repeat=n)] + ["".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(4, 7))) for _ in range(150)]
    for tokens in cases:
        cost, audit, source, roles = repair.parse(tokens)
        assert (cost, audit) == every_repair(tokens, 2 * len(tokens)), tokens
        given = "".join(r[0] if r else tokens[at - 1].lower() for at, r in zip(source, roles, strict=True))
        assert GRAMMAR.fullmatch(given) and len(source) == len(audit) - audit.count("D")
    assert repair.parse("ua" * 20_000)[:2] == (0, "K" * 40_000)


def test_repair_cases(spark):
    rows = [
        (1, 0, "user", "Q?"), (1, 1, "assistant", "A."), (1, 1, "assistant", "A."), (1, 3, "user", "  \t"),
        (2, None, "system", "Be kind."), (2, 5, "user", None), (2, 7, None, "Hm!"),
        (None, 0, "user", "one."), (None, 1, "assistant", "cut"),
        (3, 2, "user", "x" * 300_000 + "."), (3, 3, "assistant", "y. \t"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    crowded = df
    for name in (*CLASH, "fault", "token", "_t", "_p", "is_turn_"):
        crowded = crowded.withColumn(name, F.lit("mine"))
    got = {r.conv_id: r for r in repair.repair_turns(crowded).collect()}
    assert [tuple(x) for x in got[1].repaired] == [("user", "Q?"), ("assistant", "A.")]
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].truncated, got[1].illegal, got[1].cost, got[1].audit) == (1, 1, 1, 0, 1, 4, "KKDD")
    # Three rows: a system turn, a blank user's (null text), and one with a null role.
    assert (got[2].gaps, got[2].blank, got[2].illegal, got[2].cost, got[2].audit) == (1, 1, 1, 4, "RDR") and [tuple(x) for x in got[2].repaired] == [("user", "Be kind."), ("assistant", "Hm!")]
    assert (got[None].truncated, got[None].cost, got[None].audit) == (1, 4, "DD")
    assert (got[3].truncated, got[3].cost, got[3].audit, len(got[3].repaired[0].text)) == (0, 0, "KK", 300_001)
    named = spark.createDataFrame([(9, None, None, None, False)], "conv_id long, turn long, role string, text string, is_turn boolean")
    (r,) = repair.repair_turns(named).collect()
    assert (r.gaps, r.blank, r.cost, r.audit, r.repaired) == (0, 0, 0, "", [])
    assert repair.repair_turns(df.limit(0)).count() == 0
    kinds = [zlib.crc32(f"{c if c is not None else ' '}:{t if t is not None else ' '}".encode()) % 20 for c, t, _, _ in rows]
    hurt = repair.damaged(df).filter("is_turn").count()
    assert hurt == sum(0 if k == 0 else 2 if k == 3 else 1 for k in kinds)


def doc_rows(spark, n, seed=0):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", "é", "word " * rng.randrange(9), None]), rng.choice(["big", "big", "big", "b", "c", None])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("n", [0, 3, 8, 997])
def test_shards_are_even_and_match_the_mixture(spark, n):
    df = doc_rows(spark, n)
    got = sharding.places(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == n and all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(k, [])) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    source = {r.doc_id: r.source for r in df.collect()}
    for name in set(source.values()):
        own = [sum(source[r._id] == name for r in got if r.shard == k) for k in range(8)]
        assert max(own) - min(own) <= 3
    again = {r._id: (r.shard, r.slot) for r in sharding.places(df.repartition(3)).collect()}
    assert again == {r._id: (r.shard, r.slot) for r in got}
    text = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    assert all((r.size, r.crc) == (len(text[r._id]) + 1, zlib.crc32(text[r._id])) for r in got)


def test_shards_of_copies_null_ids_and_clashing_columns(spark, tmp_path):
    rows = [(None, "same", "s")] * 40 + [(7, "same", "s")] * 25 + [(i, "x" * 200_000, None) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in (*CLASH, "shard", "slot"):
        df = df.withColumn(name, F.lit("mine"))
    out = sharding.shard_rows(df)
    assert out.columns == [*df.columns, "_shard", "_slot"] and out.filter("shard = 'mine' and _row = 'mine'").count() == 70
    sharding.write_shards(df.drop("shard", "slot"), f"file://{tmp_path}/out", 4)
    for k in range(4):
        files = sorted((tmp_path / "out" / f"shard={k}").glob("*.parquet"))
        slots = [r.slot for f in files for r in spark.read.parquet(f"file://{f}").select("slot").collect()]
        assert slots == list(range(len(slots))) and 17 <= len(slots) <= 18


def plain_negatives(rows, every=50):
    """The contract in plain Python over (vec_id, vector, label)."""
    use = []
    for i, (v, x, label) in enumerate(rows):
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        use.append((i, v, (label + 1) % 10 if v is not None and v % 7 == 0 else label, [math.floor(256 * c) for c in x]))
    score = lambda a, b: sum(p * q for p, q in zip(a, b))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for i, v, label, x in use:
        if v is None or v % every:
            continue
        met = [(score(x, y), w, j, other) for j, w, other, y in use if j != i]
        for p in sorted((m for m in met if m[3] == label), key=order)[:5]:
            near = sorted((m for m in met if m[3] != label and 50 * p[0] <= 100 * m[0] <= 95 * p[0]), key=order)[:3]
            out += [(v, p[1], k + 1, m[1], p[0], m[0]) for k, m in enumerate(near)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("scale", [0.3, 30.0, 1e6])
def test_negatives_equal_brute_force(spark, scale):
    """Ties, copies of one vector over a third of all rows, null ids, labels, vectors and components, and repeated rows."""
    rng = random.Random(int(scale * 10))
    vector = lambda: [rng.choice([-1, 0, 0.5, 1, rng.random()]) * scale for _ in range(6)]
    same = vector()
    rows = [(i, same if i % 3 == 0 else vector(), rng.choice([0, 0, 0, 1, 2, None])) for i in range(420)]
    rows += [(50, same, 0), (50, same, 0), (None, same, 0), (None, vector(), 1), (1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")] * 6, 1), (1050, [float("inf")] + [0.0] * 5, 0), (1100, [], 1), (1150, vector()[:3], 0), (1151, vector() + [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("q", "v", "id", "_p", "_s", "width", "anchor"):
        df = df.withColumn(name, F.lit("mine"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(df.coalesce(1), F.col("vec_id") % 50 == 0, label=label).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_negatives(rows)
    assert len({r.anchor_id for r in got}) > 5
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(df.limit(1), F.col("vec_id") % 50 == 0).count() == 0


def test_selection_refines_crowded_buckets(spark):
    """Scores that share their leading digits: the kth place is found only by the last digit, and ties at it go by id."""
    rows = [(0, [1.0, 0.0], 0)] + [(i, [1000 + (i % 900) / 256, 0.0], 0) for i in range(1, 1500)] + [(i, [700 + (i % 5) / 256, 0.0], 1) for i in range(1500, 3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives.mine(df, F.col("vec_id") == 0).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_negatives([(v, x, y if v % 7 else (y + 9) % 10) for v, x, y in rows], every=10**9)
