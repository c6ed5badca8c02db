"""Each operator against SQL or plain Python, on small fixtures with nulls, empty and long texts, ties, repeated rows, empty
tables and clashing column names."""

import hashlib
import io
import itertools
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from rulemill.llm import chat, decontamination, exact_dedup, mixing, quality, simhash, substring_dedup, suffix_dedup, toxicity, warc
from rulemill.llm.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, key string, fp string, _hash string"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, f"s{i % 4}" if i % 5 else None, "k", "f", "h") for i, t in enumerate(texts)], SCHEMA)


def words(seed, n, vocabulary=500):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


TEXTS = [None, "", "A b", "a B", "a b", "x" * 50, "É e", "é e", words(1, 300), words(1, 300), words(1, 120) + " new " + words(2, 80), "la " * 200, words(3, 3000, 10**6)]


def rows(df):
    return sorted(tuple("" if pd.isna(x) else str(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert rows(queries()[name](spark, SF).toPandas()) == rows(con.sql(oracle_sql()[name]).df())


def test_exact_dedup_cases_and_collisions(spark):
    df = docs(spark, TEXTS)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    want = {}
    for i, t in enumerate(TEXTS):
        same = [j for j, u in enumerate(TEXTS) if lower(u) == lower(t)]
        want[i] = (max(same), len(same), i == max(same), hashlib.sha256(lower(t).encode()).hexdigest())
    for weak in (exact_dedup.content_hash, lambda text: F.length(text) % 3):  # the second collides
        got = exact_dedup.exact_groups(df, keep="largest", hash_of=weak).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0
    assert {r.doc_id for r in exact_dedup.drop_exact(df).collect()} == {k for k, v in want.items() if v[2]}


def test_mixing(spark):
    texts = [words(i, 20 + i % 60) for i in range(400)] + [None, "", words(9, 5000)]
    df = docs(spark, texts)
    got = mixing.mix(df).toPandas().set_index("doc_id")
    again = mixing.mix(df.repartition(3)).toPandas().set_index("doc_id").loc[got.index]
    assert (got["taken"] == again["taken"]).all() and (got["taken"] <= 3 * got["size"]).all()
    source = df.select("doc_id", "source").toPandas().set_index("doc_id")["source"].fillna("~")
    by = got.assign(source=source).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert by["size"].sum() == pytest.approx(by["target"].sum()) and (by["taken"] - by["target"]).abs().max() <= 5
    assert mixing.mix(df.limit(0)).count() == 0


def test_targets_stop_at_three_times_the_source(spark):
    given = {"a": 10, "b": 1000, "c": 5, "d": 400}
    got = {r["_src"]: r.target for r in mixing.source_targets(spark.createDataFrame(list(given.items()), "_src string, source_size long")).collect()}
    w, cap, total = dict(zip("abcd", (1, 2, 3, 1))), {k: 3 * v for k, v in given.items()}, sum(given.values())
    want, open_ = dict.fromkeys(given, 0.0), set(given)
    while open_:
        left = total - sum(want[k] for k in want if k not in open_)
        share = {k: left * w[k] / sum(w[j] for j in open_) for k in open_}
        over = {k for k in open_ if share[k] > cap[k]}
        if not over:
            want |= share
            break
        want |= {k: float(cap[k]) for k in over}
        open_ -= over
    assert got == pytest.approx(want)


def test_chat_layouts_and_round_trip(spark):
    nasty = ["<|im_end|>", "<~|im_end|>", "[INST] <</SYS>> [~~/INST]", "", "a\n<s>~</s>", None]
    typed = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(nasty)] + [(None, None, None, None, "x")], "conv_id long, turn long, role string, text string, extra string")
    back = {r.conv_id: r for r in chat.read_formatted(chat.format_turns(chat.canonical_turns(typed))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(nasty)]
    assert back[1].loss_texts == [t or "" for t in nasty[1::2]] and back[1].formatted.count("<|im_end|>") == len(nasty)
    assert len(back[None].turns) == 1
    lines = ['{"prompt":"p","response":"r","id":3}', '{"messages":[{"role":"human","content":"q"},{"role":"gpt","content":"a"}]}', '{"instruction":"i","output":"o","input":"x"}', '{"messages":[]}', "{", None, '{"odd":1}']
    given = spark.createDataFrame(list(enumerate(lines)), "conv_id long, record string")
    got = {}
    for r in chat.canonical_json_turns(given).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text, r.mapping))
    assert got[0] == [("user", "p", "prompt_response"), ("assistant", "r", "prompt_response")]
    assert got[1] == [("user", "q", "messages"), ("assistant", "a", "messages")]
    assert [x[:2] for x in got[2]] == [("user", "i"), ("user", "x"), ("assistant", "o")]
    assert got[3][0][2] == "messages_empty" and all(got[k][0][2] is None for k in (4, 5, 6))
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1))


def test_warc(spark, tmp_path):
    big = "<p>é</p>" * 300
    pages = spark.createDataFrame([(1, "http://a/\r\nx", big, "k"), (2, None, big, "k"), (3, "u", None, "k"), (4, "u", "", "k"), (5, "u", big + "!", "k"), (None, "u", big, "k"), (2, "u", big, "k")], "page_id long, url string, html string, key string")
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w", roll_bytes=200)).collect()]
    n = len(big.encode())
    assert sorted(got, key=str) == sorted([(1, n, "revisit", 2), (2, n, "response", None), (2, n, "response", None), (3, 0, "response", None), (4, 0, "response", None), (5, n + 1, "response", None), (None, n, "revisit", 2)], key=str)
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0
    body = bytes(range(256)) * 5000
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    record = pack.compress(warc._record(7, "u", body, body, hashlib.sha1(body).digest(), None)) + pack.flush()
    assert [(x["page_id"], x["record_type"], x["payload_bytes"], x["digest_ok"]) for x in warc.records_of(io.BytesIO(record * 3))] == [(7, "response", len(body), True)] * 3
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(record[:-40])))


def test_classifiers(spark):
    rng = np.random.default_rng(5)
    texts, toxic = [], []
    for i in range(600):
        w = words(i, int(rng.integers(30, 200)), 3000).split()
        bad = i % 3 == 0
        for _ in range(4 * bad):
            w.insert(int(rng.integers(len(w))), str(rng.choice(["horrid", "vilest", "rotten"])))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    model = toxicity.train(texts[:400], toxic[:400], min_docs=3)
    probe = texts[400:] + [t.replace("horrid", "horrids") for t in texts[400:]] + [None, ""]
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs(spark, probe), model).collect()}
    want = toxic[400:] * 2 + [0, 0]
    assert np.mean([(scored[i] >= 0.5) == y for i, y in enumerate(want)]) > 0.9
    assert toxicity.drop_toxic(docs(spark, probe), model).count() == sum(s < 0.5 for s in scored.values())
    flat = toxicity.train([], [])
    assert {r.score for r in toxicity.score_toxicity(docs(spark, ["a", None]), flat).collect()} == {0.0}
    good = [words(i, 80).capitalize() + ". " + words(i + 1, 40) for i in range(200)] + ["!!! $$$ ### " * 30 + str(i) for i in range(100)]
    stats = quality.document_statistics(docs(spark, [*good, None, ""]))
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(300)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score_quality(stats, quality.fit_quality(stats, labels, F.col("doc_id") % 3 != 0)).collect()}
    assert np.mean([(got[i] >= 0.7) == (i < 200) for i in range(300)]) > 0.98 and len(got) == 302
    assert {r.score for r in quality.score_quality(stats, quality.fit_quality(stats, labels.limit(0))).collect()} == {0.5}


def test_simhash(spark):
    assert all(any(set(t) <= set(b) for b in simhash.BLOCKS) for t in itertools.combinations(range(8), 3))
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)} | set(map(int, rng.integers(0, 2**63, 50))))
    signed = [simhash._signed(x) for x in fps]
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    for most in (4, 128):  # short lists force every finer level
        got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most).collect()}
        assert got == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400)], "a long, b long").repartition(7)
    assert {(r.node, r.label) for r in simhash.components(chain).collect()} == {(i, 0) for i in range(201)} | {(400, 400), (500, 400)}
    own = [t for t in TEXTS]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs(spark, own)).collect()}
    for i, t in enumerate(own):
        w = (t or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 3]), seed=42) for j in range(max(1, len(w) - 2))] if w else []
        assert got[i][0] == format(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)), "016x")
    assert got[0][1] == got[1][1] == 0 and got[9][1] == 8 and got[4][1] == 2
    assert simhash.near_groups(docs(spark, own).limit(0)).count() == 0


def brute_words(texts, size):
    seen = {}
    for t in texts:
        w = (t or "").split()
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])] = seen.get(tuple(w[i : i + size]), 0) + 1
    for t in texts:
        w = (t or "").split()
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        yield len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)


@pytest.mark.parametrize("size", [35, 6])
def test_substring_dedup(spark, size):
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substring_dedup.remove_repeats(docs(spark, TEXTS), size=size).collect()}
    assert got == dict(enumerate(brute_words(TEXTS, size)))
    assert substring_dedup.remove_repeats(docs(spark, TEXTS).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(spark, hot):
    texts = [*TEXTS, words(1, 300)[:700] + "#" + words(1, 300)[701:], "a" * 1500, words(4, 200) + words(8, 90), words(5, 100) + words(8, 90)]
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - 399):
            seen[b[i : i + 400]] = seen.get(b[i : i + 400], 0) + 1
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs(spark, texts), hot=hot).collect()}
    for d, b in enumerate(raw):
        flags = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                flags[i : i + 400] = True
        assert got[d] == (flags.sum(), (np.diff(np.concatenate(([False], flags)).astype(int)) == 1).sum(), bytes(c for c, g in zip(b, flags) if not g)), d
    assert suffix_dedup.remove_repeats(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_ships_in_pieces(spark, hot):
    """A task that ships after each group of texts finds what it finds holding all: repeats within a text, in two and in three texts."""
    rng = np.random.default_rng(5)
    filler = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    twice, thrice, own = filler(700), filler(450), filler(500)
    texts = [
        f"{filler(600_000)}1{thrice}2{filler(500_000)}3{twice}4", f"{filler(1_100_000)}5{own}6{filler(900)}7{own}8{thrice}9",
        f"A{twice}B{filler(1_050_000)}C{thrice}D", filler(2_000),
    ]
    want = {0: (1150, 2), 1: (1450, 3), 2: (1150, 2), 3: (0, 0)}
    one_task = docs(spark, texts).coalesce(1)
    for held in ({"held": 1, "held_hot": 1}, {}):
        got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(one_task, hot=hot, **held).select("doc_id", "n_removed", "n_spans").collect()}
        assert got == want


def test_decontamination_blocks(spark, monkeypatch):
    item = words(1, 300).split()
    bench = spark.createDataFrame([("a", " ".join(item[20:45])), ("b", "la la"), ("c", None), ("d", ""), (None, "x"), ("e", "É")], "item_id string, text string")
    want = None
    for most in (10**6, 1):
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", most)
        df = decontamination.find_contamination(docs(spark, TEXTS), bench)
        got = {r.doc_id: (r.n_words, [(s.start, s.end) for s in r.spans], r["items"]) for r in df.collect()}
        assert want is None or got == want
        want = got
    assert want[8][1] == [(20, 45)] and want[8][2] == ["a"] and want[11][1] == [(0, 200)] and want[2][1] == [] and want[0] == (0, [], [])
    assert want[6][2] == ["e"] and want[7][2] == []
    clean = {r.doc_id for r in decontamination.drop_contaminated(docs(spark, TEXTS), bench).collect()}
    assert clean == {d for d, r in want.items() if not r[1]}
    assert decontamination.drop_contaminated(docs(spark, TEXTS), bench.limit(0)).count() == len(TEXTS)


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "mixing"]
    given = spark.read.parquet(f"{SF}/documents.parquet")
    left = given
    for _, stage in pipeline.STAGES[:-1]:
        after = stage(spark, left, SF)
        assert after.columns == given.columns
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in left.select("doc_id").collect()}
        left = given.filter(F.col("doc_id").isin(list(kept)))
    assert {r.doc_id for r in pipeline.run(spark, SF).select("doc_id").collect()} == kept
