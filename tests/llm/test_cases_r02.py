"""Clashing columns, repeated and null ids, foreign files, empty tables and brute-force versions that test_operators.py leaves out."""

import base64
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulemill.llm import chat, decontamination, exact_dedup, mixing, near_dedup, quality, simhash, toxicity, warc
from rulemill.llm.registry import queries
from tests.llm.test_operators import SF, docs, words

CLASH = ("_row", "_gone", "_hash", "_pick", "key", "h", "n", "label", "_text", "_id", "_y")


def crowded(df):
    """`df` with columns of the names that operators use inside."""
    for name in CLASH:
        df = df.withColumn(name, F.lit("mine"))
    return df


def test_chat_takes_tables_with_clashing_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    want = [(r.turn, r.role, r.text) for r in chat.canonical_turns(turns).collect()]
    for extra in ("system", "input", "prompt", "answer", "messages", "completion"):
        assert [(r.turn, r.role, r.text) for r in chat.canonical_turns(turns.withColumn(extra, F.lit("x"))).collect()] == want
    both = turns.withColumn("prompt", F.lit("p")).withColumn("response", F.lit("r"))
    assert [(r.turn, r.role, r.text) for r in chat.canonical_turns(both).collect()] == want
    assert chat.read_formatted(chat.format_turns(chat.canonical_turns(turns.limit(0)))).count() == 0
    lines = ['{"messages":[{"role":"user"},{"role":"user","content":"q"}],"system":"s"}', '{"prompt":"p","response":"r","system":"s","output":"o"}', '{"prompt":"p","response":"r","id":1}', "[]"]
    got = {}
    for r in chat.canonical_json_turns(spark.createDataFrame(list(enumerate(lines)), "conv_id long, record string")).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.mapping, r.role, r.text))
    assert got[0] == [("messages", "user", None), ("messages", "user", "q")]
    assert [x[:2] for x in got[1]] == [("system_prompt_response", x) for x in ("system", "user", "assistant")]
    assert got[2][0][0] == "prompt_response" and got[3][0][0] is None


def member(head, block):
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(("\r\n".join(["WARC/1.0", *head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + pack.flush()


def test_warc_reads_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    body = "<p>é</p>".encode() * 200_000
    sha = hashlib.sha256(body).hexdigest()
    parts = [
        member(["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields"], b"software: x\r\n"),
        member(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:2>", "WARC-Target-URI: http://a/%41?b=%25", "Content-Type: application/http;", " msgtype=response", f"WARC-Payload-Digest: sha-256:{sha}"], http + body),
        member(["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:3>", "WARC-Refers-To: <urn:uuid:2>", "Content-Type: application/http", "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()], http),
        member(["WARC-Type: resource", "WARC-Record-ID: <urn:uuid:4>", "WARC-Block-Digest: md5:" + hashlib.md5(b"abc").hexdigest()], b"abc"),
        member(["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:5>", "WARC-Refers-To: <urn:uuid:elsewhere>", "WARC-Payload-Digest: what:ever"], b""),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(parts))
    archives = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)], "archive string")
    got = {r.record_id[-2]: r for r in warc.read_archives(archives).collect()}
    assert [got[k].record_type for k in "12345"] == ["warcinfo", "response", "revisit", "resource", "revisit"]
    assert got["2"].target_uri == "http://a/%41?b=%25" and got["2"].payload_bytes == len(body) and got["2"].payload_digest == hashlib.sha1(body).hexdigest()
    assert got["3"].payload_bytes == len(body) and got["3"].payload_digest == got["2"].payload_digest and got["5"].payload_bytes is None
    assert [got[k].digest_ok for k in "12345"] == [None, True, None, True, None] and got["1"].page_id is None
    (tmp_path / "y.warc.gz").write_bytes(parts[3].replace(parts[3], member(["WARC-Type: resource", "WARC-Record-ID: <urn:uuid:6>", "WARC-Block-Digest: sha1:" + hashlib.sha1(b"b").hexdigest()], b"abc")))
    with pytest.raises(ValueError):
        warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/y.warc.gz",)], "archive string"))


def test_warc_keeps_urls_and_gives_unique_ids(spark, tmp_path):
    big = "x" * 1200
    pages = spark.createDataFrame([(1, "http://a/%20?q=%C3%A9", big), (1, "http://b/", big), (2, "u", big), (2, "v", big), (None, "u", "s"), (None, "v", "s")], "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w")).collect()
    assert len({r.record_id for r in rows}) == 6 and {r.target_uri for r in rows} == {"http://a/%20?q=%C3%A9", "http://b/", "u", "v"}
    ids = {r.record_id for r in rows}
    assert all(r.refers_to_id in ids and r.refers_to == 2 for r in rows if r.record_type == "revisit") and sum(r.record_type == "revisit" for r in rows) == 2


def test_decontamination_in_passes(spark, monkeypatch):
    text = words(1, 200, 10**6).split()
    items = [("a", text[10:30]), ("b", text[25:45]), ("a", text[100:112]), (None, text[150:170]), ("c", words(8, 30, 10**6).split()), ("b", text[25:45])]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id string, text string")
    df = spark.createDataFrame([(1, " ".join(text), "x"), (1, " ".join(text[:60]), "y"), (None, " ".join(text[:60]), "z"), (3, None, "z")], "doc_id long, text string, _row string")
    want = None
    for most in (10**6, 15, 50):
        monkeypatch.setattr(decontamination, "BLOCK_WORDS", most)
        got = sorted((str(r.doc_id), r.n_words, [(s.start, s.end) for s in r.spans], r["items"]) for r in decontamination.find_contamination(df, bench).collect())
        assert want is None or got == want
        want = got
        assert [tuple(r) for r in decontamination.drop_contaminated(df, bench).collect()] == [(3, None, "z")]
    assert ("1", 200, [(10, 45), (100, 112), (150, 170)], ["a", "b"]) in want and ("None", 60, [(10, 45)], ["a", "b"]) in want


def test_dedup_stages_keep_clashing_columns(spark):
    df = crowded(docs(spark, ["a b", "A b", None, "", words(1, 80), words(1, 80) + " x"]).drop("key", "_hash"))
    for drop, want in ((exact_dedup.drop_exact, {1, 3, 4, 5}), (near_dedup.drop_near, {0, 2, 4})):
        out = drop(df)
        assert out.columns == df.columns and {r.doc_id for r in out.collect()} == want and {r._gone for r in out.collect()} == {"mine"}
        assert drop(df.limit(0)).count() == 0


def test_drop_toxic_and_contaminated_cases(spark):
    bad = [words(i, 40) + (" horrid vilest rotten" if i % 2 else "") for i in range(80)]
    df = crowded(spark.createDataFrame([(i // 2, t) for i, t in enumerate(bad)] + [(None, "horrid vilest rotten"), (None, None), (7, "")], "doc_id long, text string"))
    model = toxicity.train(bad, [i % 2 for i in range(80)], min_docs=2)
    out = toxicity.drop_toxic(df, model)
    assert out.columns == df.columns
    left = [r.text for r in out.collect()]
    assert None in left and "" in left and not any("horrid" in (t or "") for t in left) and len(left) >= 40
    assert toxicity.drop_toxic(df.limit(0), model).count() == 0
    bench = spark.createDataFrame([(1, " ".join(bad[0].split()[5:20]))], "item_id long, text string")
    out = decontamination.drop_contaminated(df, bench)
    assert out.columns == df.columns and bad[0] not in [r.text for r in out.collect()] and out.count() == df.count() - 1


def test_classifiers_on_empty_and_contradicting_labels(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 0), (3, 1), (4, None), (99, 1), (None, 1)], "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
    df = crowded(docs(spark, [words(i, 40) + " horrid" * (i % 2) for i in range(30)] + [words(5, 40_000)]).drop("key", "_hash"))
    texts, y = toxicity.training_sample(df, labels, "toxic", F.lit(True))
    assert len(texts) == 30 and sum(y) == 15
    for operator in (lambda d: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)), lambda d: quality.score_quality(quality.document_statistics(d), quality.fit_quality(quality.document_statistics(d), labels))):
        got = [r.score for r in operator(df).collect()]
        assert len(got) == 31 and all(0 <= s <= 1 for s in got)
        assert operator(df.limit(0)).count() == 0


def test_toxicity_forward_pass_against_plain_python():
    rng = np.random.default_rng(3)
    weight = rng.normal(size=toxicity.ROWS)
    text = "The the Loser. loser, l.o.s.e.r ÉÉ naïve x " + words(4, 57)

    def row(gram):
        h = ord(gram[0])
        for c in gram[1:]:
            h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
        return (h * 0xD6E8FEB86659FD93 % 2**64) >> (64 - toxicity.BITS)

    clean = text.lower()
    for mark in toxicity.PAUSES:
        clean = clean.replace(mark, " ")
    own = [w for i, w in enumerate(clean.split()) if not i or w != clean.split()[i - 1]]
    want = []
    for i in range(0, len(own), toxicity.WINDOW):
        grams = [f" {w} "[j : j + n] for w in own[i : i + toxicity.WINDOW] for n in toxicity.GRAMS for j in range(len(w) + 3 - n)]
        want.append(sum(weight[row(g)] for g in grams) / max(len(grams), toxicity.LEAST))
    assert np.allclose(toxicity.window_logits(text, weight), want)


def test_quality_against_plain_numpy(spark):
    texts = [words(i, 60).capitalize() + "." for i in range(60)] + ["!! 9 " * (5 + i % 7) + str(i) for i in range(40)]
    y = [int(i < 60) for i in range(100)]
    stats = quality.document_statistics(docs(spark, texts))
    x = np.array([quality.statistics(t.encode()) for t in texts])
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score_quality(stats, quality.fit_quality(stats, labels)).collect()}
    density = []
    for c in (0, 1):
        own = x[np.array(y) == c]
        cov = np.cov(own.T, bias=True)
        cov = (1 - quality.SHRINK) * cov + quality.SHRINK * max(np.trace(cov) / len(cov), 1e-6) * np.eye(len(cov))
        diff = x - own.mean(0)
        density.append(math.log(len(own) / 100) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))
    want = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -50, 50)))
    assert np.allclose([got[i] for i in range(100)], want, atol=1e-9)


def test_mixing_takes_what_a_plain_schedule_takes(spark):
    df = docs(spark, [words(i, 20 + i % 60) for i in range(300)] + [None, ""])
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    order = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(7), "doc_id").alias("h")).collect()}
    source = {r.doc_id: r.source for r in df.collect()}
    for s in set(source.values()):
        own = sorted((d for d in source if source[d] == s), key=lambda d: ((order[d] >> 40) % mixing.BUCKETS, order[d]))
        end, at = math.ceil(got[own[0]].target - 1e-6), 0
        taken = dict.fromkeys(own, 0)
        while at < end:
            for d in own:
                taken[d] += max(0, min(got[d].size, end - at))
                at += got[d].size
        assert {d: got[d].taken for d in own} == taken


def test_simhash_takes_long_texts_and_clashing_columns(spark):
    long = words(1, 200_000, 10**5)
    df = crowded(docs(spark, [long, long + " x", "a", "A", None]).drop("key", "_hash"))
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


@pytest.mark.parametrize("name", ["op3_mixing", "op4_toxicity", "op5_simhash", "op7_quality", "op10_suffix_array_dedup"])
def test_queries_without_sql_answer_every_row(spark, name):
    given = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in queries()[name](spark, SF).collect()) == given


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    bad = [words(i, 40) + " horrid vilest rotten" * (i % 2) for i in range(60)]
    passage = words(77, 30, 10**6)
    given = [(i, t, "en", "s", len(t)) for i, t in enumerate(bad)] + [(100, "same text", "en", None, 9), (100, "Same Text", "en", "s", 9), (None, "same text", None, "s", 9), (None, None, None, None, None), (101, "", "en", "s", 0), (102, passage + " tail", "en", "s", 1), (102, passage + " tail", "en", "s", 1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame(given, kinds).write.parquet(f"{sf}/documents.parquet")
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    after = [docs_]
    for _, stage in pipeline.STAGES:
        after.append(stage(spark, after[-1], sf))
    sizes = [x.count() for x in after]
    texts = [[r.text for r in x.select("text").collect()] for x in after[:5]]
    assert sum("horrid" in (t or "") for t in texts[1]) == 0 and sizes[1] == 37
    assert len({(t or "").lower() for t in texts[2]}) == sizes[2] == 33
    assert sizes[3] == 33 and sizes[4] == 32 and passage + " tail" not in texts[4]
    assert sorted(after[5].columns) == ["doc_id", "size", "source_size", "taken", "target"] and sizes[5] == 32
    assert all(x.columns == docs_.columns for x in after[:5])
    empty = docs_.limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, empty, sf)
        assert out.count() == 0
