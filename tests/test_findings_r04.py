"""Cases of the fourth round's findings."""

from pyspark.sql import functions as F

from rulemill.functions import text as T
from rulemill.plans import catalog_rules

HEADED = ["ßau der straße", "ﬁne ŉ ǰ ᾳ-ᾀ", "ÖTZÄ ΑΣ İt", "plain heading-here OF the"]


def test_titles_of_letters_without_a_single_capital_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    rows = [(i, f"{h}\nsecond line", "en", "src", 1) for i, h in enumerate(HEADED)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog_rules.q_headings(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(catalog_rules.SQL["q_headings"]).fetchall())
    assert [r[2] for r in got] == ["ẞau Der Straße", "ﬁne ŉ ǰ ᾼ-ᾈ", "Ötzä Ασ It", "Plain Heading-Here of the"]
    assert spark.range(1).select(T.simple_upper(F.lit("é"))).first()[0] == "É"


ASKED = ["alpha", "alpha beta", "beta or gamma alpha", '"alpha beta"', "alpha -gamma", "x-ray alpha", "Head 1", "en", "e", "", "closed the door", "doors", "gamma gamma", "-alpha", "12/7", "0/3", None]


def corpus_and_queries(spark):
    words = ["alpha", "beta", "gamma", "the", "x-ray", "doors", "closing the door", "\n(a) clause", "\n\nHeading here\n"]
    text = lambda i: " ".join(words[(i * k * k + k) % len(words)] for k in range(1, 4 + i % 23))
    rows = [(i, f"s{i % 3}" if i % 11 else None, "en" if i % 2 else "fr", str(i), f"{i // 100}/{i % 100}", f"Head {i % 5}" if i % 3 else None, ["en", f"s{i % 3}", f"Head {i % 5}"][: 3 if i % 3 else 2], text(i)) for i in range(700)]
    s = spark.createDataFrame(rows, "section_id long, slug string, corpus string, section_key string, citation_label string, heading string, path array<string>, content string")
    asked = [(i * 3 + j, q, c) for i, q in enumerate(ASKED) for j, c in enumerate((None, "en", None))]
    return s, spark.createDataFrame(asked, "query_id int, q string, corpus_filter string")


def test_texts_read_without_an_index_have_the_pages_of_an_index(spark, monkeypatch):
    from rulemill.operators import chunking, index, scan, search

    s, q = corpus_and_queries(spark)
    named = s.filter("slug is not null")  # the index path leaves out clusters without a document
    columns = ["query_id", "place", "section_id", "overall_rank", "cluster_support", "total", "has_more", *search.FLAGS, *scan.RANKS]
    chunks = chunking.blocks(named).select("section_id", F.col("block").alias("chunk_index"), F.col("text").alias("content"))
    rows = lambda df, names: sorted(tuple(r) for r in df.select(*names).collect())
    want = rows(search.search_ranked(named, chunks, q, 7, 2), columns)
    assert len(want) > 200
    assert rows(search.search_ranked(named, chunking.block_texts(F.col("content")), q, 7, 2), columns) == want
    plain = columns[: -len(scan.RANKS)]
    assert rows(search.search(s, q, 4, 1), plain) and rows(search.search(named, q, 4, 1), plain) == rows(search.search(None, q, 4, 1, index.fresh_index(named, parts=index.SUBSTRINGS)), plain)
    # Several readings of the texts, small slices, and workers that leave out rows all the time change nothing.
    monkeypatch.setattr(scan, "BLOCK_CHARS", 60)
    assert rows(search.search_ranked(named, chunking.block_texts(F.col("content")), q, 7, 2), columns) == want


def test_a_ranked_search_stores_no_postings_and_no_chunks(spark, monkeypatch, tmp_path):
    from rulemill.operators import index
    from rulemill.plans import catalog_rules

    spark.createDataFrame([(1, "Head\nalpha beta", "en", "src", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, "user", "beta?")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    staged, stage = [], index.stage
    monkeypatch.setattr(index, "stage", lambda df, tag: (staged.append(tag), stage(df, tag))[1])
    assert [(r.query_id, r.section_id) for r in catalog_rules.q_search_ranked_en(spark, str(tmp_path)).orderBy("query_id").collect()] == [(1, 1), (1001000, 1)]
    assert not {"postings", "chunk-postings", "strings", "lexemes", "base", "met"} & set(staged)


def test_workers_leave_out_only_what_no_page_can_have(spark):
    import numpy as np
    import pyarrow as pa

    from rulemill.operators import scan

    rng = np.random.default_rng(4)
    n, wanted = 4000, 5
    clusters = rng.choice([*range(6), *range(100, 3000)], n, p=[0.1] * 6 + [0.4 / 2900] * 2900)
    sections = pa.RecordBatch.from_pydict({"section_id": np.arange(n), "slug": ["s"] * n, "corpus": ["c"] * n, "citation_label": [f"{x % 7}" for x in range(n)], "path_text": [""] * n, "cluster_key": [str(c) for c in clusters], "bucket": clusters})
    sizes = np.minimum(np.bincount(clusters, minlength=3000), 4).astype(np.uint8)
    got = {"query": rng.integers(0, 3, n), "row": np.arange(n)} | {f: rng.random(n) < 0.1 for f in scan.FLAGS} | {r: rng.integers(0, 3, n) / 10 for r in scan.RANKS} | {"signal": rng.random(n) < 0.3}
    page = scan.Page(wanted, np.maximum(sizes, 1))
    for i in range(0, n, 500):
        page.add(sections.slice(i, 500), {k: (v[i : i + 500] if k != "row" else v[i : i + 500] - i) for k, v in got.items()})
        page.cut()
    assert page.held < n / 4
    kept = {(q, i) for q, i in zip(page.rows[0]["query"].to_pylist(), page.rows[0]["section_id"].to_pylist(), strict=True)}
    support = {(q, c): int((got["signal"] & (got["query"] == q) & (clusters == c)).sum()) for q in range(3) for c in set(clusters.tolist())}
    own = np.array([support[q, c] for q, c in zip(got["query"].tolist(), clusters.tolist(), strict=True)])
    rank = scan.overall(got, own)
    for q in range(3):
        of = [i for i in range(n) if got["query"][i] == q]
        key = lambda i: (-rank[i], not got["exact_heading"][i], -got["heading_rank"][i], -got["path_rank"][i], -own[i], -got["body_rank"][i], -got["section_rank"][i], -got["chunk_phrase_rank"][i], -got["chunk_rank"][i], f"{i % 7}", i)
        assert {(q, i) for i in sorted(of, key=key)[:wanted]} <= kept


def test_paged_search_is_that_of_its_sql_where_documents_have_no_source(spark, tmp_path):
    import duckdb

    from rulemill.plans import catalog

    docs = [(i, f"{'Head' if i % 3 else 'a ' * 60} {i % 4}\nword{i % 5} other", "en" if i % 2 else "de", None if i % 4 == 0 else f"src{i % 3}", 1) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(("head 1", "word2 x", "e n", "src1 >", "en > src1 > Head", "or other"))], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = [tuple(r) for r in catalog.q_search_paged(spark, str(tmp_path)).collect()]
    want = con.execute(catalog.SQL["q_search_paged"]).fetchall()
    assert len(want) > 30 and sorted(got) == sorted(want)


def test_rounds_over_arrays_of_chunks_are_those_over_a_table_of_chunks(spark, monkeypatch):
    from rulemill.operators import assistant, chunking, index
    from rulemill.plans.registry import registry

    heads = ["Closure motion", "Acceptance of closure motion", "Points of order", "Relevancy", "Withdrawal", "Alpha rules"]
    rows = [(i, "standing_orders" if i % 2 else "speakers_rulings", "standing_orders" if i % 2 else "speakers_rulings", str(i), f"1/{i}", heads[i % 6], ["Chapter 1", "Closure of debate", heads[i % 6]], f"The closure motion {i} may be put. alpha rules\n\n(a) It must not be done.") for i in range(30)]
    s = spark.createDataFrame(rows, "section_id long, slug string, corpus string, section_key string, citation_label string, heading string, path array<string>, content string")
    questions = spark.createDataFrame([(1, "may the question be put", ["closure motion", "alpha"], ["premature"], None), (2, "a point of order", ["rules"], [], "standing_orders")], "question_id long, question string, planned array<string>, terms array<string>, corpus string")
    table = chunking.blocks(s).select("section_id", F.col("block").alias("chunk_index"), F.col("text").alias("content"))
    reg = registry(spark)
    names = {"selected": ("question_id", "place", "section_id"), "bridge": ("question_id", "place", "query"), "recovery": ("question_id", "place", "query", "corpus"), "searches": ("question_id", "query_index", "query"), "results": ("question_id", "query_index", "place", "section_id", "rank")}
    shown = lambda r: {k: sorted(map(tuple, r[k].select(*c).collect()), key=str) for k, c in names.items()}
    want = shown(assistant.answer_rounds(questions, s, table, reg))
    assert want["selected"] and want["results"]
    monkeypatch.setattr(index, "fresh_index", None)
    assert shown(assistant.answer_rounds(questions, s, chunking.block_texts(F.col("content")), reg)) == want
