"""The stored index and the versioned store: pruning, replacement by document, failures in the middle, the build log."""

import pytest
from pyspark.sql import functions as F

from rulemill.operators import chunking, index, search
from rulemill.sources import versions

COLUMNS = "section_id long, slug string, corpus string, section_key string, citation_label string, heading string, path array<string>, content string"


def section(i, slug, heading, content):
    return (i, slug, "c", f"{slug}-{i}", f"{slug} {i}", heading, [slug, heading], content)


def corpus_of(spark, n=400):
    rows = [section(i, "one" if i % 2 else "two", f"Heading {i}", f"common words unique{i} and lexeme{i % 50} here") for i in range(n)]
    return spark.createDataFrame(rows, COLUMNS)


def chunks_of(s):
    return chunking.blocks(s).select("section_id", F.col("block").alias("chunk_index"), F.col("text").alias("content"))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, q string").withColumn("corpus_filter", F.lit(None).cast("string"))


def results(df):
    return sorted((r.query_id, r.place, r.section_id, round(r.overall_rank, 6)) for r in df.collect())


def test_stored_index_prunes_and_equals_a_fresh_one(spark, tmp_path):
    s = corpus_of(spark)
    path = f"file://{tmp_path}/index"
    assert index.write_index(s, path, chunks_of(s), block_bytes=1 << 10) == 1
    stored = index.open_index(spark, path)
    q = asked(spark, "unique7", "common lexeme3", '"heading 12"', "nique39", "le", "one > heading 11", "absent", "")
    assert results(search.search_ranked(None, None, q, index=stored)) == results(search.search_ranked(s, chunks_of(s), q))
    assert results(search.search(None, q, index=stored)) == results(search.search(s, q))
    rows = index.looked_up(stored.postings, "lexeme", spark.createDataFrame([("unique7",)], "lexeme string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "lexeme" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert rows.count() == 1
    read = rows.select("lexeme")._jdf.queryExecution().executedPlan()
    read.executeCollect()
    scans = read.collectLeaves()
    scanned = scans.apply(0).metrics().apply("numOutputRows").value()
    assert 0 < scanned < 0.2 * stored.postings.count()


def test_only_a_changed_documents_postings_change(spark, tmp_path):
    s = corpus_of(spark, 60)
    path = f"file://{tmp_path}/index"
    index.write_index(s, path, chunks_of(s))
    files = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "index").rglob("*.parquet")}
    new = s.filter("slug = 'one'").filter("section_id < 20").withColumn("content", F.lit("fresh text"))
    assert index.write_index(new, path, chunks_of(new)) == 2
    assert all(str(p) not in files or p.stat().st_mtime_ns == files[str(p)] for p in (tmp_path / "index").rglob("*.parquet"))
    added = [p for p in (tmp_path / "index" / "postings").rglob("*.parquet") if str(p) not in files]
    assert {r.slug for r in spark.read.parquet(*[f"file://{p}" for p in added]).select("slug").distinct().collect()} == {"one"}
    whole = s.filter("slug = 'two'").unionByName(new)
    q = asked(spark, "fresh", "common", "unique7", "unique8", "heading")
    for _ in range(2):
        got = results(search.search_ranked(None, None, q, index=index.open_index(spark, path)))
        assert got == results(search.search_ranked(whole, chunks_of(whole), q))
        versions.compact(spark, path, list(index.TABLES), {k: list(v) for k, v in index.TABLES.items()})
    assert len(versions.current(spark, path)["batches"]) == 1


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = lambda *x: spark.createDataFrame(list(x), "document string, v int")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path, "t")
    versions.publish(spark, path, {"t": rows(("a", 1), ("b", 1)), "u": rows(("a", 10))})
    bad = rows(("a", 2)).withColumn("v", F.expr("assert_true(v < 0, 'stop')").cast("int"))
    with pytest.raises(Exception, match="stop"):
        versions.publish(spark, path, {"t": rows(("a", 2)), "u": bad})
    assert sorted(map(tuple, versions.read(spark, path, "t").collect())) == [("a", 1), ("b", 1)]
    versions.publish(spark, path, {"t": rows(("a", 3), ("a", 4), (None, 5)), "u": rows(("c", 30))})
    assert sorted(map(tuple, versions.read(spark, path, "t").collect()), key=str) == [("a", 3), ("a", 4), ("b", 1), (None, 5)]
    # Document a is replaced in every table: it has no row in u any more.
    assert [tuple(r) for r in versions.read(spark, path, "u").collect()] == [("c", 30)]
    (tmp_path / "store" / "_pointers" / "000000000003").write_text("{")
    assert versions.current(spark, path)["version"] == 2
    with pytest.raises(Exception):  # noqa: B017
        versions._point(spark, path, {"version": 2})


def test_builds_are_logged_around_the_job(spark, tmp_path):
    s, log, path = corpus_of(spark, 30), f"file://{tmp_path}/log", f"file://{tmp_path}/sections"
    versions.ingest_sections(spark, path, log, s, source="pages")
    versions.ingest_chunks(spark, f"file://{tmp_path}/chunks", log, s)
    with pytest.raises(Exception, match="broken"):
        versions.ingest_sections(spark, path, log, s.withColumn("content", F.expr("assert_true(section_id < 7, 'broken')").cast("string")))
    assert versions.read(spark, path, "sections").count() == 30
    one = versions.read(spark, path, "sections").filter("slug = 'one'").orderBy("ordinal").collect()
    assert [r.ordinal for r in one] == list(range(1, 16)) and len({r.build_id for r in one}) == 1
    states = sorted(versions.build_states(spark.read.parquet(log)).collect(), key=lambda r: r.started_at)
    assert [(r.build_type, r.status) for r in states] == [("ingest_sections", "completed"), ("chunk_sections", "completed"), ("ingest_sections", "failed")]
    assert states[0].metadata == {"source": "pages", "insertedSections": "30"} and states[1].metadata["insertedChunks"] == "30"
    assert "broken" in states[2].notes and all(r.completed_at >= r.started_at for r in states)
