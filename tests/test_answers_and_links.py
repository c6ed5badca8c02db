"""Answers as HTML, debug reports, links by selectors, sessions of the query log."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rulemill.functions import answer_text as H
from rulemill.sources import pages
from rulemill.streaming import query_log


def html(spark, text, **options):
    return spark.createDataFrame([(text,)], "t string").select(H.answer_html(F.col("t"), **options)).first()[0]


def test_answer_html(spark):
    text = "Bottom line: yes & no [22/5, see 3/4A, x]\n\nTwo lines\nstay [none]\n\nOptions:\n- Short:\n- In practice the **7/3** rule is long enough not to be taken for a heading here\n-   \n- Last one\n\n\n\n"
    pill = '<span class="x-aiAuthorityPill">{}</span>'
    group, rule = '<div class="x-aiSectionGroup">', '<hr class="x-aiSectionRule" />'
    want = rule.join(
        [
            f'{group}<p class="x-aiParagraph"><span class="x-aiInlineLabel">Bottom line</span><span class="x-aiInlineLabelColon">:</span> yes &amp; no {pill.format("22/5")}</p></div>',
            f'{group}<p class="x-aiParagraph">Two lines\nstay [none]</p></div>',
            f'{group}<div class="x-aiSectionHeading">Options</div></div>',
            f'{group}<div class="x-aiSectionHeading">Short</div><ul class="x-aiList"><li class="x-aiListItem"><span class="x-aiInlineLabel">In practice</span> the {pill.format("7/3")} rule is long enough not to be taken for a heading here</li></ul></div>',
            f'{group}<div class="x-aiSectionHeading">-</div></div>',
            f'{group}<div class="x-aiSectionHeading">Last one</div></div>',
        ]
    )
    assert html(spark, text, prefix="x-") == want
    assert html(spark, "") == "" and html(spark, None) is None and html(spark, " \n\n \n\n") == ""
    assert html(spark, "[open **1/2a** KEY POINT") == '<div class="rm-aiSectionGroup"><p class="rm-aiParagraph">[open **1/2a** KEY POINT</p></div>'


def test_debug_text_of_an_empty_report(spark):
    row = spark.createDataFrame([], H.DEBUG)
    text = spark.range(1).select(F.from_json(F.lit('{"plan":{},"retrievals":[{"query":"q"}]}'), H.DEBUG).alias("r")).select("r.*").select(H.debug_text("REPORT")).first()[0]
    assert row.select(H.debug_text()).count() == 0
    assert text.startswith("REPORT\n======\n\nQuestion: None\nRequested corpus: Auto\n") and text.endswith("AUTHORITIES\n-----------\nNone\n\nANSWER\n------\nNone\n")
    assert "1. Query: q\n   Corpus: Auto\n   Provenance: unknown\n   Discovery status: not evaluated\n   Top results:\n    None" in text


PAGE = """<html><body><div class="top"><a href="/r/chapter-1-nav">x</a></div>
<div id="main-content"><div class="page main" role="main"><p>Open <a class=k href="../r/chapter-10-ten?x=1">10</a><br><a href="/r/chapter-2-two#a">2</a><a href=" https://h.org/r/chapter-2-two#a ">2</a>
<a href="mailto:x">m</a><a name="chapter-3">n</a><a href="http://[bad">b</a><a href="chapter-x-none">z</a></div></div><main><a href="/r/chapter-4-m">4</a></main></body></html>"""


def test_links_by_selectors(spark):
    rows = [(1, PAGE), (2, PAGE.replace("main-content", "other")), (3, PAGE.replace('role="main"', "")), (4, PAGE.replace('role="main"', "").replace("main>", "div>")), (5, ""), (6, None), (7, "<a href=chapter-7-x>unclosed")]
    got = {}
    for r in pages.chapter_urls(spark.createDataFrame(rows, "page_id int, html string"), "https://h.org/r/index?q=1", r"^https://h\.org/r/chapter-(\d+|x)-").orderBy("page_id", "place").collect():
        got.setdefault(r.page_id, []).append((r.url.removeprefix("https://h.org/r/"), r.chapter))
    inner = [("chapter-2-two#a", 2), ("chapter-10-ten?x=1", 10), ("chapter-x-none", None)]
    assert got[1] == inner and got[2] == inner
    assert got[3] == [("chapter-4-m", 4)]
    assert got[4] == [("chapter-1-nav", 1), inner[0], ("chapter-4-m", 4), *inner[1:]]
    assert 5 not in got and 6 not in got and got[7] == [("chapter-7-x", 7)]


def test_selectors():
    steps = pages.selector('#main-content .main[role="main"] a[href]')
    chain = [("html", []), ("div", [("id", "main-content")]), ("p", []), ("div", [("class", "a main b"), ("role", "main")]), ("a", [("href", "x")])]
    assert pages.selects(steps, chain) and not pages.selects(steps, chain[:3] + chain[4:]) and not pages.selects(steps, chain[:-1])
    assert not pages.selects(steps, [chain[3], chain[1], chain[4]])
    assert pages.selects(pages.selector("a"), [("a", [])]) and not pages.selects(pages.selector("a[href]"), [("a", [])])


def test_sessions_of_a_stream_with_late_and_repeated_rows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    row = lambda i, minute, mode: (i, "q", mode, "c", i, 1, start + timedelta(minutes=minute))
    first = [row(1, 0, "a"), row(2, 3, "a"), row(3, 20, "a"), row(4, 1, "b"), row(2, 3, "a")]
    late = [row(5, 14, "a"), row(3, 20, "a"), row(6, 24, "b")]  # row 5 is late but within the watermark, row 3 comes again
    last = [row(7, 200, "a")]
    log = lambda rows: spark.createDataFrame(rows, query_log.LOG)
    path = f"{tmp_path}/log"
    values = lambda df: sorted((r.session_window.start, r.mode, r.searches, r.results, r.slowest_ms) for r in df.collect())
    query = None
    for rows in (first, late, last):
        query_log.append_log(log(rows).coalesce(1), path)
        query = query_log.sessions(query_log.read_log_stream(spark, path), late="30 minutes", gap="5 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
    done = values(spark.read.parquet(f"{tmp_path}/out"))
    batch = values(query_log.sessions(log(first + late + last), gap="5 minutes"))
    assert done == [x for x in batch if x[0] < start + timedelta(minutes=100)] and len(done) == 5
    assert {x[1:4] for x in done} == {("a", 2, 2), ("a", 1, 1), ("b", 1, 1)}
