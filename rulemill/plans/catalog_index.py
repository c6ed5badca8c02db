"""Queries over the stored index, cover density, answers as HTML, debug reports, page links, sessions and builds; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import analysis as A
from ..functions import answer_text as H
from ..functions import present as P
from ..functions import text as T
from ..operators import index, search
from ..sources import pages, versions
from ..sources.corpus import SECTIONS_SQL, sections, table
from ..sources.staging import folder, stage
from ..streaming import query_log

RENAMED = "src1"


def _renamed_queries(spark, d):
    b = table(spark, d, "benchmark")
    words = F.split(T.clean(F.col("text")), " ")
    one = b.select((F.col("item_id") * 2).alias("query_id"), F.concat(F.lit("renamed "), "item_id").alias("q"))
    return one.unionByName(b.select((F.col("item_id") * 2 + 1).alias("query_id"), F.array_join(F.slice(words, 1, 2), " ").alias("q"))).withColumn("corpus_filter", F.lit(None).cast("string"))


def q_stored_search(spark, d):
    """Searches of an index that was stored, and one of whose documents was replaced then by one with other headings."""
    s, path = sections(spark, d), f"{folder(spark)}/index-{uuid.uuid4().hex}"
    fs, where = versions._fs(spark, path)
    fs.deleteOnExit(where)
    index.write_index(s, path, parts=index.SUBSTRINGS)
    heading = F.concat(F.lit("Renamed "), "section_key")
    index.write_index(s.filter(F.col("slug") == RENAMED).withColumn("heading", heading).withColumn("path", F.array("corpus", "slug", "heading")), path, parts=index.SUBSTRINGS)
    out = search.search(None, _renamed_queries(spark, d), 10, 0, index.open_index(spark, path, index.SUBSTRINGS))
    return out.select("query_id", "place", "section_id", "overall_rank", "cluster_support", "total", "has_more")


def _pairs_of_words(spark, d):
    """Two words of each benchmark text, as a search for both."""
    words = A.simple_words(F.col("text"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(F.array_distinct(F.filter(words, lambda w: ~A.stopped(w))), 3, 2).alias("w")).filter("size(w) = 2")
    return b.select("query_id", F.lit("match").alias("kind"), F.lit(0).alias("alt"), F.posexplode("w").alias("clause", "lexeme"), F.lit(False).alias("negated"), F.lit(0).alias("at"))


def q_cover_density(spark, d):
    """The rank of every section for pairs of words, without stems."""
    rows = index.chunk_word_rows(sections(spark, d).select("slug", "section_id", F.lit(0).alias("chunk_index"), "content"))
    words = stage(_pairs_of_words(spark, d), "pairs")
    own = rows.join(words.select(F.col("lexeme").alias("word")).distinct(), "word", "left_semi")
    stored = stage(index.posted(own, words.select(F.col("lexeme").alias("word"), "lexeme").distinct()), "stored")
    counts = stored.groupBy("lexeme").agg(F.count("*").alias("n")).withColumn("part_of", F.lit("chunk"))
    found = index.ranked_texts(stored, counts, "chunk", words, index.search_trees(words))
    return found.select("query_id", "section_id", F.round("rank", 6).alias("rank"))


def q_posting_stats_en(spark, d):
    """The stored postings by field: how many words are no stop words, and in how many (section, word) lists."""
    words = index.word_rows(sections(spark, d))
    lists = words.groupBy("section_id", "field", "class", "word").agg(F.count("*").alias("n"), F.max("pos").alias("last"))
    return lists.groupBy("field", "class").agg(F.count("*").alias("lists"), F.sum("n").alias("words"), F.max("last").cast("long").alias("last_pos"))


def _said(spark, d):
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    n = F.col("conv_id")
    text = F.concat(
        F.lit("bottom line : "), F.coalesce("text", F.lit("")), F.lit(" [22/5; 1/1] <b>\n\n\nKey point - **7/3A** and [22/5, x,3/4]\n\nYour options:\n- Short & sharp:\n- "), F.coalesce("text", F.lit("")), F.lit("\n-  [9/"), (n % 7).cast("string"),
        F.lit("] is cited here by a bullet that is too long to be a heading at all\n- Takeaway: "), F.coalesce("text", F.lit("")), F.lit("\n\n- What this means\n\n \n\nIn practice\n- \nlast [open"),
    )
    return c.select((n * 1000 + F.col("turn")).alias("answer_id"), text.alias("text"))


def q_answer_html(spark, d):
    return _said(spark, d).select("answer_id", F.md5(H.answer_html(F.col("text"))).alias("digest"), F.length(H.answer_html(F.col("text"))).cast("long").alias("chars"))


_SAID = """said as (select conv_id * 1000 + turn as answer_id, 'bottom line : ' || coalesce(text, '') || ' [22/5; 1/1] <b>' || chr(10) || chr(10) || chr(10) || 'Key point - **7/3A** and [22/5, x,3/4]' || chr(10) || chr(10) || 'Your options:' || chr(10) || '- Short & sharp:' || chr(10) || '- ' || coalesce(text, '')
  || chr(10) || '-  [9/' || (conv_id % 7) || '] is cited here by a bullet that is too long to be a heading at all' || chr(10) || '- Takeaway: ' || coalesce(text, '') || chr(10) || chr(10) || '- What this means' || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || 'In practice' || chr(10) || '- ' || chr(10) || 'last [open' as t
  from conversations where role = 'assistant')"""
_NAMES = "|".join(H.LEAD_LABELS)
_TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_PILL = f'<span class="{H.PREFIX}aiAuthorityPill">'
_REFS = rf"list_filter(list_transform(str_split(p[2:length(p) - 1], ','), lambda r: {_TRIM('r')}), lambda r: regexp_full_match(r, '{H.REFERENCE}'))"


def _inline_sql(x: str) -> str:
    bold = rf"regexp_replace({x}, '\*\*({H.REFERENCE})\*\*', '{_PILL}\1</span>', 'g')"
    pill = rf"""array_to_string(list_transform(regexp_extract_all({bold}, '\[[^\]]+\]|[^\[]+|\['), lambda p: case when p[1] = '[' and right(p, 1) = ']' and length(p) > 2 and len({_REFS}) > 0
  then array_to_string(list_transform({_REFS}, lambda r: '{_PILL}' || r || '</span>'), ' ') else p end), '')"""
    label = rf'<span class="{H.PREFIX}aiInlineLabel">\1</span>'
    colon = rf"(?i)^({_NAMES})\s*:\s*"
    return rf"""(case when regexp_matches({pill}, '{colon}') then regexp_replace({pill}, '{colon}', '{label}<span class="{H.PREFIX}aiInlineLabelColon">:</span> ')
  else regexp_replace({pill}, '(?i)^({_NAMES})([\s—–-])', '{label}\2') end)"""


_HTML = rf"""ps as (select answer_id, unnest(ls) as p0, unnest(range(len(ls))) as pn from (select answer_id, str_split_regex(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\n{{2,}}') as ls from said)),
pq as (select answer_id, pn, {_TRIM("p0")} as par from ps where {_TRIM("p0")} <> ''),
pb as (select *, regexp_matches(par, '(?m)^- ') as listed from pq),
li as (select answer_id, pn, unnest(ls) as l0, unnest(range(len(ls))) as ln from (select answer_id, pn, str_split_regex(par, '\n+') as ls from pb where listed)),
lj as (select answer_id, pn, ln, {_TRIM("regexp_replace(" + _TRIM("l0") + ", '^- ', '')")} as l from li where {_TRIM("l0")} <> ''),
lk as (select answer_id, pn, ln, {_inline_sql("l")} as item from lj),
ll as (select *, {_TRIM("regexp_replace(" + _TRIM("regexp_replace(item, '<[^>]+>', '', 'g')") + r", '\s*:\s*$', '')")} as plain from lk),
lm as (select *, plain <> '' and length(plain) <= {H.HEADING_MOST} as head from ll),
ln as (select *, sum(head::int) over (partition by answer_id, pn order by ln) as g from lm),
gr as (select answer_id, pn, g, '<div class="{H.PREFIX}aiSectionGroup">' || coalesce('<div class="{H.PREFIX}aiSectionHeading">' || max(case when head then {_TRIM(r"regexp_replace(item, '\s*:\s*$', '')")} end) || '</div>', '')
  || coalesce('<ul class="{H.PREFIX}aiList">' || string_agg('<li class="{H.PREFIX}aiListItem">' || item || '</li>', '' order by ln) filter (not head) || '</ul>', '') || '</div>' as block from ln group by all),
bl as (select answer_id, pn, g, block from gr union all select answer_id, pn, 0, '<div class="{H.PREFIX}aiSectionGroup"><p class="{H.PREFIX}aiParagraph">' || {_inline_sql("par")} || '</p></div>' from pb where not listed),
ht as (select answer_id, string_agg(block, '<hr class="{H.PREFIX}aiSectionRule" />' order by pn, g) as html from bl group by answer_id)"""


def _reports(spark, d):
    """A question with its searches and results for each conversation, nested as a report reads it."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    n, size = F.col("conv_id"), F.length("text")
    top = F.struct(
        F.concat(F.lit("SO "), size.cast("string")).alias("citation_label"), F.lit("c").alias("corpus"), F.col("role").alias("title"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("heading"), F.col("turn").cast("string").alias("section_key"), (size / 4).alias("rank"),
        F.lit(0.5).alias("section_rank"), F.lit(0.0).alias("path_rank"), F.lit(12.25).alias("body_rank"), F.when(F.col("turn") > 0, size / 8).alias("chunk_rank"), (n % 4).alias("cluster_support"),
        (n % 2 == 0).alias("exact_key"), F.lit(False).alias("exact_citation"), F.lit(False).alias("exact_heading"), (n % 3 == 0).alias("heading_match"), F.lit(False).alias("body_match"), F.lit(False).alias("path_match"),
    )
    found = F.struct(F.lit("accepted").alias("status"), F.col("role").alias("concept"), F.lit(None).cast("string").alias("heading"), F.col("turn").alias("evidence"), F.lit("slot").alias("slot_key"), F.lit(None).cast("string").alias("source_query"), F.lit("SO 1").alias("source_label"), F.lit("ok").alias("validation"))
    one = F.struct(F.col("turn").alias("t"), F.col("text").alias("query"), F.when(n % 2 == 1, "c").alias("corpus"), F.when(F.col("turn") > 0, "planner").alias("provenance"), F.when(F.col("turn") % 2 == 1, found).alias("discovery"), size.cast("long").alias("result_count"), F.when(F.col("turn") < 3, F.array(top)).otherwise(F.array().cast(f"array<{_top_type()}>")).alias("top"))
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"), F.array_sort(F.collect_list(one), lambda a, b: F.when(a["t"] < b["t"], -1).when(a["t"] > b["t"], 1).otherwise(0)).alias("rs"))
    texts = F.transform("ts", lambda t: t["text"])
    roles = F.transform("ts", lambda t: t["role"])
    chosen = F.transform("rs", lambda r: F.struct(r["provenance"].alias("citation_label"), r["query"].alias("query")))
    nested = F.struct(
        F.element_at(texts, 1).alias("question"), F.when(n % 2 == 0, "c").alias("requested_corpus"), F.when(n % 5 == 0, n).alias("latency_ms"), F.when(n % 7 == 0, "late").alias("error"), F.struct(F.lit("ask").alias("intent"), F.slice(texts, 1, 2).alias("search_queries")).alias("plan"),
        roles.alias("inferred_concepts"), F.when(n % 3 > 0, n % 3 == 1).alias("blueprint_satisfied"), F.array_distinct(roles).alias("required_slots"), F.transform(F.slice("ts", 1, 1), lambda t: F.struct(t["role"].alias("slot_key"), t["text"].alias("citation_label"))).alias("slot_matches"),
        F.col("rs").alias("retrievals"), F.transform(F.slice("ts", 1, 1), lambda t: F.struct(t["role"].alias("citation_label"), t["text"].alias("query"), F.lit("c").alias("corpus"), (n / 2).alias("base_rank"), F.lit(1.5).alias("route_boost"), (n / 4).alias("adjusted_rank"), roles.alias("path"))).alias("selection"),
        F.transform("ts", lambda t: F.struct(t["role"].alias("citation_label"), F.lit("c").alias("corpus"), F.lit("k").alias("section_key"), (n / 2).alias("rank"))).alias("authorities"), F.element_at(texts, -1).alias("answer"), chosen.alias("unread"),
    )
    return rows.select("conv_id", F.from_json(F.to_json(nested), H.DEBUG).alias("r")).select("conv_id", "r.*")


def _top_type() -> str:
    return "struct<citation_label:string,corpus:string,title:string,heading:string,section_key:string,rank:double,section_rank:double,path_rank:double,body_rank:double,chunk_rank:double,cluster_support:bigint,exact_key:boolean,exact_citation:boolean,exact_heading:boolean,heading_match:boolean,body_match:boolean,path_match:boolean>"


def q_debug_text(spark, d):
    return _reports(spark, d).select("conv_id", F.md5(H.debug_text()).alias("digest"), F.length(H.debug_text()).cast("long").alias("chars"))


def _listed_sql(items: str) -> str:
    return f"coalesce(nullif(array_to_string(list_transform({items}, lambda x, i: i || '. ' || x), chr(10)), ''), 'None')"


_TWO = lambda x: f"printf('%.2f', floor({x} * 100 + 0.5) / 100)"
_LINES = lambda *xs: " || chr(10) || ".join(xs)
_SLOTS = lambda name, value: f"'{name}' || chr(10) || {value}"
_TOP = _LINES(
    "'    1. SO ' || length(t.text)", "'       corpus: c'", "'       title: ' || t.role", "'       heading: ' || case when t.turn % 2 = 0 then t.role else 'None' end", "'       sectionKey: ' || t.turn", f"'       rank: ' || {_TWO('length(t.text) / 4.0')}",
    "'       sectionRank: 0.50'", "'       pathRank: 0.00'", "'       bodyRank: 12.25'", f"'       chunkRank: ' || case when t.turn > 0 then {_TWO('length(t.text) / 8.0')} else 'None' end", "'       clusterSupportCount: ' || (conv_id % 4)",
    "'       matchSignals: ' || case when conv_id % 6 = 0 then 'exact section, heading phrase' when conv_id % 2 = 0 then 'exact section' when conv_id % 3 = 0 then 'heading phrase' else 'none' end",
)
_FOUND = _LINES("'   Discovery status: accepted'", "'   Discovery concept: ' || t.role", "'   Discovery heading: None'", "'   Discovery evidence count: ' || t.turn", "'   Discovery slot: slot'", "'   Discovery bridge source query: None'", "'   Discovery bridge source authority: SO 1'", "'   Discovery validation: ok'")
_RETRIEVAL = _LINES(
    "i || '. Query: ' || t.text", "'   Corpus: ' || case when conv_id % 2 = 1 then 'c' else 'Auto' end", "'   Provenance: ' || case when t.turn > 0 then 'planner' else 'unknown' end", f"case when t.turn % 2 = 1 then {_FOUND} else '   Discovery status: not evaluated' end",
    "'   Result count: ' || length(t.text)", "'   Top results:'", f"case when t.turn < 3 then {_TOP} else '    None' end",
)
_SELECTED = _LINES(
    "'1. ' || ts[1].role", "'   query: ' || ts[1].text", "'   corpus: c'", "'   heading: None'", f"'   baseRank: ' || {_TWO('conv_id / 2.0')}", "'   routeBoost: 1.50'", "'   slotBoost: 0.00'", "'   preferredTextBoost: 0.00'", "'   bridgeBoost: 0.00'", "'   discoveryBoost: 0.00'",
    "'   authorityFunction: None'", "'   matchedSlots: None'", f"'   adjustedRank: ' || {_TWO('conv_id / 4.0')}", "'   path: ' || array_to_string(list_transform(ts, lambda x: x.role), ' > ')",
)
_AUTHORITY = _LINES("i || '. ' || t.role", "'   corpus: c'", "'   heading: None'", "'   sectionKey: k'", f"'   rank: ' || {_TWO('conv_id / 2.0')}", "'   path: None'", "'   sourceHref: None'")
_ROLES = "list_transform(ts, lambda x: x.role)"
_ONCE = f"list_filter({_ROLES}, lambda x, i: list_position({_ROLES}, x) = i)"
_REPORT = " || chr(10) || chr(10) || ".join(
    [
        _LINES("'DEBUG SNAPSHOT'", "'=============='", "''", "'Question: ' || coalesce(nullif(ts[1].text, ''), 'None')", "'Requested corpus: ' || case when conv_id % 2 = 0 then 'c' else 'Auto' end", "'Effective corpus: Auto'", "'Stage: None'", "'Started at: None'", "'Latency ms: ' || case when conv_id % 5 = 0 then cast(conv_id as varchar) else 'Unknown' end", "'Error: ' || case when conv_id % 7 = 0 then 'late' else 'None' end"),
        _LINES("'PLAN'", "'----'", "'Intent: ask'", "'Preferred corpus: None'", "'Notes: None'", "'Planner search queries:'", _listed_sql("list_transform(ts[1:2], lambda x: x.text)")),
        _SLOTS("Salient user terms:", "'None'"), _SLOTS("Inferred concepts:", _listed_sql(_ROLES)), _SLOTS("Expanded queries:", "'None'"),
        _LINES("'BLUEPRINT COVERAGE'", "'------------------'", "'Satisfied: ' || case conv_id % 3 when 0 then 'Unknown' when 1 then 'Yes' else 'No' end", "'Blueprint slots:'", "'None'"),
        _SLOTS("Required slots:", _listed_sql(_ONCE)), *[_SLOTS(x, "'None'") for x in ("Optional slots:", "Satisfied slots:", "Missing required slots:")],
        _SLOTS("Selected slot matches:", "'1. ' || ts[1].role || ' -> ' || ts[1].text || ' (None)'"),
        _LINES("'RETRIEVALS'", "'----------'", f"array_to_string(list_transform(ts, lambda t, i: {_RETRIEVAL}), chr(10) || chr(10))"), _LINES("'FINAL AUTHORITY SELECTION'", "'-------------------------'", _SELECTED),
        _LINES("'AUTHORITIES'", "'-----------'", f"array_to_string(list_transform(ts, lambda t, i: {_AUTHORITY}), chr(10) || chr(10))"), _LINES("'ANSWER'", "'------'", "coalesce(nullif(ts[-1].text, ''), 'None')", "''"),
    ]
)

SITE, LINKS = "https://example.org", ("#content a[href]", 'nav li a[href]', "a[href]")


def q_page_links(spark, d):
    """Links of the navigation that begin with a small letter; of all of the page where it has none."""
    return pages.chapter_urls(table(spark, d, "pages"), f"{SITE}/rules/index?v=1", r"^https://example\.org/[a-z]", LINKS).select("page_id", "place", "url")


def q_page_rulings(spark, d):
    """Pages cut to rulings of a rule book, with headings of three levels put in, parsed back."""
    p = table(spark, d, "pages").select("page_id", T.clean(T.strip_tags(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "))).alias("t"))
    word = F.regexp_replace(F.substring("t", 1, 60), "[^A-Za-z ]", "")
    html = F.concat(F.lit("<h1>Chapter "), (F.col("page_id") % 9 + 1).cast("string"), F.lit(": Of pages</h1><h4>Section one</h4><h5>First heading</h5><p>1/1 Said <b>at</b> once<p>"), word, F.lit(" it.</p><p>1998, Vol. 570, p. 1</p><h5>Other heading</h5><p>2/1</p><ul><li>one<li>two</ul><p>3/1</p>"))
    return pages.parse_rulings(p.select(F.col("page_id").cast("string").alias("url"), html.alias("html"))).select("url", "ruling_number", "section_heading", "primary_heading", F.array_join("path", " > ").alias("path_text"), F.array_join("citations", "|").alias("citations"))


def _log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("log_id"), F.col("event_type").alias("mode"), F.pmod("user_id", F.lit(50)).cast("int").alias("latency_ms"), F.pmod("event_id", F.lit(9)).cast("int").alias("result_count"), F.col("ts").cast("timestamp").alias("created_at"))


def q_sessions(spark, d):
    """Sessions of the log, each third row of which came twice."""
    log = _log(spark, d)
    out = query_log.sessions(log.unionByName(log.filter("log_id % 3 = 0")), gap="5 minutes")
    return out.select(F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "mode", "searches", "results", "slowest_ms")


def q_build_states(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_id") % 3 == 0, "running").when(F.col("event_id") % 3 == 1, "completed").otherwise("failed")
    log = e.select(F.col("user_id").cast("string").alias("build_id"), F.lit("t").alias("build_type"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("event_id"))).alias("at"), status.alias("status"), F.when(F.col("event_id") % 3 == 2, F.lit("bad")).alias("notes"), F.create_map(F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string")), F.col("event_id").cast("string")).alias("metadata"))
    s = versions.build_states(log)
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",")
    return s.select("build_id", "status", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started"), F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("ended"), "notes", pairs.alias("metadata"))


def q_presentation(spark, d):
    """Labels, progress and summaries for all turns."""
    c = table(spark, d, "conversations")
    stage_ = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Planning", "Searching", "Retrieving", "Checking authorities", "Synthesis", "Complete", "", "Other")]), (F.col("turn") % 8 + 1).cast("int")))
    corpus = F.when(F.col("conv_id") % 3 == 0, "standing_orders").when(F.col("conv_id") % 3 == 1, "speakers_rulings")
    n = F.length(F.coalesce("text", F.lit("")))
    return c.select("conv_id", "turn", P.progress(stage_, F.col("conv_id") % 2 == 0).cast("long").alias("progress"), P.summary_text(F.col("turn"), F.when(F.col("turn") == 1, F.lit(1)).otherwise(n), corpus, n).alias("summary"))


def _search_renamed_sql() -> str:
    from .catalog import _search_sql

    out = _search_sql(10, 0, "sup as cluster_support,")
    head, tail = out.split("\nq as (", 1)
    queries = r"qs as (select item_id * 2 as query_id, 'renamed ' || item_id as q from benchmark union all select item_id * 2 + 1, array_to_string(str_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:2], ' ') from benchmark)"
    renamed = f"sx as (select * replace (case when slug = '{RENAMED}' then 'Renamed ' || section_key else heading end as heading, case when slug = '{RENAMED}' then [corpus, slug, 'Renamed ' || section_key] else path end as path) from s)"
    return f"with {SECTIONS_SQL}, {queries}, {renamed},\nq as (" + tail.replace("from s, q", "from sx as s, q")


_STOPPED = ", ".join(f"'{w}'" for w in A.STOP)
_WORDS = lambda x: rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]+')"
_LAST = lambda w: f"coalesce(list_max(list_transform({w}, lambda x, i: case when x in ({_STOPPED}) then 0 else i end)), 0)"

SQL = {
    "q_stored_search": _search_renamed_sql,
    "q_cover_density": rf"""with {SECTIONS_SQL}, w as (select section_id, unnest(ws) as word, unnest(range(len(ws))) as pos from (select section_id, {_WORDS("content")} as ws from s)),
qw as (select item_id as query_id, list_filter({_WORDS("text")}, lambda x: x not in ({_STOPPED})) as ws from benchmark),
q as (select query_id, u[3] as a, u[4] as b from (select query_id, list_filter(ws, lambda x, i: list_position(ws, x) = i) as u from qw) where len(u) >= 4),
h as (select query_id, section_id, pos, word, lag(pos) over o as p, lag(word) over o as v from q join w on word in (a, b) window o as (partition by query_id, section_id order by pos))
select query_id, section_id, round(sum(case when v <> word then {A.WEIGHTS["D"]} / (pos - p) else 0 end), 6) as rank from h group by all having count(distinct word) = 2""",
    "q_posting_stats_en": f"""with {SECTIONS_SQL}, f as (select section_id, {_WORDS("citation_label")} as l, {_WORDS("section_key")} as k, {_WORDS("heading")} as h, {_WORDS("array_to_string(path, ' ')")} as p, {_WORDS("content")} as c from s),
g as (select *, {_LAST("l")} as nl, len(k) as nk, {_LAST("h")} as nh, {_LAST("p")} as np from f),
u as (select section_id, 'label' as field, 'A' as class, unnest(l) as word, unnest(range(len(l))) + 1 as pos from g union all select section_id, 'key', 'A', unnest(k), nl + unnest(range(len(k))) + 1 from g
  union all select section_id, 'heading', 'A', unnest(h), nl + nk + unnest(range(len(h))) + 1 from g union all select section_id, 'path', 'B', unnest(p), nl + nk + nh + unnest(range(len(p))) + 1 from g
  union all select section_id, 'content', 'C', unnest(c), nl + nk + nh + np + unnest(range(len(c))) + 1 from g),
x as (select section_id, field, class, word, count(*) as n, max(pos) as last from u where field = 'key' or word not in ({_STOPPED}) group by all)
select field, class, count(*) as lists, cast(sum(n) as bigint) as words, max(last) as last_pos from x group by all""",
    "q_answer_html": f"with {_SAID}, {_HTML} select answer_id, md5(html) as digest, length(html) as chars from ht",
    "q_debug_text": f"""with k as (select conv_id, list(struct_pack(turn := turn, role := role, text := coalesce(text, '')) order by turn, role, text) as ts from conversations group by conv_id),
r as (select conv_id, {_REPORT} as report from k) select conv_id, md5(report) as digest, length(report) as chars from r""",
    "q_page_links": rf"""with p as (select page_id, regexp_extract(html, '(?s)<nav>.*?</nav>') as nav, regexp_replace(html, '(?s)<(script|style)[ >].*?</(script|style)>|<!--.*?-->', '', 'g') as html from pages),
l as (select page_id, list_filter(list_distinct(regexp_extract_all(nav, '<li><a href="([^"]*)"', 1)), lambda x: regexp_matches(x, '^/[a-z]')) as a, regexp_extract_all(nav, '<li><a href="([^"]*)"', 1) as a0, regexp_extract_all(html, '<a href="([^"]*)"', 1) as b0 from p),
m as (select page_id, case when len(a) > 0 then a0 else b0 end as u from l),
e as (select page_id, unnest(u) as x, unnest(range(len(u))) as i from m),
f as (select page_id, x, min(i) as i from e where regexp_matches(x, '^/[a-z]') or regexp_matches(x, '^https://example\.org/[a-z]') group by all)
select page_id, row_number() over (partition by page_id order by i) as place, case when x[1] = '/' then '{SITE}' || x else x end as url from f""",
    "q_page_rulings": """select cast(page_id as varchar) as url, n as ruling_number, 'Section one' as section_heading, case n when '1/1' then 'First heading' else 'Other heading' end as primary_heading,
  'Chapter ' || (page_id % 9 + 1) || ' > of Pages > Section one > ' || case n when '1/1' then 'First heading' else 'Other heading' end as path_text, case n when '1/1' then '1998, Vol. 570, p. 1' else '' end as citations
from pages, (values ('1/1'), ('2/1')) t(n)""",
    "q_sessions": """with l as (select distinct event_id, event_type as mode, user_id % 50 as latency, event_id % 9 as results, cast(ts as timestamp) as moment from events),
g as (select *, case when moment >= lag(moment) over (partition by mode order by moment, event_id) + interval 5 minute or lag(moment) over (partition by mode order by moment, event_id) is null then 1 else 0 end as new from l),
s as (select *, sum(new) over (partition by mode order by moment, event_id) as n from g)
select strftime(min(moment), '%Y-%m-%d %H:%M:%S') as started, mode, count(*) as searches, cast(sum(results) as bigint) as results, cast(max(latency) as integer) as slowest_ms from s group by mode, n""",
    "q_build_states": """with e as (select cast(user_id as varchar) as build_id, event_id, event_id % 3 as k, 'k' || (event_id % 4) as key from events),
m as (select build_id, key, max(event_id) as v from e group by all), p as (select build_id, string_agg(key || '=' || v, ',' order by key) as metadata from m group by build_id),
b as (select build_id, min(event_id) as a, max(event_id) as z, max(case when k = 2 then 'bad' end) as notes from e group by build_id)
select build_id, case z % 3 when 0 then 'running' when 1 then 'completed' else 'failed' end as status, strftime(timestamp '2024-01-01' + to_seconds(a), '%Y-%m-%d %H:%M:%S') as started,
  case when z % 3 > 0 then strftime(timestamp '2024-01-01' + to_seconds(z), '%Y-%m-%d %H:%M:%S') end as ended, notes, metadata from b join p using (build_id)""",
    "q_presentation": """with c as (select conv_id, turn, length(coalesce(text, '')) as n, ['Planning', 'Searching', 'Retrieving', 'Checking authorities', 'Synthesis', 'Complete', '', 'Other'][cast(turn % 8 + 1 as integer)] as s from conversations)
select conv_id, turn, cast(case s when 'Planning' then 22 when 'Searching' then 42 when 'Retrieving' then 58 when 'Checking authorities' then 72 when 'Synthesis' then 82 when 'Complete' then 100 when '' then case when conv_id % 2 = 0 then 6 else 0 end
  else case when conv_id % 2 = 0 then 14 else 100 end end as bigint) as progress,
  turn || ' of ' || case when turn = 1 then 1 else n end || case when (case when turn = 1 then 1 else n end) = 1 then ' result' else ' results' end || case conv_id % 3 when 0 then ' in Standing Orders' when 1 then ' in Speakers'' Rulings' else '' end || ' · ' || n || ' ms' as summary from c""",
}


def queries() -> dict:
    return {name: function for name, function in globals().items() if name.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for name, sql in SQL.items()}
