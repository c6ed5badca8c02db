"""Queries over a rule book made from the documents: headings, paths and phrases that the registry knows stand in for a rule
book's own, chosen by doc_id, so that every rule is met; texts are whole. And their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import present as P
from ..functions import text as T
from ..operators import answers as AV
from ..operators import assistant, chunking, concepts, search
from ..sources import corpus, pages
from ..sources.corpus import sections, table
from ..streaming import query_log
from .registry import CONCEPTS, EXPANSIONS, PHRASES, registry

HEADINGS = ["closure motion", "Acceptance of closure motion", "Points of order", "against members", "Allegations of racism", "relevancy", "Chairperson", "Withdrawal", "Procedure", "Accountability to the House", "Form of reply", "General", "Members speaking", "Effect of carrying closure motion"]
PATHS = ["Rules of debate", "Personal reflections", "Committees of the whole House", "Closure of debate", "Unparliamentary language", "Chairpersons of select committees", "Maintenance of order", "Judiciary", "Amendments"]
SAID = ["", " It must not be done.", " This depends on the chair.", " There is nothing to prevent it.", " At a previous sitting.", " It is out of order unless leave is given.", " Only if the speaker can take action.", " A breach of the rules."]
ASKED = ["may the question be put", "is a racist remark in order", "what of a point of order", "the chairperson in committee stage", "an evasive answer", "must a member apologise for yesterday", "who speaks first", "premature closure"]


def _lit(values):
    return F.array(*[F.lit(v) for v in values])


def _at(values, n):
    return F.element_at(_lit(values), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def rulebook(spark, d):
    """Sections as a rule book has them."""
    n = F.col("section_id")
    s = sections(spark, d)
    return s.select(
        "section_id", F.when(n % 2 == 0, "standing_orders").otherwise("speakers_rulings").alias("slug"), F.when(n % 2 == 0, "standing_orders").otherwise("speakers_rulings").alias("corpus"), "section_key", "citation_label",
        _at(HEADINGS, n).alias("heading"), F.array(F.concat(F.lit("Chapter "), (n % 5).cast("string")), _at(PATHS, n), _at(HEADINGS, n)).alias("path"), F.concat("content", _at(SAID, n)).alias("content"),
    )


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, n):
    return f"{_list(values)}[cast({n} % {len(values)} as integer) + 1]"


_BOOK = f"""{corpus.SECTIONS_SQL}, bk as (select section_id, case when section_id % 2 = 0 then 'standing_orders' else 'speakers_rulings' end as corpus, {_pick(HEADINGS, "section_id")} as heading,
  'Chapter ' || (section_id % 5) || ' > ' || {_pick(PATHS, "section_id")} || ' > ' || {_pick(HEADINGS, "section_id")} as path, content || {_pick(SAID, "section_id")} as content from s)"""


def q_profile(spark, d):
    return concepts.profiled(rulebook(spark, d)).select("section_id", "authority_class", "authority_function")


_PROFILE = """pf as (select section_id, corpus, lower(heading) as h, lower(path) as p, lower(content) as c from bk),
cl as (select *, case when h in ('points of order', 'point of order') then 'procedural_mechanism' when h = 'chairperson' then 'chair_control'
  when contains(h, 'acceptance') or contains(p, 'acceptance of closure motion') or contains(h, 'effect') or contains(p, 'effect of carrying') or h in ('procedure', 'form of reply', 'withdrawal') then 'constraint_or_qualification'
  when h in ('against members', 'allegations of racism', 'relevancy', 'accountability to the house') or contains(p, 'relevancy') or contains(h, 'closure') or contains(p, 'closure of debate') then 'governing_rule'
  when contains(p, 'rules of debate') or contains(p, 'committee stage') or contains(p, 'amendments') or contains(p, 'personal reflections') then 'analogy_or_support' else 'miscellaneous' end as authority_class from pf),
fn as (select *, case when h in ('points of order', 'point of order') then 'procedure'
  when regexp_matches(c, 'nothing to prevent|does not prevent|not prohibited|may be made as long as|may be referred to|cannot see that i should rule out') then 'exception'
  when contains(h, 'effect') or contains(p, 'effect of carrying') then 'effect'
  when contains(h, 'acceptance') or contains(p, 'acceptance of closure motion') or h in ('form of reply', 'withdrawal') or regexp_matches(c, 'unless |only if|only where|would have to be|should not be curtailed|depends on|cannot take exception') then 'constraint'
  when h = 'procedure' then 'procedure' when regexp_matches(c, 'out of order|not in order|prohibits|must not|may not|is inappropriate|are inappropriate|should not') then 'rule'
  when authority_class = 'governing_rule' then 'application' else 'context' end as authority_function from cl)"""


def q_slot_match(spark, d):
    """Which of all slots each section fits."""
    slots = registry(spark).select(F.explode("slots").alias("s")).agg(F.collect_list("s").alias("slots"))
    rows = concepts.profiled(rulebook(spark, d)).join(F.broadcast(slots))
    return rows.select("section_id", F.explode(F.filter("slots", concepts.fits_slot)).alias("s")).select("section_id", F.col("s.key").alias("slot_key"))


def _slots_sql():
    one = lambda s, k: _list([x.lower() for x in s.get(k, [])]) + "::varchar[]"
    rows = [f"('{s['key']}', {one(s, 'headings')}, {one(s, 'path_includes')}, {one(s, 'classes')}, {one(s, 'functions')}, {one(s, 'corpora')}, {one(s, 'required_text')})" for c in CONCEPTS for s in c["slots"]]
    return f"slots as (select * from (values {', '.join(rows)}) t(slot_key, hs, ps, cs, fs, ks, ts))"


def _questions(spark, d):
    b = table(spark, d, "benchmark")
    words = F.split(T.clean(F.col("text")), " ")
    planned = F.array_append(F.slice(words, 1, 2), _at(["closure motion", "relevancy", "Racist", "general", "against members"], F.col("item_id")))
    return b.select(F.col("item_id").alias("question_id"), F.concat(_at(ASKED, F.col("item_id")), F.lit(": "), F.col("text")).alias("question"), planned.alias("planned"), F.array(F.element_at(words, 3), _at(["premature", "chairperson relevancy", "members speaking"], F.col("item_id"))).alias("terms"), F.lit(None).cast("string").alias("corpus"))


_PLANNED, _TERMS = ["closure motion", "relevancy", "Racist", "general", "against members"], ["premature", "chairperson relevancy", "members speaking"]
_QS = rf"""qs as (select item_id as question_id, {_pick(ASKED, "item_id")} || ': ' || text as question, list_append(w[1:2], {_pick(_PLANNED, "item_id")}) as planned, [w[3], {_pick(_TERMS, "item_id")}] as terms
  from (select *, str_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as w from benchmark))"""


def q_concepts(spark, d):
    return concepts.infer_concepts(_questions(spark, d), registry(spark))


def q_query_plan(spark, d):
    q = _questions(spark, d)
    return concepts.query_plan(q, concepts.infer_concepts(q, registry(spark)), registry(spark))


def _concepts_sql():
    reg = ", ".join(f"('{c['concept']}', {i}, {_list(c['aliases'])}, {_list([x.lower() for x in c.get('planner_triggers', [])])}::varchar[], {_list(c['preferred_queries'])})" for i, c in enumerate(CONCEPTS))
    rules = ", ".join(f"({i}, {j}, '{c}', {_list(words)})" for i, (words, own) in enumerate(PHRASES) for j, c in enumerate(own))
    return f"""reg as (select * from (values {reg}) t(concept, ord, aliases, triggers, pq)), rules as (select * from (values {rules}) t(i, j, concept, words)),
steps as (select question_id, concept, 0 as step, ord as i, 0 as j from qs, reg where len(list_filter(aliases, lambda a: contains(lower(question), a))) > 0
  union all select question_id, concept, 1, i, j from qs, rules where len(list_filter(words, lambda a: contains(lower(question), a))) > 0
  union all select question_id, concept, 2, ord, 0 from qs, reg where len(list_filter(planned, lambda a: list_contains(triggers, lower(a)))) > 0),
firsts as (select question_id, concept, min(step * 10000 + i * 100 + j) as ps from steps group by all),
inf as (select question_id, concept, row_number() over (partition by question_id order by ps) as place from firsts)"""


def _plan_sql():
    table_ = ", ".join(f"('{k}', {_list(v)})" for k, v in EXPANSIONS.items())
    any_ = lambda *c: "len(list_intersect(cs, " + _list(c) + ")) > 0"
    adds = [
        (any_("closure_motion"), ["closure motion", "acceptance of closure motion"]),
        (any_("personal_reflection", "allegation_of_racism"), ["personal reflections", "against members"]),
        (any_("allegation_of_racism"), ["allegations of racism"]),
        (any_("committee_of_whole"), ["chairperson"]),
        (any_("relevancy"), ["relevancy"]),
        (any_("point_of_order", "closure_motion", "committee_of_whole", "ministerial_accountability", "retrospective_discipline"), ["point of order"]),
        (any_("ministerial_accountability"), ["accountability to the House", "form of reply"]),
        (any_("retrospective_discipline"), ["withdrawal", "procedure"]),
    ]
    extra = " union all ".join(f"select question_id, '{q}' as query, 5 as r, {100 * i + j} as ps, 'registry_expansion' as provenance from act where {when}" for i, (when, own) in enumerate(adds) for j, q in enumerate(own))
    grown = "coalesce(m.v, case when contains(lower(query), 'committee of the whole') and contains(lower(query), 'chairperson') and contains(lower(query), 'relevancy') then ['chairperson', 'relevancy', 'point of order'] when contains(lower(query), 'point of order') and contains(lower(query), 'relevancy') then ['point of order', 'relevancy'] when contains(lower(query), 'chairperson') and contains(lower(query), 'relevancy') then ['chairperson', 'relevancy'] else [] end)"
    return f"""em as (select * from (values {table_}) t(k, v)), act as (select question_id, list(concept) as cs from inf group by question_id),
lit as (select question_id, unnest(planned) as query, 0 as r, unnest(range(len(planned))) as ps, 'planner' as provenance from qs union all select question_id, unnest(terms), 1, unnest(range(len(terms))), 'user_term' from qs),
gr as (select question_id, query as raw, r + 2 as r, ps, {grown} as vs from lit left join em m on m.k = lower(query)),
ge as (select question_id, raw, r, ps * 100 + unnest(range(len(vs))) as ps, unnest(vs) as query from gr),
al as (select question_id, query, r, ps, provenance from lit union all select question_id, query, r, ps, 'registry_expansion' from ge where lower(query) <> lower(raw)
  union all select question_id, unnest(pq), 4, place * 100 + unnest(range(len(pq))), 'registry_expansion' from inf join reg using (concept) union all {extra}),
once as (select *, row_number() over (partition by question_id, lower(query) order by r, ps) as n from al where query <> '')
select question_id, row_number() over (partition by question_id order by r, ps) as place, query, provenance from once where n = 1 qualify place <= 8"""


def q_search_ranked_en(spark, d):
    s = sections(spark, d)
    words = F.split(T.clean(F.col("text")), " ")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, 2, 2), " ").alias("q"), F.lit(None).cast("string").alias("corpus_filter"))
    said = table(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 1_000_000).alias("query_id"), F.col("text").alias("q"), F.lit(None).cast("string").alias("corpus_filter"))
    out = search.search_ranked(s, chunking.block_texts(F.col("content")), q.unionByName(said))
    return out.select("query_id", "place", "section_id", F.round("overall_rank", 6).alias("overall_rank"), "cluster_support", "total", P.result_reason().alias("reason"), P.signal_list().alias("signals"))


def q_compiled_queries(spark, d):
    return search.compiled(_questions(spark, d).select(F.col("question_id").alias("query_id"), F.col("question").alias("q"), F.lit(None).cast("string").alias("corpus_filter")))


def _rounds(spark, d):
    """The rounds over one folder's questions."""
    book = rulebook(spark, d)
    return assistant.answer_rounds(_questions(spark, d), book, chunking.block_texts(F.col("content")), registry(spark))


def q_select(spark, d):
    out = assistant.authorities(_rounds(spark, d))
    return out.select("question_id", "place", "section_id", F.round("rank", 6).alias("rank"), "authority_class", "authority_function", F.array_join("satisfied", "|").alias("satisfied"))


def q_bridge_and_recovery(spark, d):
    r = _rounds(spark, d)
    bridge = r["bridge"].select("question_id", F.lit("bridge").alias("round"), "place", "query", "corpus", F.col("source_query").alias("source"))
    return bridge.unionByName(r["recovery"].select("question_id", F.lit("recovery").alias("round"), "place", "query", "corpus", F.col("slot_key").alias("source"))).unionByName(r["gaps"].select("question_id", F.lit("gap").alias("round"), F.lit(0).cast("long").alias("place"), F.col("description").alias("query"), F.lit(None).cast("string").alias("corpus"), F.col("slot_key").alias("source")))


def _drafts(spark, d):
    """Answers with headings, cited and uncited lines, mentions and bullets, around the assistants' whole turns."""
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    n = F.col("conv_id")
    draft = F.concat(
        F.lit("bottom line\n"), F.coalesce("text", F.lit("")), F.lit(" [SO 89(1); 22/5]\n\nWhat this means:\nAs standing order "), (n % 3 + 88).cast("string"), F.lit(" says [SO 89].\nUncited line.\n"),
        F.when(n % 5 == 0, F.lit("See [SO 91] and 7/3.\n")).otherwise(F.lit("")), F.lit("Your options:\nRisks or constraints:\n* So 12 is near  \n- 22/5 holds [22/5]\n\nBest authorities to inspect:\n- [SO 89] here\nnot a bullet"),
    )
    return c.select((n * 1000 + F.col("turn")).alias("question_id"), draft.alias("draft"), _lit(["SO 89", "22/5"]).alias("labels"))


_DRAFTS = """dr as (select conv_id * 1000 + turn as question_id, 'bottom line' || chr(10) || coalesce(text, '') || ' [SO 89(1); 22/5]' || chr(10) || chr(10) || 'What this means:' || chr(10) || 'As standing order ' || (conv_id % 3 + 88) || ' says [SO 89].' || chr(10) || 'Uncited line.' || chr(10)
  || case when conv_id % 5 = 0 then 'See [SO 91] and 7/3.' || chr(10) else '' end || 'Your options:' || chr(10) || 'Risks or constraints:' || chr(10) || '* So 12 is near  ' || chr(10) || '- 22/5 holds [22/5]' || chr(10) || chr(10) || 'Best authorities to inspect:' || chr(10) || '- [SO 89] here' || chr(10) || 'not a bullet' as draft
  from conversations where role = 'assistant')"""


def q_mentions(spark, d):
    r = _drafts(spark, d)
    return r.select("question_id", F.explode(AV.invalid_mentions(F.col("draft"), F.col("labels"))).alias("mention"))


def q_claims(spark, d):
    each = _drafts(spark, d).select("question_id", F.explode(AV.claims(F.col("draft"))).alias("c"))
    return each.select("question_id", F.col("c.id").alias("claim_id"), F.col("c.line_index").alias("line_index"), F.array_join("c.citations", "|").alias("citations"))


def q_prune(spark, d):
    kept, gone = AV.pruned(F.col("draft"), F.col("labels"))
    return _drafts(spark, d).select("question_id", F.size(AV.lines(kept)).cast("long").alias("kept_lines"), F.array_join(gone, "|").alias("removed"))


def q_citations(spark, d):
    r = _drafts(spark, d).select(F.col("question_id").alias("answer_id"), F.col("draft").alias("answer"), "labels")
    return AV.citation_verdicts(r, r.select("answer_id", "labels"))


def q_gate(spark, d):
    every = _drafts(spark, d).withColumn("verdicts", F.transform(AV.claims(AV.formatted(AV.relabelled(F.col("draft"), F.col("labels")))), lambda c: F.struct(c["id"].alias("id"), (F.length(c["text"]) % 4 != 0).alias("supported"))))
    every = every.withColumn("gaps", F.array(F.lit("what the  draft left open"))).withColumn("authorities", F.array(F.struct(F.lit("SO 89").alias("citation_label"), F.lit("Closure motion").alias("heading"), _lit(["Chapter 1", "Closure"]).alias("path"), F.lit("governing_rule").alias("authority_class"), F.lit("rule").alias("authority_function"))))
    return AV.gate(every)


def q_discovery(spark, d):
    s = sections(spark, d).filter("heading is not null")
    other = F.element_at(F.split("content", "\n"), 2)
    other = F.coalesce(F.try_element_at(F.split("content", "\n"), F.lit(2)), F.lit(""))
    return s.select("section_id", T.discovery_key(F.col("heading")).alias("key"), F.array_join(T.discovery_tokens(F.col("heading")), " ").alias("tokens"), T.heading_affinity(F.col("heading"), other).alias("affine"))


def q_headings(spark, d):
    s = sections(spark, d).filter("heading is not null")
    number, heading = T.order_parts(F.concat((F.col("section_id") % 200).cast("string"), F.when(F.col("section_id") % 3 == 0, "A").otherwise(""), F.lit("  "), F.col("heading")))
    return s.select("section_id", T.slug(F.col("heading")).alias("slug"), T.title_case(T.simple_lower(F.col("heading"))).alias("title"), number.alias("number"), heading.alias("order_heading"))


def q_trailing_citations(spark, d):
    tail = F.when(F.col("doc_id") % 3 == 0, _lit(["Report of the Committee", "", "(2) 1998, Vol. 570"])).when(F.col("doc_id") % 3 == 1, _lit([" Question of  privilege x "])).otherwise(F.array().cast("array<string>"))
    body, cited = T.trailing_citations(F.concat(F.split(F.coalesce("text", F.lit("")), "\n"), tail))
    return table(spark, d, "documents").select("doc_id", F.size(body).cast("long").alias("body_lines"), F.array_join(cited, "|").alias("citations"))


def q_pdf_normalize(spark, d):
    text = F.concat(F.lit("\r\nV ol. 1 \t\n\n\n\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" \r")), F.lit(" ﬁn ﬂy\r\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(T.pdf_normal(text)).alias("digest"))


def q_strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("digest"), F.md5(T.escape_html(F.col("html"))).alias("escaped"))


def q_highlight(spark, d):
    """The whole texts with two words of each marked, as a phrase where they stand together."""
    words = F.regexp_extract_all(F.col("content"), F.lit("[A-Za-z]+"), 0)
    s = sections(spark, d).select("section_id", "content", words.alias("w")).filter("size(w) >= 6")
    query = F.when(F.col("section_id") % 2 == 0, F.concat_ws(" ", F.col("w")[2], F.col("w")[3])).otherwise(F.col("w")[4])
    return s.select("section_id", F.md5(P.highlight(F.col("content"), query)).alias("digest"))


_SINGULAR = lambda x: f"case when length({x}) <= 3 then {x} when {x} like '%ies' then left({x}, length({x}) - 3) || 'y' when {x} like '%sses' or {x} like '%ses' then left({x}, length({x}) - 2) when {x} like '%s' and {x} not like '%ss' then left({x}, length({x}) - 1) else {x} end"
_MARK = lambda html, x: f"regexp_replace({html}, '(?i)\\b' || {x} || '\\b', '<mark>\\0</mark>', 'g')"


def q_href(spark, d):
    s = sections(spark, d)
    url = F.concat(F.lit("https://example.org/rules/"), "section_key", F.lit("?v=1#old"))
    anchor = F.when(F.col("section_id") % 3 != 0, F.concat(F.lit("so "), "citation_label", F.lit(";(ä)")))
    return s.select("section_id", P.source_href(url, anchor, F.col("content")).alias("href"), P.citation_href(F.col("citation_label"), F.col("corpus"), F.concat("section_key", F.lit(" ~*ö"))).alias("own"))


_JS = lambda x: "replace(replace(replace(replace(replace(url_encode(%s), '%%21', '!'), '%%27', ''''), '%%28', '('), '%%29', ')'), '%%2A', '*')" % x


def q_json_salvage(spark, d):
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    body = F.to_json(F.struct(F.col("conv_id").alias("n"), F.array("turn").alias("t")))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("Here: "), body, F.lit(" ok"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", P.likely_json(reply).alias("json"), F.try_variant_get(P.parsed_json(reply), "$.n", "string").alias("n"))


def q_parse_orders(spark, d):
    """Chapter pages made of sections, ten to a page, parsed back."""
    s = sections(spark, d).withColumn("_line", T.clean(F.concat(F.lit("Members "), F.col("section_id").cast("string"))))
    item = F.concat(F.lit("<p>"), (F.col("section_id") % 500 + 1).cast("string"), F.lit(" "), "_line", F.lit("</p><p>Text <b>of "), "slug", F.lit("<p>A &amp; b<ul><li>one</li><li>two</ul>"))
    rows = s.withColumn("url", F.floor(F.col("section_id") / 10).cast("string")).groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_id", item.alias("h")))), lambda x: x["h"]), "").alias("_h"))
    html = F.concat(F.lit("<html><nav><p>7 No</p></nav><h1>Chapter 3: RULES OF the-debate</h1><h2>PART ONE</h2>"), "_h", F.lit("<p>Share</p><p>9 Late</p></html>"))
    return pages.parse_orders(rows.select("url", html.alias("html"))).select("url", "order_number", "chapter_title", "part_heading", "heading", F.array_join("path", " > ").alias("path_text"), "content")


def q_page_elements(spark, d):
    return pages.elements(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("url"), "html")).groupBy("url").agg(F.count("*").alias("elements"), F.sum(F.length("text")).alias("chars"), F.min_by("text", F.when(F.col("tag") == "h1", F.col("pos"))).alias("title"))


def q_latest_builds(spark, d):
    e = table(spark, d, "events")
    out = corpus.latest_builds(e.select(F.col("user_id").alias("build_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("status"), F.col("event_id").cast("string").alias("notes")))
    return out.select("build_id", F.col("started_at.event_id").alias("started"), "status", "notes")


def q_upsert(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.lit("old").alias("state"))
    new = docs.filter("doc_id % 7 = 0").withColumn("state", F.lit("new")).unionByName(docs.limit(0).unionByName(spark.createDataFrame([(-5, "added", "new")], docs.schema)))
    return corpus.with_ordinals(corpus.upsert(docs, new, ["doc_id"]), "source", "doc_id").withColumn("ordinal", F.col("ordinal").cast("long"))


def q_documents_join(spark, d):
    docs = table(spark, d, "documents").select("source").distinct().select(F.col("source").alias("slug"), F.concat(F.lit("Book "), "source").alias("title"))
    return corpus.joined(sections(spark, d).filter("heading is null"), docs, "slug").groupBy("slug", "title").agg(F.count("*").alias("sections"))


def q_traffic(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("mode"), F.col("user_id").cast("int").alias("latency_ms"))
    out = query_log.traffic(e, window="1 hour")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("started"), "mode", "searches", F.round("latency_ms", 6).alias("latency_ms"))


_D = "with " + _DRAFTS
_NORM = r"""regexp_replace(regexp_replace(regexp_replace(draft, '(?m)^\*\s+', '- ', 'g'), '[ \t]+\n', chr(10), 'g'), '(?im)^bottom line$', 'Bottom line:')"""
_LINES = rf"""fm as (select question_id, replace({_NORM}, 'Best authorities to inspect:', 'Best authorities to inspect or cite:') as t from dr),
ln as (select question_id, unnest(str_split(t, chr(10))) as l, unnest(range(len(str_split(t, chr(10))))) as n from fm),
hd as (select *, case when l in ('Bottom line:', 'What this means:', 'Your options:', 'Risks or constraints:', 'Best authorities to inspect or cite:') then l end as h from ln),
sc as (select *, last_value(h ignore nulls) over (partition by question_id order by n) as s, list_filter(list_transform(regexp_extract_all(l, '\[([^\]]+)\]', 1), lambda x: trim(x)), lambda x: x <> '') as cs from hd)"""
_OK = r"regexp_matches(c, '^(SO 89|22/5)([( ,;:]|$)')"

SQL = {
    "q_profile": f"with {_BOOK}, {_PROFILE} select section_id, authority_class, authority_function from fn",
    "q_slot_match": f"with {_BOOK}, {_PROFILE}, {_slots_sql()} select section_id, slot_key from fn, slots where (len(hs) = 0 or list_contains(hs, h)) and (len(ps) = 0 or len(list_filter(ps, lambda x: contains(p, x))) > 0) and (len(cs) = 0 or list_contains(cs, authority_class)) and (len(fs) = 0 or list_contains(fs, authority_function)) and (len(ks) = 0 or list_contains(ks, corpus)) and (len(ts) = 0 or len(list_filter(ts, lambda x: contains(c, x))) > 0)",
    "q_concepts": f"with {_QS}, {_concepts_sql()} select question_id, concept, place from inf",
    "q_query_plan": f"with {_QS}, {_concepts_sql()}, {_plan_sql()}",
    "q_mentions": _D + r""", m as (select question_id, unnest(list_distinct(regexp_extract_all(regexp_replace(draft, '\[[^\]]+\]', ' ', 'g'), '(?i)\b(?:standing order|so)\s+[0-9]+[a-z]?|\b[0-9]+/[0-9]+\b'))) as mention from dr)
select * from m where trim(lower(regexp_replace(regexp_replace(mention, '(?i)^standing order\s+', 'SO '), '\s+', ' ', 'g'))) not in ('so 89', '22/5')""",
    "q_claims": f"{_D}, {_LINES} select question_id, 'claim-' || (n + 1) as claim_id, n as line_index, array_to_string(cs, '|') as citations from sc where h is null and s in ('Bottom line:', 'What this means:', 'Your options:', 'Risks or constraints:') and len(cs) > 0",
    "q_prune": f"""{_D}, {_LINES}, k as (select *, trim(l) = '' or h is not null or case when s = 'Best authorities to inspect or cite:' then regexp_matches(l, '^-\\s*\\S') when s is not null then len(cs) > 0 and len(list_filter(cs, lambda c: not {_OK})) = 0 else true end as keep from sc)
select question_id, len(str_split(trim(regexp_replace(string_agg(case when keep then l end, chr(10) order by n), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' '), chr(10))) as kept_lines, coalesce(string_agg(case when not keep then l end, '|' order by n), '') as removed from k group by question_id""",
    "q_citations": f"""{_D}, e as (select question_id as answer_id, unnest(list_distinct(list_filter(flatten(list_transform(regexp_extract_all(draft, '\\[([^\\]]+)\\]', 1), lambda x: list_transform(regexp_split_to_array(x, '[;,]'), lambda y: trim(y)))), lambda y: y <> ''))) as citation from dr)
select answer_id, citation, regexp_matches(citation, '^(SO 89|22/5)([( ,;:]|$)') and not regexp_matches(lower(citation), 'mentioned in|referred to in|cited in') as ok from e""",
    "q_discovery": f"with {corpus.SECTIONS_SQL}" + """, k as (select section_id, heading, case when contains(content, chr(10)) then split_part(content, chr(10), 2) else '' end as other from s where heading is not null),
w as (select *, list_filter(regexp_extract_all(lower(heading), '[a-z0-9]+'), lambda x: length(x) >= 3 and x not in ('and', 'are', 'being', 'chamber', 'for', 'from', 'house', 'into', 'that', 'the', 'this', 'was', 'were', 'with')) as a,
  list_filter(regexp_extract_all(lower(other), '[a-z0-9]+'), lambda x: length(x) >= 3 and x not in ('and', 'are', 'being', 'chamber', 'for', 'from', 'house', 'into', 'that', 'the', 'this', 'was', 'were', 'with')) as b from k),
u as (select *, list_filter(a, lambda x, i: list_position(a, x) = i) as a1, len(list_distinct(a)) as na, len(list_distinct(b)) as nb, len(list_intersect(list_distinct(a), list_distinct(b))) as nx from w)
select section_id, left(regexp_replace(regexp_replace(lower(heading), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 64) as key, array_to_string(a1, ' ') as tokens,
  lower(trim(regexp_replace(heading, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(other, '\\s+', ' ', 'g'))) or (na > 0 and nb > 0 and case when na = 1 and nb = 1 then nx = 1 else nx >= 2 end) as affine from u""",
    "q_headings": f"with {corpus.SECTIONS_SQL}" + r""", k as (select section_id, lower(trim(regexp_replace(heading, '\s+', ' ', 'g'))) as h, trim(regexp_replace(heading, '\s+', ' ', 'g')) as hc from s where heading is not null)
select section_id, regexp_replace(regexp_replace(regexp_replace(h, '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug,
  array_to_string(list_transform(str_split(h, ' '), lambda w: case when w in ('of', 'and', 'the', 'to', 'in') then w else array_to_string(list_transform(str_split(w, '-'), lambda p: upper(left(p, 1)) || substr(p, 2)), '-') end), ' ') as title,
  (section_id % 200) || case when section_id % 3 = 0 then 'A' else '' end as number, nullif(hc, '') as order_heading from k""",
    "q_trailing_citations": r"""with l as (select doc_id, list_concat(str_split(coalesce(text, ''), chr(10)), case when doc_id % 3 = 0 then ['Report of the Committee', '', '(2) 1998, Vol. 570'] when doc_id % 3 = 1 then [' Question of  privilege x '] else []::varchar[] end) as ls from documents),
e as (select doc_id, unnest(ls) as x, unnest(range(len(ls))) as n from l),
f as (select *, trim(regexp_replace(x, '\s+', ' ', 'g')) as t from e),
g as (select *, t = '' or regexp_matches(t, '^\(?[0-9]+\)?\s{0,4}[0-9]{4},\s*Vol\.|^[0-9]{4},\s*Vol\.|^Report of |^Question of privilege |^Final report of ') as c from f),
b as (select doc_id, coalesce(max(case when not c then n end), -1) as last from g group by doc_id)
select g.doc_id, any_value(last) + 1 as body_lines, coalesce(string_agg(case when n > last and t <> '' then t end, '|' order by n), '') as citations from g join b using (doc_id) group by g.doc_id""",
    "q_pdf_normalize": r"""with x as (select doc_id, chr(13) || chr(10) || 'V ol. 1 ' || chr(9) || repeat(chr(10), 4) || replace(coalesce(text, ''), chr(10), ' ' || chr(13)) || ' ﬁn ﬂy' || chr(13) || chr(10) as t from documents),
y as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') as t from x)
select doc_id, md5(regexp_replace(replace(replace(replace(t, 'V ol.', 'Vol.'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '^\s+|\s+$', '', 'g')) as digest from y""",
    "q_strip_tags": "select page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) as digest, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as escaped from pages",
    "q_highlight": f"with {corpus.SECTIONS_SQL}, w as (select section_id, content, regexp_extract_all(content, '[A-Za-z]+') as w from s), q as (select section_id, content, replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as html, section_id % 2 = 0 as two, w[3] as a, w[4] as b, w[5] as c from w where len(w) >= 6),"
    + f" t as (select *, a || ' ' || b as ph, nullif(lower({_SINGULAR('lower(a)')} || ' ' || {_SINGULAR('lower(b)')}), lower(a || ' ' || b)) as sg from q),"
    + " u as (select *, two and regexp_matches(content, '(?i)\\b' || ph || '\\b') as hp, two and sg is not null and regexp_matches(content, '(?i)\\b' || sg || '\\b') as hs from t),"
    + f" v as (select section_id, case when hp or hs then case when hs then {_MARK('case when hp then ' + _MARK('html', 'ph') + ' else html end', 'sg')} else {_MARK('html', 'ph')} end when two then {_MARK(_MARK('html', '(' + _SINGULAR('a') + ')'), '(' + _SINGULAR('b') + ')')} else {_MARK('html', '(' + _SINGULAR('c') + ')')} end as h from u) select section_id, md5(h) as digest from v",
    "q_href": f"with {corpus.SECTIONS_SQL}"
    + r""", x as (select *, array_to_string(str_split(trim(regexp_replace(regexp_replace(content, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), ' ')[1:10], ' ') as st, 'https://example.org/rules/' || section_key || '?v=1' as base, case when section_id % 3 <> 0 then 'so%20' || citation_label || ';(%C3%A4)' end as an from s)
select section_id, base || case when an is not null and st <> '' then '#' || an || ':~:text=' || """ + _JS("st") + r""" when st <> '' then '#:~:text=' || """ + _JS("st") + r""" when an is not null then '#' || an else '' end as href,
  '/?q=' || replace(citation_label, '/', '%2F') || '&corpus=' || corpus || '&focus=' || section_key || '+%7E*%C3%B6' as own from x""",
    "q_json_salvage": r"""select conv_id, turn, case when turn % 3 = 2 then coalesce(nullif(regexp_extract(t, '(?s)\{.*\}', 0), ''), nullif(regexp_extract(t, '(?s)\[.*\]', 0), ''), t) else '{"n":' || conv_id || ',"t":[' || turn || ']}' end as json, case when turn % 3 <> 2 then cast(conv_id as varchar) end as n from (select *, regexp_replace(text, '^\s+|\s+$', '', 'g') as t from conversations where role = 'assistant')""",
    "q_parse_orders": f"with {corpus.SECTIONS_SQL} select cast(section_id // 10 as varchar) as url, cast(section_id % 500 + 1 as varchar) as order_number, 'Rules of The-Debate' as chapter_title, 'PART ONE' as part_heading, 'Members ' || section_id as heading, 'Chapter 3 > Rules of The-Debate > PART ONE > SO ' || (section_id % 500 + 1) || ' > Members ' || section_id as path_text, 'Text of ' || slug || chr(10) || chr(10) || 'A & b' || chr(10) || chr(10) || '• one' || chr(10) || chr(10) || '• two' as content from s",
    "q_latest_builds": "select user_id as build_id, arg_min(event_id, struct_pack(ts := ts, event_id := event_id)) as started, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) as status, cast(arg_max(event_id, struct_pack(ts := ts, event_id := event_id)) as varchar) as notes from events group by user_id",
    "q_upsert": "with u as (select doc_id, source, case when doc_id % 7 = 0 then 'new' else 'old' end as state from documents union all select -5, 'added', 'new') select *, row_number() over (partition by source order by doc_id) as ordinal from u",
    "q_documents_join": f"with {corpus.SECTIONS_SQL} select slug, 'Book ' || slug as title, count(*) as sections from s where heading is null and slug is not null group by slug",
    "q_traffic": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as started, event_type as mode, count(*) as searches, round(avg(user_id), 6) as latency_ms from events group by all",
}


def queries() -> dict:
    return {name: function for name, function in globals().items() if name.startswith("q_")}
