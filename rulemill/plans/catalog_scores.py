"""Queries over the scores of authorities: frames, blueprints, route and slot boosts; and their SQL. Each section of the rule book stands
with one question, by the remainder of its id."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import concepts
from ..sources.staging import stage
from . import catalog_rules
from .catalog_rules import _list, _questions, rulebook
from .registry import CONCEPTS, registry

ITEMS = 7


def _inferred(spark, d):
    q = _questions(spark, d)
    return q, stage(concepts.infer_concepts(q, registry(spark)), "inferred")


def q_frames(spark, d):
    q, inferred = _inferred(spark, d)
    f = concepts.frames(q, inferred)
    return f.select("question_id", F.array_join("concepts", "|").alias("concepts"), *concepts.FLAGS)


def _stood(spark, d):
    """The profiled sections with the question that each stands with, and its last planned query."""
    q, inferred = _inferred(spark, d)
    own = q.filter(F.col("question_id") < ITEMS).select("question_id", F.element_at("planned", -1).alias("query"))
    rows = concepts.profiled(rulebook(spark, d)).withColumn("question_id", F.col("section_id") % ITEMS).join(own, "question_id")
    return rows, q, inferred


def q_route_boost(spark, d):
    rows, q, inferred = _stood(spark, d)
    rows = rows.join(concepts.frames(q, inferred), "question_id")
    return rows.select("section_id", "question_id", concepts.route_boost().cast("long").alias("boost"))


def q_blueprint(spark, d):
    _, inferred = _inferred(spark, d)
    return concepts.blueprint(inferred, registry(spark)).select("question_id", F.array_join(F.transform("slots", lambda s: F.concat(s["key"], F.lit(":"), s["requirement"])), "|").alias("slots"))


def q_slot_boost(spark, d):
    rows, q, inferred = _stood(spark, d)
    active = inferred.groupBy("question_id").agg(F.collect_set("concept").alias("active"))
    rows = rows.join(concepts.blueprint(inferred, registry(spark)), "question_id").join(active, "question_id")
    s = concepts.slot_scores(rows)
    return s.select("section_id", "question_id", F.array_join(F.transform("matched", lambda m: m["key"]), "|").alias("matched"), F.col("slot_boost").cast("long").alias("slot_boost"), F.col("preferred_boost").cast("long").alias("preferred_boost"), F.col("bridge_boost").cast("long").alias("bridge_boost"))


PROVENANCE = ("planner", "user_term", "corpus_bridge")


def _searched(spark, d):
    """(searches, results, inferred): three searches of each question, for headings of the rule book, and sections as what they found."""
    q, inferred = _inferred(spark, d)
    n = F.col("section_id")
    heads = F.array(*[F.lit(h) for h in catalog_rules.HEADINGS])
    own = q.filter(F.col("question_id") < ITEMS).select("question_id", F.posexplode(F.array(*[F.lit(p) for p in PROVENANCE])).alias("query_index", "provenance"))
    text = F.element_at(heads, (F.col("question_id") + F.when(F.col("query_index") == 1, ITEMS).otherwise(0) + 1).cast("int"))
    label = F.when(F.col("query_index") == 2, "SO 1")
    searches = own.select("question_id", "query_index", F.when(F.col("query_index") == 1, F.concat(F.lit(" the  "), F.lower(text))).otherwise(text).alias("query"), "provenance", F.lit(None).cast("string").alias("search_corpus"), label.alias("bridge_source_query"), label.alias("bridge_source_label"))
    met = rulebook(spark, d).select("section_id", "heading", "citation_label", "corpus", (n % ITEMS).alias("question_id"), (F.floor(n / ITEMS) % 3).cast("int").alias("query_index")).join(searches.select("question_id", "query_index", "query"), ["question_id", "query_index"])
    h, w = F.lower("heading"), F.lower(F.trim("query"))
    place = F.row_number().over(W.partitionBy("question_id", "query_index").orderBy("section_id"))
    results = met.select("question_id", "query_index", "query", "section_id", "heading", "citation_label", "corpus", place.alias("place"), (n % 300).cast("double").alias("rank"), (n % 5).alias("cluster_support"), (h == w).alias("exact_heading"), (w.contains(h) & (n % 2 == 0)).alias("heading_match"))
    return searches, stage(results, "found"), inferred


def q_heading_evidence(spark, d):
    _, results, _ = _searched(spark, d)
    return concepts.heading_evidence(results).select("question_id", "query_index", "evidence.heading", "evidence.n", "evidence.exact", "evidence.phrases", "evidence.rank", "evidence.support")


def q_discover(spark, d):
    searches, results, inferred = _searched(spark, d)
    out = concepts.discover(searches, results, inferred, registry(spark))
    return out.select("question_id", "query_index", "query", "provenance", "status", "concept_id", "heading", "evidence_count", "slot_key", "bridge_source_query", "bridge_source_label", "validation")


_INF = f"{catalog_rules._QS}, {catalog_rules._concepts_sql()}"
_ACTIVE = "act as (select question_id, list(concept order by place) as cs from inf group by question_id)"
_FLAGS = ", ".join(f"coalesce(len(list_intersect(cs, {_list(c)})) > 0, false) as {flag}" for flag, c in concepts.FLAGS.items())
_FRAMES = f"fr as (select qs.question_id, coalesce(array_to_string(cs, '|'), '') as concepts, {_FLAGS} from qs left join act on qs.question_id = act.question_id)"
_STOOD = f"""st as (select fn.*, h as _h, p as _p, c as _c, section_id % {ITEMS} as question_id, contains(p, 'committees of the whole house') as is_committee_of_whole, h = 'chairperson' as is_chairperson,
  contains(p, 'chairpersons of select committees') or contains(p, 'questions to other members') as is_select_chairs, contains(p, 'personal reflections') as is_personal_reflections, h = 'against members' as is_against_members,
  h = 'allegations of racism' as is_allegations_of_racism, h in ('points of order', 'point of order') as is_points_of_order, h = 'relevancy' or contains(p, 'relevancy') as is_relevancy, contains(h, 'closure') or contains(p, 'closure of debate') as is_closure from fn),
sq as (select st.*, lower(planned[-1]) as q from st join qs on qs.question_id = st.question_id)"""
_BOOST = " + ".join(
    [f"case when {flag} and ({when}) then {boost} else 0 end" for flag, when, boost in concepts.FRAME_BOOSTS] + [f"case when contains(q, '{word}') and ({when}) then {boost} else 0 end" for word, when, boost in concepts.QUERY_BOOSTS]
)


def _texts(slot: dict, name: str) -> str:
    return _list([x.lower() for x in slot.get(name) or ()]) + "::varchar[]"


_ROWS = ", ".join(
    f"('{c['concept']}', {i}, '{s['key']}', '{s['requirement']}', {_texts(s, 'headings')}, {_texts(s, 'path_includes')}, {_texts(s, 'classes')}, {_texts(s, 'functions')}, {_texts(s, 'corpora')}, {_texts(s, 'required_text')}, {_texts(s, 'preferred_text')})"
    for c in CONCEPTS
    for i, s in enumerate(c["slots"])
)
_CONTEXT = ", ".join(
    f"('{c['concept']}', {i}, {_texts(x, 'any')}, {_texts(x, 'all')}, {_texts(x, 'text')}, {x.get('bonus') or concepts.CONTEXT_BOOST})" for c in CONCEPTS for i, s in enumerate(c["slots"]) for x in s.get("contextual") or ()
)
_GONE = ", ".join(f"('{c['concept']}', '{k}')" for c in CONCEPTS for k in c.get("supersedes") or ())
_PRINT = f"""sl as (select * from (values {_ROWS}) t(concept, i, key, requirement, hs, ps, cls, fns, ks, ts, pref)), gone as (select * from (values {_GONE}) t(concept, key)),
bp as (select inf.question_id, inf.place, sl.* from inf join sl using (concept) where not exists (select 1 from inf g join gone on gone.concept = g.concept where g.question_id = inf.question_id and gone.key = sl.key)),
bo as (select * from bp qualify row_number() over (partition by question_id, key order by place, i) = 1)"""
_FITS = "(len(hs) = 0 or list_contains(hs, h)) and (len(ps) = 0 or len(list_filter(ps, lambda x: contains(p, x))) > 0) and (len(cls) = 0 or list_contains(cls, authority_class)) and (len(fns) = 0 or list_contains(fns, authority_function)) and (len(ks) = 0 or list_contains(ks, corpus)) and (len(ts) = 0 or len(list_filter(ts, lambda x: contains(c, x))) > 0)"
_BOOK = f"{catalog_rules._BOOK}, {catalog_rules._PROFILE}"

_HEADS = _list(catalog_rules.HEADINGS)
_SEARCHED = f"""sr as (select question_id, i as query_index, case when i = 1 then ' the  ' || lower(hs[question_id + {ITEMS} + 1]) else hs[question_id + 1] end as query, {_list(PROVENANCE)}[i + 1] as provenance, case when i = 2 then 'SO 1' end as source
  from (select question_id, {_HEADS} as hs, unnest([0, 1, 2]) as i from qs where question_id < {ITEMS})),
rs as (select sr.*, s.section_id, bk.heading, s.citation_label, bk.corpus, row_number() over (partition by question_id, query_index order by s.section_id) as place, cast(s.section_id % 300 as double) as rank, s.section_id % 5 as support,
  lower(bk.heading) = lower(trim(query)) as exact, contains(lower(trim(query)), lower(bk.heading)) and s.section_id % 2 = 0 as phrase
  from bk join s using (section_id) join sr on sr.question_id = s.section_id % {ITEMS} and sr.query_index = (s.section_id // {ITEMS}) % 3),
hg as (select question_id, query_index, lower(heading) as hn, arg_min(heading, place) as heading, count(*) as n, count(*) filter (exact) as exact, count(*) filter (phrase) as phrases, greatest(max(rank), 0.0) as rank, max(support) as support from rs where exact or phrase group by all),
he as (select * from hg qualify row_number() over (partition by question_id, query_index order by exact desc, n desc, rank desc, hn desc) = 1)"""
_STOP = "'and', 'are', 'being', 'chamber', 'for', 'from', 'house', 'into', 'that', 'the', 'this', 'was', 'were', 'with'"
_TOKENS = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) >= 3 and w not in ({_STOP})))"
_KEY = lambda x: f"left(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 64)"
_TERMS = ", ".join(f"('{c['concept']}', {_list([x.lower() for k in ('aliases', 'planner_triggers', 'preferred_queries') for x in c.get(k) or ()])}::varchar[])" for c in CONCEPTS)
_GENERIC = ", ".join(f"'{x}'" for x in concepts.GENERIC_HEADINGS)
_DISCOVER = f"""{_SEARCHED}, tm as (select * from (values {_TERMS}) t(concept, terms)), kn as (select question_id, flatten(list(terms)) as known from inf join tm using (concept) group by question_id),
a as (select sr.question_id, sr.query_index, trim(regexp_replace(sr.query, '\\s+', ' ', 'g')) as query, sr.provenance, sr.source, he.* exclude (question_id, query_index), coalesce(known, []) as known, {_TOKENS("sr.query")} as ta, {_TOKENS("he.heading")} as tb
  from sr left join he on he.question_id = sr.question_id and he.query_index = sr.query_index left join kn on kn.question_id = sr.question_id),
b as (select *, lower(query) = hn or (len(ta) > 0 and len(tb) > 0 and case when len(ta) = 1 and len(tb) = 1 then len(list_intersect(ta, tb)) = 1 else len(list_intersect(ta, tb)) >= 2 end) as affine, provenance = 'corpus_bridge' as bridge from a),
v as (select *, case when list_contains(known, lower(query)) and query <> '' then 'covered' when lower(query) in ({", ".join(f"'{x}'" for x in concepts.STOP_QUERIES)}) then 'generic_query' when hn is null then 'no_heading_evidence' when hn in ({_GENERIC}) then 'generic_heading'
  when bridge and n >= 2 and support >= 2 and rank >= {concepts.CLUSTER_RANK} and (exact >= 2 or phrases >= 2) then 'bridge' when not bridge and affine and exact >= 1 and (rank >= {concepts.EXACT_RANK} or n >= 2) then 'exact_heading'
  when not bridge and affine and phrases >= 2 and rank >= {concepts.CLUSTER_RANK} then 'heading_cluster' when bridge then 'weak_bridge' when not affine then 'no_affinity' else 'below_threshold' end as validation from b),
w as (select *, case when validation = 'covered' then 'covered_by_static' when validation in ('bridge', 'exact_heading', 'heading_cluster') then 'promoted' else 'rejected' end as status, validation not in ('covered', 'generic_query', 'no_heading_evidence') as seen from v),
x as (select question_id, query_index, query, provenance, status, case status when 'covered_by_static' then 'static:' || {_KEY("query")} when 'promoted' then 'discovered:' || {_KEY("heading")} else 'rejected:' || {_KEY("query")} end as concept_id,
  case when seen then heading end as heading, case when seen then n else 0 end as evidence_count, case when status = 'promoted' then 'discovered_' || {_KEY("heading")} end as slot_key, source, validation from w),
cr as (select r.question_id, r.query_index, arg_min(r.citation_label, r.place) as label, arg_min(lower(r.heading), r.place) as hn from rs r left join kn on kn.question_id = r.question_id
  where r.place <= 3 and lower(r.heading) not in ({_GENERIC}) and lower(r.heading) <> lower(trim(regexp_replace(r.query, '\\s+', ' ', 'g'))) and not list_contains(coalesce(known, []), lower(r.heading)) group by all),
ow as (select question_id, lower(heading) as hn, arg_max(concept_id, query_index) as concept_id, arg_max(heading, query_index) as heading, arg_max(slot_key, query_index) as slot_key from x where status = 'promoted' group by all),
fd as (select x.question_id, x.query_index, cr.label, ow.concept_id, ow.heading, ow.slot_key from x join cr on cr.question_id = x.question_id and cr.query_index = x.query_index join ow on ow.question_id = x.question_id and ow.hn = cr.hn where status = 'rejected' and provenance in ('planner', 'user_term'))
select x.question_id, x.query_index, x.query, x.provenance, case when fd.label is null then status else 'bound_to_promoted' end as status, coalesce(fd.concept_id, x.concept_id) as concept_id, case when fd.label is null then x.heading else fd.heading end as heading,
  case when fd.label is null then evidence_count else 1 end as evidence_count, case when fd.label is null then x.slot_key else fd.slot_key end as slot_key, case when fd.label is null then source else x.query end as bridge_source_query,
  case when fd.label is null then source else fd.label end as bridge_source_label, case when fd.label is null then validation else 'breadcrumb' end as validation
from x left join fd on fd.question_id = x.question_id and fd.query_index = x.query_index"""

SQL = {
    "q_heading_evidence": f"with {catalog_rules._BOOK}, {catalog_rules._QS}, {_SEARCHED} select question_id, query_index, heading, n, exact, phrases, rank, support from he",
    "q_discover": f"with {catalog_rules._BOOK}, {_INF}, {_DISCOVER}",
    "q_frames": f"with {_INF}, {_ACTIVE}, {_FRAMES} select * from fr",
    "q_route_boost": f"with {_BOOK}, {_INF}, {_ACTIVE}, {_FRAMES}, {_STOOD} select section_id, sq.question_id, cast({_BOOST} as bigint) as boost from sq join fr on fr.question_id = sq.question_id",
    "q_blueprint": f"with {_INF}, {_PRINT} select question_id, string_agg(key || ':' || requirement, '|' order by place, i) as slots from bo group by question_id",
    "q_slot_boost": f"""with {_BOOK}, {_INF}, {_ACTIVE}, {_PRINT}, {_STOOD}, ctx as (select * from (values {_CONTEXT}) t(concept, i, anys, alls, said, bonus)),
m as (select sq.section_id, sq.question_id, sq.c, bo.concept, bo.place, bo.i, bo.key, len(list_filter(pref, lambda x: contains(c, x))) as preferred from sq join bo on bo.question_id = sq.question_id where {_FITS}),
x as (select m.section_id, sum(bonus * len(list_filter(said, lambda s: contains(m.c, s)))) as bridge from m join ctx on ctx.concept = m.concept and ctx.i = m.i join act on act.question_id = m.question_id
  where (len(anys) = 0 or len(list_intersect(anys, cs)) > 0) and len(list_intersect(alls, cs)) = len(alls) group by m.section_id),
k as (select section_id, string_agg(key, '|' order by place, i) as matched, count(*) as n, sum(preferred) as preferred from m group by section_id)
select sq.section_id, sq.question_id, coalesce(matched, '') as matched, cast(coalesce(n, 0) * {concepts.SLOT_BOOST} as bigint) as slot_boost, cast(coalesce(preferred, 0) * {concepts.PREFERRED_BOOST} as bigint) as preferred_boost, cast(coalesce(bridge, 0) as bigint) as bridge_boost
from sq join (select distinct question_id from bo) b on b.question_id = sq.question_id left join k on k.section_id = sq.section_id left join x on x.section_id = sq.section_id""",
}


def queries() -> dict:
    return {name: function for name, function in globals().items() if name.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return SQL
