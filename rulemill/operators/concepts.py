"""Concepts of questions, query plans, authority scoring, discovery, recovery and slot-covering selection.

Everything is keyed by question, so one job serves any number of them. The registry is a table of the code's own
concepts, so its size is known. Inputs: questions (question_id, question, planned array, terms array); searches' results (question_id, query_index,
query, provenance, search_corpus, bridge_source_query, bridge_source_label, place, and the columns of a search: section_id,
citation_label, heading, path, corpus, content, rank, cluster_support, exact_key, exact_citation, exact_heading, heading_match,
body_match, path_match).
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean, discovery_key, heading_affinity
from ..plans import registry as R
from ..sources.staging import stage


def lowered(x: Column) -> Column:
    return F.lower(clean(x))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def holds_any(text: Column, phrases: Column) -> Column:
    """Whether a text holds any of an array of phrases, in lower case."""
    return F.exists(F.coalesce(phrases, F.array().cast("array<string>")), lambda p: text.contains(F.lower(p)))


def infer_concepts(questions: DataFrame, registry: DataFrame, phrases=R.PHRASES) -> DataFrame:
    """(question_id, concept, place): concepts by alias in the registry's order, then by phrases, then by the planner's queries;
    the first mention counts."""
    rules = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(c).alias("concept"), _strings(words).alias("words")) for i, (words, own) in enumerate(phrases) for j, c in enumerate(own)])
    q = questions.select("question_id", F.lower("question").alias("_q"), F.transform(F.coalesce("planned", F.array().cast("array<string>")), lowered).alias("_planned"))
    reg = F.broadcast(registry.select("concept", "ord", "aliases", F.transform(F.coalesce("planner_triggers", F.array().cast("array<string>")), lowered).alias("_triggers")))
    by_rule = q.select("question_id", F.explode(F.filter(rules, lambda r: F.exists(r["words"], lambda w: F.col("_q").contains(w)))).alias("_r")).select("question_id", "_r.concept", F.struct(F.lit(1).alias("step"), F.col("_r.i").alias("i"), F.col("_r.j").alias("j")).alias("at"))
    alias, trigger = holds_any(F.col("_q"), F.col("aliases")), F.arrays_overlap("_planned", F.filter("_triggers", lambda t: t != ""))
    met = q.join(reg, alias | trigger)
    steps = F.array_compact(F.array(F.when(alias, F.lit(0)), F.when(trigger, F.lit(2))))
    by_registry = met.select("question_id", "concept", "ord", F.explode(steps).alias("_s")).select("question_id", "concept", F.struct(F.col("_s").alias("step"), F.col("ord").alias("i"), F.lit(0).alias("j")).alias("at"))
    known = by_rule.join(reg.select("concept"), "concept", "left_semi").select("question_id", "concept", "at")
    first = known.unionByName(by_registry).groupBy("question_id", "concept").agg(F.min("at").alias("at"))
    return first.select("question_id", "concept", F.row_number().over(W.partitionBy("question_id").orderBy("at")).cast("long").alias("place"))


FLAGS = {
    "committee_of_whole": ["committee_of_whole"], "member_conduct": ["personal_reflection", "allegation_of_racism"], "closure": ["closure_motion"],
    "relevancy": ["relevancy"], "ministerial_accountability": ["ministerial_accountability"], "retrospective_discipline": ["retrospective_discipline"],
}


def frames(questions: DataFrame, inferred: DataFrame) -> DataFrame:
    """(question_id, concepts, flags): one row a question; concepts in order of mention."""
    own = inferred.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "concept"))), lambda x: x["concept"]).alias("concepts"))
    out = questions.select("question_id").distinct().join(own, "question_id", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    return out.select("question_id", "concepts", *[F.arrays_overlap("concepts", _strings(c)).alias(flag) for flag, c in FLAGS.items()])


def expansions(query: Column) -> Column:
    """The canonical searches of a query; itself where no rule knows it, none for a blank one."""
    q = lowered(query)
    table = F.create_map(*[x for k, v in R.EXPANSIONS.items() for x in (F.lit(k), _strings(v))])
    rules = [F.when(reduce(lambda a, b: a & b, [q.contains(w) for w in words]), _strings(out)) for words, out in R.EXPANSION_RULES]
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.coalesce(F.try_element_at(table, q), *rules, F.array(query)))


def query_plan(questions: DataFrame, inferred: DataFrame, registry: DataFrame, most: int = 8, additions=R.ADDITIONS) -> DataFrame:
    """(question_id, place, query, provenance): the planner's queries, user terms, canonical expansions of both, then the concepts'
    own queries and additions; the first of equals stays, at most eight."""

    def listed(name: str, rank: int, provenance: str, expand: bool = False) -> DataFrame:
        each = questions.select("question_id", F.posexplode(name).alias("_at", "query"))
        if expand:
            each = each.select("question_id", "_at", F.col("query").alias("_raw"), F.posexplode(expansions(F.col("query"))).alias("_j", "query")).filter(lowered(F.col("query")) != lowered(F.col("_raw")))
        else:
            each = each.withColumn("_j", F.lit(0))
        return each.select("question_id", F.struct(F.lit(rank).alias("r"), F.col("_at").cast("long").alias("i"), F.col("_j").cast("long").alias("j")).alias("at"), "query", F.lit(provenance).alias("provenance"))

    own = inferred.join((registry.select("concept", "preferred_queries")), "concept").select("question_id", F.col("place").alias("_i"), F.posexplode("preferred_queries").alias("_j", "query"))
    own = own.select("question_id", F.struct(F.lit(4).alias("r"), F.col("_i").alias("i"), F.col("_j").cast("long").alias("j")).alias("at"), "query", F.lit("registry_expansion").alias("provenance"))
    extra = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.lit(q).alias("query"), _strings(c).alias("any")) for i, (c, own_) in enumerate(additions) for j, q in enumerate(own_)])
    active = inferred.groupBy("question_id").agg(F.collect_set("concept").alias("_c"))
    more = active.select("question_id", F.explode(F.filter(extra, lambda x: F.arrays_overlap(x["any"], F.col("_c")))).alias("_x")).select("question_id", F.struct(F.lit(5).alias("r"), F.col("_x.i").alias("i"), F.col("_x.j").alias("j")).alias("at"), F.col("_x.query").alias("query"), F.lit("registry_expansion").alias("provenance"))
    parts = [listed("planned", 0, "planner"), listed("terms", 1, "user_term"), listed("planned", 2, "registry_expansion", True), listed("terms", 3, "registry_expansion", True), own, more]
    every = reduce(DataFrame.unionByName, parts).withColumn("query", clean(F.col("query"))).filter("query <> ''")
    once = every.groupBy("question_id", F.lower("query").alias("_l")).agg(F.min(F.struct("at", "query", "provenance")).alias("_m")).select("question_id", "_m.*")
    placed = once.withColumn("place", F.row_number().over(W.partitionBy("question_id").orderBy("at"))).filter(F.col("place") <= most)
    return placed.select("question_id", F.col("place").cast("long").alias("place"), "query", "provenance")


# Phrases that tell a text's function.
EXCEPTION = ["nothing to prevent", "does not prevent", "not prohibited", "may be made as long as", "may be referred to", "cannot see that i should rule out"]
CONSTRAINT = ["unless ", "only if", "only where", "would have to be", "should not be curtailed", "depends on", "cannot take exception"]
RULE = ["out of order", "not in order", "prohibits", "must not", "may not", "is inappropriate", "are inappropriate", "should not"]


def profile(heading: Column, path: Column, content: Column) -> dict[str, Column]:
    """Flags, class and function of an authority."""
    h, p, c = F.lower(F.coalesce(heading, F.lit(""))), F.lower(F.array_join(path, " > ")), F.lower(content)
    said = lambda words: reduce(lambda a, b: a | b, [c.contains(w) for w in words])
    f = {
        "is_committee_of_whole": p.contains("committees of the whole house"),
        "is_committee_stage": p.contains("committee stage") | p.contains("amendments"),
        "is_rules_of_debate": p.contains("rules of debate"),
        "is_personal_reflections": p.contains("personal reflections"),
        "is_against_members": h == "against members",
        "is_allegations_of_racism": h == "allegations of racism",
        "is_chairperson": h == "chairperson",
        "is_points_of_order": h.isin("points of order", "point of order"),
        "is_relevancy": (h == "relevancy") | p.contains("relevancy"),
        "is_select_chairs": p.contains("chairpersons of select committees") | p.contains("questions to other members"),
        "is_closure": h.contains("closure") | p.contains("closure of debate"),
        "is_acceptance": h.contains("acceptance") | p.contains("acceptance of closure motion"),
        "is_effect": h.contains("effect") | p.contains("effect of carrying"),
    }
    kind = (
        F.when(f["is_points_of_order"], "procedural_mechanism").when(f["is_chairperson"], "chair_control")
        .when(f["is_acceptance"] | f["is_effect"] | h.isin("procedure", "form of reply", "withdrawal"), "constraint_or_qualification")
        .when(f["is_against_members"] | f["is_allegations_of_racism"] | f["is_relevancy"] | f["is_closure"] | (h == "accountability to the house"), "governing_rule")
        .when(f["is_rules_of_debate"] | f["is_committee_stage"] | f["is_personal_reflections"], "analogy_or_support").otherwise("miscellaneous")
    )
    use = (
        F.when(f["is_points_of_order"], "procedure").when(said(EXCEPTION), "exception").when(f["is_effect"], "effect")
        .when(f["is_acceptance"] | h.isin("form of reply", "withdrawal") | said(CONSTRAINT), "constraint").when(h == "procedure", "procedure")
        .when(said(RULE), "rule").when(kind == "governing_rule", "application").otherwise("context")
    )
    return {**f, "authority_class": kind, "authority_function": use, "_h": h, "_p": p, "_c": c}


def profiled(results: DataFrame) -> DataFrame:
    return results.withColumns(profile(F.col("heading"), F.col("path"), F.col("content")))


def _within(value: Column, allowed: Column) -> Column:
    """No list, or the value is on it."""
    return (F.coalesce(F.size(allowed), F.lit(0)) <= 0) | F.coalesce(F.array_contains(F.transform(allowed, F.lower), F.lower(value)), F.lit(False))


def _held(text: Column, phrases: Column) -> Column:
    return (F.coalesce(F.size(phrases), F.lit(0)) <= 0) | holds_any(text, phrases)


def fits_slot(s: Column) -> Column:
    """Whether a profiled row fits a slot struct: all of its lists that are given."""
    exact = lambda value, allowed: (F.coalesce(F.size(allowed), F.lit(0)) <= 0) | F.coalesce(F.array_contains(allowed, value), F.lit(False))
    return _within(F.col("_h"), s["headings"]) & _held(F.col("_p"), s["path_includes"]) & exact(F.col("authority_class"), s["classes"]) & exact(F.col("authority_function"), s["functions"]) & exact(F.col("corpus"), s["corpora"]) & _held(F.col("_c"), s["required_text"])


def fits_exclusion(e: Column) -> Column:
    return _within(F.col("_h"), e["headings"]) & _held(F.col("_p"), e["path_includes"])


# Boosts by a frame's flag, then by words of the query: (flag or word, condition on the profile, boost).
FRAME_BOOSTS = [
    ("committee_of_whole", "is_committee_of_whole", 120),
    ("committee_of_whole", "is_chairperson and is_committee_of_whole", 140),
    ("committee_of_whole", "is_select_chairs", -260),
    ("member_conduct", "is_personal_reflections", 140),
    ("member_conduct", "is_against_members", 160),
    ("member_conduct", "is_allegations_of_racism", 180),
    ("member_conduct", "_h = 'procedure' and is_personal_reflections", 120),
    ("member_conduct", "contains(_p, 'judiciary')", -180),
    ("member_conduct", "contains(_p, 'questions to ministers and members')", -180),
    ("closure", "contains(_h, 'closure')", 140),
    ("closure", "contains(_p, 'closure of debate')", 120),
    ("closure", "is_points_of_order", 60),
    ("relevancy", "is_relevancy", 130),
    ("relevancy", "is_committee_of_whole and is_chairperson", 100),
    ("ministerial_accountability", "_h = 'accountability to the house'", 170),
    ("ministerial_accountability", "_h = 'form of reply'", 150),
    ("ministerial_accountability", "is_points_of_order", 80),
    ("retrospective_discipline", "_h = 'withdrawal'", 170),
    ("retrospective_discipline", "_h = 'procedure'", 130),
    ("retrospective_discipline", "is_points_of_order", 70),
]
QUERY_BOOSTS = [
    ("point of order", "is_points_of_order", 100),
    ("relevancy", "is_relevancy", 90),
    ("chairperson", "is_chairperson", 90),
    ("against members", "is_against_members", 110),
    ("allegations of racism", "is_allegations_of_racism", 120),
    ("closure motion", "is_closure", 100),
]
SLOT_BOOST, PREFERRED_BOOST, CONTEXT_BOOST, BREADCRUMB_BOOST = 180, 120, 180, 260


def route_boost() -> Column:
    """Of a profiled row with the frame's flags and its query."""
    q = F.lower("query")
    total = sum((F.when(F.col(flag) & F.expr(when), boost).otherwise(0) for flag, when, boost in FRAME_BOOSTS), F.lit(0))
    return sum((F.when(q.contains(word) & F.expr(when), boost).otherwise(0) for word, when, boost in QUERY_BOOSTS), total)


def _count_held(text: Column, phrases: Column) -> Column:
    return F.size(F.filter(F.coalesce(phrases, F.array().cast("array<string>")), lambda p: text.contains(F.lower(p))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def slot_scores(scored: DataFrame) -> DataFrame:
    """Adds matched (slot structs), slot_boost, preferred_boost and bridge_boost to profiled rows with `slots` and `active` concepts."""
    none = F.array().cast("array<string>")

    def context(s: Column) -> Column:
        def worth(p: Column) -> Column:
            any_, all_ = F.coalesce(p["any"], none), F.coalesce(p["all"], none)
            holds = ((F.size(any_) == 0) | F.arrays_overlap(any_, F.col("active"))) & (F.size(F.array_except(all_, F.col("active"))) == 0)
            return F.when(holds, _count_held(F.col("_c"), p["text"]) * F.coalesce(p["bonus"], F.lit(CONTEXT_BOOST))).otherwise(0)

        return F.coalesce(_sum(F.transform(s["contextual"], worth)), F.lit(0))

    out = scored.withColumn("matched", F.filter("slots", fits_slot))
    return out.withColumns(
        {
            "slot_boost": F.size("matched") * SLOT_BOOST,
            "preferred_boost": _sum(F.transform("matched", lambda s: _count_held(F.col("_c"), s["preferred_text"]) * PREFERRED_BOOST)),
            "bridge_boost": _sum(F.transform("matched", context)),
        }
    )


def blueprint(inferred: DataFrame, registry: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """(question_id, slots): the active concepts' slots in order, each key once, without superseded ones, then discovered slots
    (question_id, ord, slot)."""
    own = inferred.join((registry.select("concept", "slots", "supersedes")), "concept")
    gone = own.groupBy("question_id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("supersedes", F.array().cast("array<string>"))))).alias("_gone"))
    each = own.select("question_id", F.col("place").alias("_a"), F.posexplode("slots").alias("_b", "slot")).select("question_id", F.struct(F.lit(0).alias("r"), F.col("_a").alias("a"), F.col("_b").cast("long").alias("b")).alias("at"), "slot")
    each = each.join(gone, "question_id").filter(~F.array_contains("_gone", F.col("slot.key"))).drop("_gone")
    if discovered is not None:
        each = each.unionByName(discovered.select("question_id", F.struct(F.lit(1).alias("r"), F.col("ord").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("at"), "slot"))
    once = each.groupBy("question_id", F.col("slot.key").alias("_k")).agg(F.min("at").alias("at"), F.min_by("slot", "at").alias("slot"))
    return once.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "slot")), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)), lambda x: x["slot"]).alias("slots"))


# Queries and headings too general to make a concept of.
STOP_QUERIES = ["procedure", "procedures", "rule", "rules", "house", "debate", "member", "speaker", "chair"]
GENERIC_HEADINGS = [*STOP_QUERIES, "general", "general procedures", "maintenance of order", "parliament house", "questions", "motions", "example", "examples"]
#: Ranks from which heading evidence makes a concept.
EXACT_RANK, CLUSTER_RANK = 120, 180
SEARCH = ["question_id", "query_index"]


def static_terms(inferred: DataFrame, registry: DataFrame) -> DataFrame:
    """(question_id, _known): all terms that the active concepts already own."""
    none = F.array().cast("array<string>")
    terms = F.concat(*[F.coalesce(c, none) for c in ("aliases", "planner_triggers", "preferred_queries")])
    own = inferred.join((registry.select("concept", F.transform(terms, lowered).alias("_t"))), "concept")
    return own.groupBy("question_id").agg(F.array_distinct(F.flatten(F.collect_list("_t"))).alias("_known"))


def breadcrumbs(searches: DataFrame, results: DataFrame, known: DataFrame) -> DataFrame:
    """(question_id, query_index, crumb): of each search the first of its three best results whose heading is neither general, nor
    the query, nor known."""
    r = results.filter("place <= 3").join(known, "question_id", "left").withColumn("_hn", lowered(F.col("heading")))
    good = r.filter((F.trim("heading") != "") & ~F.col("_hn").isin(*GENERIC_HEADINGS) & (F.col("_hn") != lowered(F.col("query"))) & ~F.coalesce(F.array_contains("_known", F.col("_hn")), F.lit(False)))
    crumb = F.min_by(F.struct("heading", "citation_label", "corpus", "rank"), "place").alias("crumb")
    return searches.select(*SEARCH).join(good.groupBy(*SEARCH).agg(crumb), SEARCH)


def heading_evidence(results: DataFrame) -> DataFrame:
    """(question_id, query_index, evidence): of each search the heading with the most exact hits, then results, then rank (then name)."""
    hits = results.filter((F.trim("heading") != "") & (F.col("exact_heading") | F.col("heading_match"))).withColumn("_hn", lowered(F.col("heading")))
    groups = hits.groupBy(*SEARCH, "_hn").agg(
        F.min_by(F.trim("heading"), "place").alias("heading"), F.count("*").alias("n"), F.count_if("exact_heading").alias("exact"), F.count_if("heading_match").alias("phrases"),
        F.greatest(F.max("rank"), F.lit(0.0)).alias("rank"), F.max("cluster_support").alias("support"),
    )
    best = F.max_by(F.struct("heading", "n", "exact", "phrases", "rank", "support"), F.struct("exact", "n", "rank", "_hn"))
    return groups.groupBy(*SEARCH).agg(best.alias("evidence"))


def discover(searches: DataFrame, results: DataFrame, inferred: DataFrame, registry: DataFrame) -> DataFrame:
    """(question_id, query_index, query, provenance, status, concept_id, heading, evidence_count, slot_key, bridge_source_query,
    bridge_source_label, validation) of the planner's, user's and bridge searches. `searches`: (question_id, query_index, query,
    provenance, search_corpus, bridge_source_query, bridge_source_label)."""
    known = static_terms(inferred, registry)
    s = searches.filter(F.col("provenance").isin("planner", "user_term", "corpus_bridge")).withColumn("query", clean(F.col("query"))).join(known, "question_id", "left")
    s = s.join(heading_evidence(results), SEARCH, "left")
    e, low, bridge = F.col("evidence"), F.lower("query"), F.col("provenance") == "corpus_bridge"
    generic, affine = lowered(e["heading"]).isin(*GENERIC_HEADINGS), heading_affinity(F.col("query"), e["heading"])
    exact = affine & (e["exact"] >= 1) & ((e["rank"] >= EXACT_RANK) | (e["n"] >= 2))
    cluster = affine & (e["phrases"] >= 2) & (e["rank"] >= CLUSTER_RANK)
    bridged = (e["n"] >= 2) & (e["support"] >= 2) & (e["rank"] >= CLUSTER_RANK) & ((e["exact"] >= 2) | (e["phrases"] >= 2))
    covered = F.coalesce(F.array_contains("_known", low), F.lit(False)) & (low != "")
    stops = low.isin(*STOP_QUERIES)
    reason = (
        F.when(covered, "covered").when(stops, "generic_query").when(e.isNull(), "no_heading_evidence").when(generic, "generic_heading")
        .when(bridge & bridged, "bridge").when(~bridge & exact, "exact_heading").when(~bridge & cluster, "heading_cluster")
        .when(bridge, "weak_bridge").when(~affine, "no_affinity").otherwise("below_threshold")
    )
    s = s.withColumn("validation", reason)
    promoted = F.col("validation").isin("bridge", "exact_heading", "heading_cluster")
    s = s.withColumn("status", F.when(F.col("validation") == "covered", "covered_by_static").when(promoted, "promoted").otherwise("rejected"))
    seen = ~F.col("validation").isin("covered", "generic_query", "no_heading_evidence")
    key = discovery_key(e["heading"])
    s = s.select(
        *SEARCH, "query", "provenance", "status", F.when(F.col("status") == "covered_by_static", F.concat(F.lit("static:"), discovery_key(F.col("query")))).when(promoted, F.concat(F.lit("discovered:"), key)).otherwise(F.concat(F.lit("rejected:"), discovery_key(F.col("query")))).alias("concept_id"),
        F.when(seen, e["heading"]).alias("heading"), F.when(seen, e["n"]).otherwise(0).cast("long").alias("evidence_count"), F.when(promoted, F.concat(F.lit("discovered_"), key)).alias("slot_key"), "bridge_source_query", "bridge_source_label", "validation",
    )
    s = stage(s, "discovered")
    owner = s.filter("status = 'promoted'").groupBy("question_id", lowered(F.col("heading")).alias("_hn")).agg(F.max_by(F.struct("concept_id", "heading", "slot_key"), "query_index").alias("_to"))
    bound = s.filter(F.col("status").eqNullSafe("rejected") & F.col("provenance").isin("planner", "user_term")).select(*SEARCH, F.lower("query").alias("_ql"), "provenance")
    first = searches.groupBy("question_id", "provenance", lowered(F.col("query")).alias("_ql")).agg(F.min("query_index").alias("_first"))
    crumbs = breadcrumbs(searches, results, known).select("question_id", F.col("query_index").alias("_first"), F.col("crumb.citation_label").alias("_label"), lowered(F.col("crumb.heading")).alias("_hn"))
    found = bound.join(first, ["question_id", "provenance", "_ql"]).join(crumbs, ["question_id", "_first"]).join(owner, ["question_id", "_hn"]).select(*SEARCH, "_label", "_to")
    out, has = s.join(found, SEARCH, "left"), F.col("_to").isNotNull()
    new = {"status": F.lit("bound_to_promoted"), "validation": F.lit("breadcrumb"), "concept_id": F.col("_to.concept_id"), "heading": F.col("_to.heading"), "evidence_count": F.lit(1).cast("long"), "slot_key": F.col("_to.slot_key"), "bridge_source_query": F.col("query"), "bridge_source_label": F.col("_label")}
    return out.select(*SEARCH, "query", "provenance", *[F.when(has, v).otherwise(F.col(k)).alias(k) for k, v in new.items()])


def bridge_requests(searches: DataFrame, results: DataFrame, discovered: DataFrame, inferred: DataFrame, registry: DataFrame, corpora=("standing_orders", "speakers_rulings"), most: int = 2) -> DataFrame:
    """(question_id, place, query, corpus, source_query, source_provenance, source_label): headings of breadcrumbs of rejected searches,
    searched at most twice a question, user terms first, then by rank; those searched already are left out."""
    crumbs = breadcrumbs(searches, results, static_terms(inferred, registry))
    rejected = discovered.filter("status = 'rejected'").select(*SEARCH)
    s = searches.filter(F.col("provenance").isin("planner", "user_term")).join(rejected, SEARCH).join(crumbs, SEARCH)
    corpus = F.when(F.col("crumb.corpus").isin(*corpora), F.col("crumb.corpus")).when(F.col("search_corpus").isin(*corpora), F.col("search_corpus"))
    s = s.withColumn("corpus", corpus).withColumn("_key", F.concat_ws("::", F.coalesce("corpus", F.lit("auto")), lowered(F.col("crumb.heading"))))
    done = searches.select("question_id", F.concat_ws("::", F.coalesce("search_corpus", F.lit("auto")), lowered(F.col("query"))).alias("_key")).distinct()
    s = s.join(done, ["question_id", "_key"], "left_anti")
    order = F.struct((F.col("provenance") == "user_term").alias("u"), F.col("crumb.rank").alias("r"), (-F.col("query_index")).alias("i"))
    once = s.groupBy("question_id", "_key").agg(F.max_by(F.struct("crumb", "corpus", "query", "provenance"), order).alias("_b"), F.max(order).alias("_o"))
    placed = once.withColumn("place", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("_o")))).filter(F.col("place") <= max(1, min(most, 2)))
    return placed.select("question_id", F.col("place").cast("long").alias("place"), clean(F.col("_b.crumb.heading")).alias("query"), "_b.corpus", clean(F.col("_b.query")).alias("source_query"), F.col("_b.provenance").alias("source_provenance"), F.col("_b.crumb.citation_label").alias("source_label"))


def discovered_slots(discovered: DataFrame, searches: DataFrame, results: DataFrame, static: DataFrame, corpora=("standing_orders", "speakers_rulings")) -> DataFrame:
    """(question_id, ord, slot): a slot for each promoted heading, required where no static slot (question_id, slots) is. User terms found
    in the text of its results become preferred texts."""
    first = discovered.filter("status = 'promoted' and slot_key is not null").groupBy("question_id", "slot_key").agg(F.min(F.struct("query_index", "heading", "query", "provenance")).alias("_f")).select("question_id", "slot_key", "_f.*")
    source = searches.groupBy("question_id", lowered(F.col("query")).alias("_ql"), "provenance").agg(F.min_by(F.struct("search_corpus"), "query_index").alias("_s"))
    first = first.withColumn("_ql", lowered(F.col("query"))).join(source, ["question_id", "_ql", "provenance"], "left")
    linked = results.filter("provenance = 'user_term' and body_match and heading is not null").select("question_id", lowered(F.col("heading")).alias("_hn"), F.struct("query_index", clean(F.col("query")).alias("q")).alias("_t")).distinct()
    linked = linked.groupBy("question_id", "_hn").agg(F.transform(F.array_sort(F.collect_list("_t")), lambda t: t["q"]).alias("_terms"))
    need = static.select("question_id", F.exists("slots", lambda x: x["requirement"] == "required").alias("_has"))
    out = first.withColumn("_hn", lowered(F.col("heading"))).join(linked, ["question_id", "_hn"], "left").join(need, "question_id", "left")
    null = lambda k: F.lit(None).cast(k)
    fields = {
        "key": F.col("slot_key"), "requirement": F.when(F.coalesce("_has", F.lit(False)), "optional").otherwise("required"), "headings": F.array("heading"),
        "corpora": F.when(F.col("_s.search_corpus").isin(*corpora), F.array("_s.search_corpus")), "preferred_text": F.col("_terms"), "most": F.lit(1),
    }
    kinds = dict(x.split(":", 1) for x in _split(R.SLOT))
    slot = F.struct(*[fields.get(name, null(kind)).cast(kind).alias(name) for name, kind in kinds.items()])
    return out.select("question_id", F.col("query_index").alias("ord"), slot.alias("slot"))


def _split(fields: str) -> list[str]:
    """The top-level fields of a struct's description."""
    out, depth = [""], 0
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def recovery_requests(missing: DataFrame, slots: DataFrame, requested: DataFrame, most: int = 4) -> DataFrame:
    """(question_id, place, slot_key, query, corpus) for missing slots (question_id, slot_key), from the blueprint's static slots; a
    requested corpus (question_id, corpus) overrides the slot's. At most `most` a question, eight in all events."""
    none = F.array().cast("array<string>")
    filled = lambda *xs: F.coalesce(*[F.when(F.size(x) > 0, x) for x in xs], none)
    each = slots.select("question_id", F.posexplode("slots").alias("_a", "s")).withColumn("slot_key", F.col("s.key")).join(missing, ["question_id", "slot_key"], "left_semi").join(requested, "question_id", "left")
    any_ = F.array(F.lit(None).cast("string"))
    corpora = F.when(F.col("corpus").isNotNull(), F.array("corpus")).otherwise(F.when(F.size(filled(F.col("s.recovery_corpora"), F.col("s.corpora"))) > 0, filled(F.col("s.recovery_corpora"), F.col("s.corpora"))).otherwise(any_))
    rows = each.select("question_id", "slot_key", "_a", corpora.alias("_cs"), F.posexplode(filled(F.col("s.recovery_queries"), F.col("s.required_text"))).alias("_b", "query"))
    rows = rows.select("question_id", "slot_key", "_a", "_b", clean(F.col("query")).alias("query"), F.posexplode("_cs").alias("_d", "corpus")).filter("query <> ''")
    once = rows.groupBy("question_id", "slot_key", "corpus", F.lower("query").alias("_l")).agg(F.min(F.struct("_a", "_b", "_d", "query")).alias("_m"))
    placed = once.withColumn("place", F.row_number().over(W.partitionBy("question_id").orderBy("_m._a", "_m._b", "_m._d"))).filter(F.col("place") <= max(1, min(most, 8)))
    return placed.select("question_id", F.col("place").cast("long").alias("place"), "slot_key", F.col("_m.query").alias("query"), "corpus")


def evidence_gaps(missing: DataFrame, slots: DataFrame) -> DataFrame:
    """(question_id, slot_key, description) of missing slots."""
    known = slots.select("question_id", F.explode("slots").alias("s")).select("question_id", F.col("s.key").alias("slot_key"), F.col("s.gap").alias("_gap"))
    plain = F.concat(F.lit("the required evidence for "), F.replace("slot_key", F.lit("_"), F.lit(" ")))
    return missing.join(known, ["question_id", "slot_key"], "left").select("question_id", "slot_key", F.coalesce("_gap", plain).alias("description"))


BOOSTS = ("route_boost", "slot_boost", "preferred_boost", "bridge_boost", "discovery_boost")


def score_authorities(results: DataFrame, frames_: DataFrame, slots: DataFrame, discovered: DataFrame, registry: DataFrame) -> DataFrame:
    """The results with their boosts, adjusted_rank, matched_keys, family, family_most, excluded and eligible."""
    promoted = discovered.filter("status = 'promoted'").groupBy("question_id").agg(F.collect_set("concept_id").alias("_new"))
    none = F.array().cast("array<string>")
    f = frames_.join(promoted, "question_id", "left").withColumn("active", F.array_union("concepts", F.coalesce("_new", none))).drop("_new")
    out = F.explode(F.coalesce("exclusions", F.array().cast("array<struct<headings:array<string>,path_includes:array<string>>>")))
    gone = registry.select("concept", out.alias("_e")).join(frames_.select("question_id", F.explode("concepts").alias("concept")), "concept").groupBy("question_id").agg(F.collect_list("_e").alias("_ex"))
    slot_kind = dict(slots.dtypes)["slots"]
    rows = profiled(results).join(f, "question_id").join(slots, "question_id", "left").join(gone, "question_id", "left").withColumn("slots", F.coalesce("slots", F.array().cast(slot_kind)))
    rows = slot_scores(rows.withColumn("route_boost", route_boost()))
    crumb = discovered.filter("(status = 'promoted' and provenance = 'corpus_bridge') or (status = 'bound_to_promoted' and provenance in ('planner', 'user_term'))").filter("bridge_source_label is not null and heading is not null")
    crumb = crumb.select("question_id", F.col("bridge_source_label").alias("citation_label"), lowered(F.col("heading")).alias("_hn")).distinct().withColumn("discovery_boost", F.lit(BREADCRUMB_BOOST))
    rows = rows.withColumn("_hn", lowered(F.col("heading"))).join(crumb, ["question_id", "citation_label", "_hn"], "left").withColumn("discovery_boost", F.coalesce("discovery_boost", F.lit(0)))
    rows = rows.withColumn("adjusted_rank", sum((F.col(b) for b in BOOSTS), F.col("rank")))
    signal = F.col("exact_key") | F.col("exact_citation") | F.col("exact_heading") | F.col("heading_match") | F.col("path_match")
    keeps = (F.col("slot_boost") > 0) | (F.col("route_boost") > 0) | (F.col("adjusted_rank") >= EXACT_RANK) | signal
    excluded = F.coalesce(F.exists("_ex", fits_exclusion), F.lit(False))
    tail = F.lower(F.array_join(F.slice("path", F.greatest(F.size("path") - 1, F.lit(1)), F.lit(2)), " > "))
    return rows.withColumns(
        {
            "matched_keys": F.transform("matched", lambda s: s["key"]), "family": F.concat(F.lower(F.coalesce("heading", F.lit("none"))), F.lit("::"), tail),
            "family_most": F.coalesce(F.try_element_at("matched", F.lit(1))["most"], F.lit(2)), "eligible": keeps & ~excluded, "slot_keys": F.transform("slots", lambda s: s["key"]),
            "required_keys": F.transform(F.filter("slots", lambda s: s["requirement"] == "required"), lambda s: s["key"]),
        }
    )


PICK_ORDER = ("adjusted_rank", "discovery_boost", "bridge_boost", "preferred_boost", "slot_boost", "route_boost", "rank")


def best_of_sections(scored: DataFrame) -> DataFrame:
    """Each question's sections once, by their best row, with their order (`seq`): seven keys, then label, then id."""
    keys = [F.desc(c) for c in PICK_ORDER]
    best = scored.withColumn("_r", F.row_number().over(W.partitionBy("question_id", "section_id").orderBy(*keys, "citation_label", "query_index"))).filter("_r = 1").drop("_r")
    return best.withColumn("seq", F.row_number().over(W.partitionBy("question_id").orderBy(*keys, F.collate("citation_label", "UNICODE"), "section_id")).cast("long"))


PICKED = "question_id {0}, place long, section_id {1}, satisfied array<string>"


def greedy(best: DataFrame) -> DataFrame:
    """(question_id, place, section_id, satisfied): for each slot, required ones first, the first eligible section that fits it and whose
    family is not full; one section may satisfy several slots. Without slots the best four. A question has at most the results
    of its 14 searches, so a group is small."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("seq").to_dict("records")
        slots, required = list(rows[0]["slot_keys"]), set(rows[0]["required_keys"])
        most = max(1, min(len(slots), 8)) if slots else 4
        full: dict[str, int] = {}
        taken, done = [], set()

        def take(wanted) -> bool:
            for r in rows:
                if r["section_id"] in {t[0] for t in taken} or not r["eligible"] or full.get(r["family"], 0) >= r["family_most"] or (wanted is not None and wanted not in set(r["matched_keys"])):
                    continue
                new = [k for k in r["matched_keys"] if k not in done]
                taken.append((r["section_id"], new))
                done.update(new)
                full[r["family"]] = full.get(r["family"], 0) + 1
                return True
            return False

        for slot in sorted(slots, key=lambda k: k not in required):
            if len(taken) < most and slot not in done:
                take(slot)
        while not slots and len(taken) < most and take(None):
            pass
        return pd.DataFrame({"question_id": rows[0]["question_id"], "place": range(1, len(taken) + 1), "section_id": [t[0] for t in taken], "satisfied": pd.Series([t[1] for t in taken], dtype=object)})

    kinds = dict(best.dtypes)
    return best.select("question_id", "seq", "section_id", "eligible", "family", "family_most", "matched_keys", "slot_keys", "required_keys").groupBy("question_id").applyInPandas(pick, PICKED.format(kinds["question_id"], kinds["section_id"]))


def select_authorities(results: DataFrame, searches: DataFrame, questions: DataFrame, registry: DataFrame) -> dict[str, DataFrame]:
    """One round of selection: the tables inferred, frames, discovered, slots, scored, selected and missing (required slots
    that no selected section satisfies)."""
    inferred = stage(infer_concepts(questions, registry), "inferred")
    frames_ = frames(questions, inferred)
    discovered = stage(discover(searches, results, inferred, registry), "dimensions")
    static = blueprint(inferred, registry)
    slots = stage(blueprint(inferred, registry, discovered_slots(discovered, searches, results, static)), "slots")
    scored = stage(best_of_sections(score_authorities(results, frames_, slots, discovered, registry)), "scored")
    selected = stage(greedy(scored), "selected")
    needed = slots.select("question_id", F.explode(F.filter("slots", lambda s: s["requirement"] == "required")).alias("s")).select("question_id", F.col("s.key").alias("slot_key"))
    met = selected.select("question_id", F.explode("satisfied").alias("slot_key"))
    return {"inferred": inferred, "frames": frames_, "discovered": discovered, "slots": slots, "scored": scored, "selected": selected, "missing": needed.join(met, ["question_id", "slot_key"], "left_anti")}
