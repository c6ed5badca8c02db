"""Questions answered over a rule corpus: planned searches, selection, bridge and recovery rounds, and the gate of the draft.

Each round is one batched search for all questions. Later rounds search only what the one before asked for. Plans, drafts and
verdicts of a model are input tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import small, stage
from . import answers as AV
from . import concepts as C
from . import index as I
from . import search as S

SEARCHES = ("question_id", "query_index", "query", "provenance", "search_corpus", "bridge_source_query", "bridge_source_label")


def planned(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """The first round's searches of questions (question_id, question, planned, terms, corpus)."""
    plan = C.query_plan(questions, C.infer_concepts(questions, registry), registry).join(questions.select("question_id", "corpus"), "question_id")
    none = F.lit(None).cast("string")
    return plan.select("question_id", (F.col("place") - 1).alias("query_index"), "query", "provenance", F.col("corpus").alias("search_corpus"), none.alias("bridge_source_query"), none.alias("bridge_source_label"))


def executed(searches: DataFrame, sections: DataFrame, index: I.Index | None, chunks: Column | None = None, limit: int = 10) -> DataFrame:
    """The searches' results, with what selection reads of them."""
    key = F.struct("question_id", "query_index")
    found = S.search_ranked(sections, chunks, searches.select(key.alias("query_id"), F.col("query").alias("q"), F.col("search_corpus").alias("corpus_filter")), limit, index=index)
    found = found.select(
        F.col("query_id.question_id").alias("question_id"), F.col("query_id.query_index").alias("query_index"), "section_id", "citation_label", "corpus", "place", F.col("overall_rank").alias("rank"), "cluster_support",
        "exact_key", "exact_citation", "exact_heading", "heading_match", "body_match", "path_match",
    )
    found = stage(found, "found")
    # Rows that are few are sent to the sections, so the texts of the others need not be shuffled.
    near = small(found.select("section_id").distinct())
    texts = stage(sections.select("section_id", "heading", "path", "content").join(near, "section_id", "left_semi"), "found-texts")
    whole = found.join(texts, "section_id")
    return stage(whole.join(searches.select("question_id", "query_index", "query", "provenance"), ["question_id", "query_index"]), "results")


def answer_rounds(questions: DataFrame, sections: DataFrame, chunks: DataFrame | Column, registry: DataFrame, index: I.Index | None = None) -> dict[str, DataFrame]:
    """Selection after the bridge and recovery rounds, with `searches`, `results`, `bridge` and `recovery` requests. All rounds search
    one index, a stored one or, without it, one made of `sections` and a table of `chunks`; where `chunks` is the array of a section's
    chunks, the texts are read in each round, without an index."""
    arrays = chunks if index is None and isinstance(chunks, Column) else None
    index = index or (None if arrays is not None else I.fresh_index(sections, chunks))
    searches = stage(planned(questions, registry), "searches")
    results = executed(searches, sections, index, arrays)
    inferred = stage(C.infer_concepts(questions, registry), "inferred")
    discovered = C.discover(searches, results, inferred, registry)  # all that the bridge needs of a first selection

    def more(requests: DataFrame, columns: dict) -> bool:
        nonlocal searches, results
        last = searches.groupBy("question_id").agg(F.max("query_index").alias("_last"))
        new = stage(requests.join(last, "question_id").withColumn("query_index", F.col("_last") + F.col("place")).select([F.coalesce(columns[c], F.lit(None).cast("string")).alias(c) if c in columns else F.col(c) for c in SEARCHES]), "requests")
        if new.isEmpty():
            return False
        results = results.unionByName(executed(new, sections, index, arrays))
        searches = searches.unionByName(new)
        return True

    bridge = stage(C.bridge_requests(searches, results, discovered, inferred, registry), "bridge")
    more(bridge, {"provenance": F.lit("corpus_bridge"), "search_corpus": F.col("corpus"), "bridge_source_query": F.col("source_query"), "bridge_source_label": F.col("source_label")})
    second = C.select_authorities(results, searches, questions, registry)
    static = C.blueprint(second["inferred"], registry)
    recovery = stage(C.recovery_requests(second["missing"], static, questions.select("question_id", "corpus").filter("corpus is not null")), "recovery")
    null = F.lit(None).cast("string")
    grown = more(recovery, {"provenance": F.lit("recovery"), "search_corpus": F.col("corpus"), "bridge_source_query": null, "bridge_source_label": null})
    last = C.select_authorities(results, searches, questions, registry) if grown else second
    return {**last, "searches": searches, "results": results, "bridge": bridge, "recovery": recovery, "gaps": C.evidence_gaps(last["missing"], static)}


def authorities(rounds: dict[str, DataFrame]) -> DataFrame:
    """(question_id, place, and the payload of each selected authority)."""
    out = rounds["selected"].select("question_id", "place", "section_id", "satisfied").join(rounds["scored"].drop("place"), ["question_id", "section_id"])
    return out.select("question_id", "place", "section_id", "citation_label", "heading", "path", "corpus", F.col("adjusted_rank").alias("rank"), "authority_class", "authority_function", "satisfied")


def answer(questions: DataFrame, drafts: DataFrame, rounds: dict[str, DataFrame]) -> DataFrame:
    """(question_id, status, reason, answer): the drafts (question_id, draft, verdicts) of the questions after all checks, by what the
    rounds retrieved."""
    one = F.struct("citation_label", "heading", "path", "authority_class", "authority_function")
    own = authorities(rounds).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", one.alias("a")))), lambda x: x["a"]).alias("authorities"))
    gaps = rounds["gaps"].groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot_key", "description"))), lambda x: x["description"]).alias("gaps"))
    every = questions.select("question_id").join(drafts, "question_id", "left").join(own, "question_id", "left").join(gaps, "question_id", "left")
    return AV.gate(every.withColumn("labels", F.transform("authorities", lambda a: a["citation_label"])))
