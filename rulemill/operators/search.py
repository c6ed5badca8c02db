"""Batched section search over a stored index: all queries of a table in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.staging import stage
from . import index as I
from . import scan
from .index import Index, cluster_key

__all__ = ["cluster_key", "search", "search_ranked", "focused", "compiled", "term_match", "phrase_match", "best_chunk", "postings"]

FLAGS = ("exact_key", "exact_citation", "exact_heading", "heading_like", "body_like", "path_like")


def asked(queries: DataFrame) -> DataFrame:
    """Queries (query_id, q, corpus_filter) with their normal forms; staged, as they are read by every branch."""
    q = F.col("q")
    return stage(queries.select("query_id", "q", "corpus_filter", F.lower(T.clean(q)).alias("_q"), T.singular_phrase(q).alias("_singular"), T.exact_section_key(q).alias("_key"), T.exact_citation(q).alias("_cite"), T.word_total(q).alias("_words")), "queries")


def signals(index: Index, q: DataFrame) -> DataFrame:
    """(query_id, section_id, flags): every section that a query meets by key, citation, heading, path or, for queries of one word,
    text. Each branch is an equi-join: no section is compared with every query."""

    def branch(flag: str, met: DataFrame) -> DataFrame:
        return met.select("query_id", "section_id", *[F.lit(f == flag).alias(f) for f in FLAGS])

    filled = q.filter("_q <> ''")
    by = lambda flag, column, asked_: branch(flag, index.base.join(filled.select("query_id", asked_.alias(column)).filter(F.col(column).isNotNull()), column))
    kinds = F.when(F.col("_words") == 1, F.array(F.lit("heading"), F.lit("path"), F.lit("token"))).otherwise(F.array(F.lit("heading"), F.lit("path")))
    pairs = stage(I.substring_pairs(index, filled, kinds), "pairs")
    some = [r[0] for r in pairs.select("kind").distinct().collect()]  # of three
    held = index.holders.filter(F.col("kind").isin(some)).join(pairs, ["kind", "s"])
    like = held.select("query_id", "section_id", *[(F.col("kind") == {"heading_like": "heading", "path_like": "path", "body_like": "token"}[f] if f in ("heading_like", "path_like", "body_like") else F.lit(False)).alias(f) for f in FLAGS])
    parts = [by("exact_key", "_k", F.col("_key")), by("exact_citation", "_c", F.col("_cite")), by("exact_heading", "_h", F.col("_q")), like]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "section_id").agg(*[F.max(f).alias(f) for f in FLAGS])


def candidates(index: Index, q: DataFrame) -> DataFrame:
    """The sections that each query meets (signals), with what ranking needs of them; the corpus filter is applied."""
    return within_corpus(signals(index, q), index, q).select("query_id", "section_id", "slug", "corpus", "citation_label", "path_text", "cluster_key", *FLAGS)


def within_corpus(met: DataFrame, index: Index, q: DataFrame) -> DataFrame:
    met = met.join(index.base, "section_id").join(q.select("query_id", "corpus_filter"), "query_id")
    return met.filter(F.col("corpus_filter").isNull() | (F.col("corpus") == F.col("corpus_filter")))


#: What each signal and each rank is worth.
WORTH = {"exact_key": 1200, "exact_citation": 1100, "exact_heading": 240, "heading_like": 80, "path_like": 70, "body_like": 2}
RANK_WORTH = {"heading_rank": 650, "path_rank": 280, "body_rank": 110, "chunk_phrase_rank": 70, "section_rank": 55, "chunk_rank": 10}
SUPPORT_STEP, SUPPORT_MOST = 45, 135


def overall_rank(ranks: bool = True) -> Column:
    """The rank of a row with the signals, cluster_support and, with `ranks`, the text ranks."""
    total = sum((F.col(k).cast("int") * v for k, v in WORTH.items()), F.lit(0))
    total = total + F.when(F.col("cluster_support") >= 2, F.least(SUPPORT_STEP * (F.col("cluster_support") - 1), F.lit(SUPPORT_MOST))).otherwise(0)
    return sum((F.coalesce(k, F.lit(0.0)) * v for k, v in RANK_WORTH.items()), total.cast("double")) if ranks else total.cast("long")


def supported(found: DataFrame, signal: Column) -> DataFrame:
    """Adds cluster_support (candidates of the same query, document and cluster with the signal) and total (the query's candidates).
    Both are counted by group, which Spark combines before the shuffle, and joined back."""
    group = ["query_id", "slug", "cluster_key"]
    counts = found.groupBy(*group).agg(F.count_if(signal).alias("cluster_support"), F.count("*").alias("_rows"))
    totals = counts.groupBy("query_id").agg(F.sum("_rows").alias("total"))
    return found.join(counts.drop("_rows"), group).join(totals, "query_id")


def ranked(found: DataFrame) -> DataFrame:
    """Cluster support over the candidates, the overall rank of the signals and the total of each query."""
    signal = F.col("exact_heading") | F.col("heading_like") | F.col("path_like")
    return supported(stage(found, "candidates"), signal).withColumn("overall_rank", overall_rank(ranks=False))


ORDER = ("overall_rank", "exact_heading", "heading_rank", "path_rank", "cluster_support", "body_rank", "section_rank", "chunk_phrase_rank", "chunk_rank")


def page(scored: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """Places offset+1 .. offset+limit of each query; ties by label, then id. Spark cuts each task's rows to the last place wanted
    before it shuffles them."""
    keys = [F.desc(c) for c in ORDER if c in scored.columns]
    placed = scored.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*keys, "citation_label", "section_id")))
    cut = placed.filter(F.col("place") <= offset + limit).filter(F.col("place") > offset)
    return cut.withColumn("place", F.col("place").cast("long")).withColumn("has_more", F.col("total") > offset + limit)


LIMITS, OFFSETS = (1, 50), (0, 10_000)


def bounds(limit: int, offset: int) -> tuple[int, int]:
    """Limit and offset brought into the bounds that a request may have."""
    return max(LIMITS[0], min(LIMITS[1], limit)), max(OFFSETS[0], min(OFFSETS[1], offset))


def numbered(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct searches of queries, each with a number as its query_id, and (query_id, _n), which search each query is."""
    own = stage(queries.select("query_id", "q", "corpus_filter"), "asked")
    once = stage(own.select("q", "corpus_filter").distinct().withColumn("query_id", F.monotonically_increasing_id()), "searches")
    same = own["q"].eqNullSafe(once["q"]) & own["corpus_filter"].eqNullSafe(once["corpus_filter"])
    return once, stage(own.join(once, same).select(own["query_id"], once["query_id"].alias("_n")), "numbers")


def each_query(pages: DataFrame, numbers: DataFrame) -> DataFrame:
    return numbers.join(pages.withColumnRenamed("query_id", "_n"), "_n").drop("_n")


def search(sections: DataFrame | None, queries: DataFrame, limit: int = 10, offset: int = 0, index: Index | None = None) -> DataFrame:
    """A page of each query by signals alone, over a stored index or, without one, by reading all of `sections`."""
    if index is not None:
        return page(ranked(candidates(index, asked(queries))), *bounds(limit, offset))
    once, numbers = numbered(queries)
    met = scan.found(sections, asked(once), sum(bounds(limit, offset))).withColumn("overall_rank", overall_rank(ranks=False))
    return each_query(page(met.drop(*scan.RANKS, "signal"), *bounds(limit, offset)), numbers)


def focused(results: DataFrame, focus: Column) -> DataFrame:
    """Of each query's results the first whose id, key or label is the focus."""
    same = (F.col("section_id").cast("string") == focus) | (F.col("section_key") == focus) | (F.col("citation_label") == focus)
    return results.filter(same).withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy("place"))).filter("_r = 1").drop("_r")


def search_ranked(sections: DataFrame | None, chunks: DataFrame | Column | None, queries: DataFrame, limit: int = 10, offset: int = 0, index: Index | None = None) -> DataFrame:
    """A page of each query by all signals and text ranks, over a stored index or, without one, over one made of `sections` and a table of
    `chunks`; where `chunks` is the array of a section's chunks, the texts are read as they are, without an index."""
    matches = {"heading_match": F.col("heading_like") | (F.col("heading_rank") > 0), "body_match": F.col("body_like") | (F.col("body_rank") > 0), "path_match": F.col("path_like") | (F.col("path_rank") > 0)}
    if index is None and isinstance(chunks, Column):
        once, numbers = numbered(queries)
        met = scan.found(sections, asked(once), sum(bounds(limit, offset)), chunks).withColumn("overall_rank", overall_rank())
        return each_query(page(met.drop("signal"), *bounds(limit, offset)), numbers).withColumns(matches)
    index = index or I.fresh_index(sections, chunks)
    q, key = asked(queries), ["query_id", "section_id"]
    words = stage(I.asked_words(q), "asked-lexemes")
    trees = I.search_trees(words)
    found = stage(I.ranked_texts(index.postings, index.lexemes, "section", words, trees), "ranks")
    of = lambda kinds, field=None: F.coalesce(F.max(F.when(F.col("kind").isin(*kinds) & (F.lit(True) if field is None else F.col("field") == field), F.col("rank"))), F.lit(0.0))
    phrases = ("phrase", "singular")
    ranks = found.groupBy(*key).agg(of(("match",)).alias("section_rank"), of(phrases, "heading").alias("heading_rank"), of(phrases, "content").alias("body_rank"), of(phrases, "path").alias("path_rank"), F.max(F.col("kind") == "match").alias("_match"))
    every = signals(index, q).withColumn("_signal", F.lit(True)).join(ranks, key, "full").filter("_match or _signal").na.fill(False, list(FLAGS))
    met = stage(within_corpus(every, index, q).select("query_id", "section_id", "slug", "corpus", "citation_label", "path_text", "cluster_key", *FLAGS, "section_rank", "heading_rank", "body_rank", "path_rank"), "met")
    best = I.best_parts(I.ranked_texts(index.chunk_postings, index.lexemes, "chunk", words, trees, met.select(*key)))
    whole = met.join(best, key, "left").na.fill(0.0, ["section_rank", "heading_rank", "body_rank", "path_rank", "chunk_phrase_rank", "chunk_rank"])
    signal = F.col("exact_heading") | F.col("heading_like") | F.col("path_like") | (F.col("heading_rank") > 0) | (F.col("body_rank") > 0) | (F.col("path_rank") > 0)
    scored = supported(stage(whole, "candidates"), signal).withColumn("overall_rank", overall_rank())
    return page(scored, *bounds(limit, offset)).withColumns(matches)


def compiled(queries: DataFrame) -> DataFrame:
    """(query_id, match, phrase, singular): what the searches look for, as JSON trees; null where nothing is left of a query."""
    q = asked(queries)
    trees = I.search_trees(I.asked_words(q)).groupBy("query_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("tree"))).alias(k) for k in ("match", "phrase", "singular")])
    return q.select("query_id").join(trees, "query_id", "left")


def postings(sections: DataFrame) -> DataFrame:
    """(section_id, class, lexeme, pos): the simple analyser's words of label, key, heading (class A), path (B) and text (C),
    positions counted on from field to field."""
    words = lambda x: F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    one = sections.select("section_id", words(F.concat_ws(" ", "citation_label", "section_key", "heading")).alias("a"), words(F.array_join("path", " ")).alias("b"), words(F.col("content")).alias("c"))
    field = lambda name, start, own: F.struct(F.lit(name).alias("class"), start.alias("start"), F.col(own).alias("words"))
    fields = one.select("section_id", F.explode(F.array(field("A", F.lit(0), "a"), field("B", F.size("a"), "b"), field("C", F.size("a") + F.size("b"), "c"))).alias("_f"))
    return fields.select("section_id", "_f.class", "_f.start", F.posexplode("_f.words").alias("_i", "lexeme")).select("section_id", "class", "lexeme", (F.col("start") + F.col("_i")).cast("long").alias("pos"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, at, lexeme, terms, length) of each query's words."""
    words = F.regexp_extract_all(F.lower("q"), F.lit(r"[\p{L}\p{N}]+"), 0)
    return queries.select("query_id", F.posexplode(words).alias("at", "lexeme"), F.size(F.array_distinct(words)).alias("terms"), F.size(words).alias("length"))


def _rarest(own: DataFrame, terms: DataFrame, *keep: str) -> DataFrame:
    """Of each query the word that the fewest rows of `own` have; queries with a word that has none are left out."""
    counts = own.groupBy("lexeme").agg(F.count("*").alias("_f"))
    return terms.join(counts, "lexeme", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), "lexeme", *keep)).alias("_r")).filter("_r.f > 0").select("query_id", "_r.lexeme", *[F.col(f"_r.{c}") for c in keep])


def term_match(posted: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, section_id, hits): sections that hold all terms. Only asked words are kept, and only sections with a query's rarest
    word are looked at."""
    terms = stage(query_terms(queries).select("query_id", "lexeme", "terms").distinct(), "terms")
    own = stage(posted.join(terms.select("lexeme").distinct(), "lexeme", "left_semi").groupBy("section_id", "lexeme").agg(F.count("*").alias("_n")), "asked-words")
    owners = own.join(_rarest(own, terms), "lexeme").select("query_id", "section_id")
    met = owners.join(terms, "query_id").join(own, ["section_id", "lexeme"]).groupBy("query_id", "section_id", "terms").agg(F.count("*").alias("_got"), F.sum("_n").alias("hits"))
    return met.filter("_got = terms").select("query_id", "section_id", "hits")


def phrase_match(posted: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, section_id, phrases): how often the query's words follow each other, looked for around its rarest word."""
    terms = stage(query_terms(queries).select("query_id", "at", "lexeme", "length"), "terms")
    own = stage(posted.join(terms.select("lexeme").distinct(), "lexeme", "left_semi").select("section_id", "lexeme", "pos"), "asked-words")
    starts = own.join(_rarest(own, terms, "at"), "lexeme").select("query_id", "section_id", (F.col("pos") - F.col("at")).alias("_start"))
    wanted = starts.join(terms, "query_id").withColumn("pos", F.col("_start") + F.col("at"))
    whole = wanted.join(own, ["section_id", "pos", "lexeme"]).groupBy("query_id", "section_id", "_start", "length").agg(F.count("*").alias("_n")).filter("_n = length")
    return whole.groupBy("query_id", "section_id").agg(F.count("*").alias("phrases"))


def best_chunk(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, section_id, chunk_index, term_hits): the chunk of each section with most of a query's terms."""
    terms = queries.select("query_id", F.array_distinct(F.regexp_extract_all(F.lower("q"), F.lit(r"[\p{L}\p{N}]+"), 0)).alias("_t"))
    words = F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}\p{N}]+"), 0)
    posted = chunks.select("section_id", "chunk_index", F.explode(F.array_distinct(words)).alias("lexeme"))
    met = posted.join(terms.select("query_id", F.explode("_t").alias("lexeme")), "lexeme").groupBy("query_id", "section_id", "chunk_index").agg(F.count("*").alias("term_hits"))
    order = W.partitionBy("query_id", "section_id").orderBy(F.desc("term_hits"), "chunk_index")
    return met.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
