"""All queries over the rule corpus, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, reports, search
from ..sources.corpus import SECTIONS_SQL, sections, table
from . import catalog_rules

_S = f"with {SECTIONS_SQL}"
_CLEAN = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


def q_clean_query(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.clean(F.col("text")).alias("cleaned"), T.first_words(F.col("text"), 8).alias("first_words"), T.word_total(F.col("text")).alias("words"), T.token_estimate(F.col("text")).alias("tokens"), T.escape_html(F.col("text")).alias("escaped"))


def _labels(spark, d):
    n = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", F.explode(F.array(F.concat(F.lit("SO "), n), F.concat(F.lit(" Standing  Order "), n, F.lit("a")), F.concat(n, F.lit("/7 ")), F.concat(F.lit("so"), n, F.lit("B")), F.concat(F.lit("rule "), n))).alias("q"))


def q_exact_keys(spark, d):
    return _labels(spark, d).select("doc_id", "q", T.exact_section_key(F.col("q")).alias("section_key"), T.exact_citation(F.col("q")).alias("citation"))


def q_singularize(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("word")).distinct()
    return w.select("word", T.singular(F.col("word")).alias("singular"), T.singular_phrase(F.concat_ws(" ", "word", F.lit("of"), "word")).alias("phrase"))


def q_line_classes(spark, d):
    x = F.col("line")
    return _lines(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), T.page_noise(x).alias("noise"), T.ruling_start(x).alias("ruling"), T.order_start(x).alias("order_start"), T.citation_line(x).alias("citation"), T.plain_heading(x).alias("plain"), T.caps_heading(x).alias("caps"))


def q_cluster_support(spark, d):
    s = sections(spark, d).select("section_id", "slug", search.cluster_key(F.col("slug"), F.col("path")).alias("cluster_key"), F.lower("content").contains("tion").alias("_has"))
    counts = s.groupBy("slug", "cluster_key").agg(F.count_if("_has").cast("long").alias("support"))
    return s.join(counts, ["slug", "cluster_key"]).select("section_id", "cluster_key", "support")


def _queries(spark, d):
    """Headings of some sections, single words and labels, as one batch of searches."""
    b = table(spark, d, "benchmark")
    words = F.split(T.clean(F.col("text")), " ")
    return b.select((F.col("item_id") * 4).alias("query_id"), F.element_at(words, 1).alias("q")).unionByName(b.select((F.col("item_id") * 4 + 1).alias("query_id"), F.array_join(F.slice(words, 1, 2), " ").alias("q"))).unionByName(b.select((F.col("item_id") * 4 + 2).alias("query_id"), F.concat("item_id", F.lit("/7")).alias("q"))).withColumn("corpus_filter", F.lit(None).cast("string"))


_QUERIES = r"""qs as (select item_id * 4 as query_id, str_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1] as q from benchmark
  union all select item_id * 4 + 1, array_to_string(str_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:2], ' ') from benchmark
  union all select item_id * 4 + 2, cast(item_id as varchar) || '/7' from benchmark)"""


def q_search_like(spark, d):
    out = search.search(sections(spark, d), _queries(spark, d), 10, 0)
    return out.select("query_id", "place", "section_id", "overall_rank", "cluster_support", "total", "has_more")


def q_search_paged(spark, d):
    out = search.search(sections(spark, d), _queries(spark, d), 5, 5)
    return out.select("query_id", "place", "section_id", "overall_rank", "total", "has_more")


def _search_sql(limit: int, offset: int, cols: str) -> str:
    return f"""with {SECTIONS_SQL}, {_QUERIES},
q as (select query_id, lower(q) as q, case when regexp_matches(lower(q), '^[0-9]+/[0-9]+$') then lower(q) end as cite, len(str_split(q, ' ')) as words from qs),
c as (select q.query_id, s.*, array_to_string(s.path, ' > ') as pt,
  case when len(s.path) <= 3 then array_to_string(s.path, ' > ') else array_to_string(s.path[1:len(s.path) - 2], ' > ') end as ck,
  coalesce(lower(s.section_key) = q.cite, false) as ek, coalesce(lower(s.citation_label) = q.cite, false) as ec, lower(coalesce(s.heading, '')) = q.q as eh,
  contains(lower(coalesce(s.heading, '')), q.q) as hl, q.words = 1 and contains(lower(s.content), q.q) as bl, contains(lower(array_to_string(s.path, ' > ')), q.q) as pl
  from s, q where q.q <> ''),
f as (select *, count(*) filter (where eh or hl or pl) over (partition by query_id, slug, ck) as sup, count(*) over (partition by query_id) as total from c where ek or ec or eh or hl or bl or pl),
r as (select *, 1200 * ek::int + 1100 * ec::int + 240 * eh::int + 80 * hl::int + 70 * pl::int + 2 * bl::int + case when sup >= 2 then least(45 * (sup - 1), 135) else 0 end as overall_rank from f),
p as (select *, row_number() over (partition by query_id order by overall_rank desc, eh desc, sup desc, citation_label, section_id) as place from r)
select query_id, place, section_id, cast(overall_rank as bigint) as overall_rank, {cols} total, total > {limit + offset} as has_more from p where place > {offset} and place <= {limit + offset}"""


def _phrases(spark, d):
    words = F.split(T.clean(F.col("text")), " ")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(words, 3, 4), " ").alias("q"))


def q_term_match(spark, d):
    return search.term_match(search.postings(sections(spark, d)), _phrases(spark, d))


def q_phrase_match(spark, d):
    return search.phrase_match(search.postings(sections(spark, d)), _phrases(spark, d))


_POSTINGS = r"""marked as (select section_id, list_concat(
    list_transform(regexp_extract_all(lower(concat_ws(' ', citation_label, section_key, heading)), '[\p{L}\p{N}]+'), lambda w: {'class': 'A', 'lexeme': w}),
    list_transform(regexp_extract_all(lower(array_to_string(path, ' ')), '[\p{L}\p{N}]+'), lambda w: {'class': 'B', 'lexeme': w}),
    list_transform(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'), lambda w: {'class': 'C', 'lexeme': w})) as ws from s),
posted as (select section_id, unnest(ws).class as class, unnest(ws).lexeme as lexeme, unnest(range(len(ws))) as pos from marked)"""
_TERMS = r"""tq as (select item_id as query_id, regexp_extract_all(lower(array_to_string(str_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[3:6], ' ')), '[\p{L}\p{N}]+') as ws from benchmark),
terms as (select query_id, len(ws) as n, len(list_distinct(ws)) as d, unnest(ws) as lexeme, unnest(range(len(ws))) as ps from tq)"""


def q_postings_stats(spark, d):
    p = search.postings(sections(spark, d))
    return p.groupBy("class").agg(F.count("*").alias("postings"), F.countDistinct("lexeme").alias("lexemes"), F.max("pos").alias("last_pos"))


def q_best_chunk(spark, d):
    chunks = chunking.blocks(sections(spark, d)).select("section_id", F.col("block").alias("chunk_index"), F.col("text").alias("content"))
    return search.best_chunk(chunks, _phrases(spark, d))


def q_corpus_counts(spark, d):
    docs = table(spark, d, "documents").select("source").distinct()
    labelled = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").filter("toxic = 1")
    return reports.counts_by_document(docs, labelled, "source", "doc_id")


def q_heading_hist(spark, d):
    return reports.heading_histogram(sections(spark, d))


def q_key_hist(spark, d):
    e = table(spark, d, "events").withColumn("j", F.to_json(F.struct(F.pmod("user_id", F.lit(7)).cast("string").alias("chapter"), F.col("event_type").alias("title"))))
    return reports.key_histogram(e, "j", ["chapter", "title"])


def q_duplicate_keys(spark, d):
    return reports.duplicate_keys(sections(spark, d), "slug", "heading")


def q_tail_sample(spark, d):
    return reports.tail(sections(spark, d).select("section_id", "slug", "citation_label"), "section_id", 20)


def q_blocks(spark, d):
    return chunking.blocks(sections(spark, d))


_RULING, _ORDER = r"^[0-9]+/[0-9]+\b", r"^[0-9]+[A-Z]?\s+\S"
_CITATION = r"^\(?[0-9]+\)?\s{0,4}[0-9]{4},\s*Vol\.|^[0-9]{4},\s*Vol\.|^Report of |^Question of privilege |^Final report of "
_OTHER = f"not regexp_matches(t, '{_CITATION}') and not regexp_matches(t, '{_RULING}') and not regexp_matches(t, '{_ORDER}') and not regexp_matches(t, '^(Originally published|Sort by|Also in this section):')"
_PLAIN = rf"(length(t) <= 100 and regexp_matches(t, '^[A-Z][A-Za-z’''()\[\]\-,:;&/ ]+$') and {_OTHER})"
_CAPS = rf"""(length(t) <= 120 and regexp_matches(t, '^[A-Z][A-Z0-9 ''"’()\-,:;&/]+$') and {_OTHER})"""
_UNIT = rf"""(regexp_matches(t, '{_RULING}') or regexp_matches(t, '{_ORDER}') or regexp_matches(t, '^\([0-9]+[A-Z]?\)\s+\S') or regexp_matches(t, '^\([a-z]\)\s+\S') or regexp_matches(t, '(?i)^\([ivxlcdm]+\)\s+\S') or regexp_matches(t, '^•\s+\S') or {_PLAIN} or {_CAPS})"""
_BLOCKS = rf"""ls as (select section_id, unnest(str_split(content, chr(10))) as line, unnest(range(len(str_split(content, chr(10))))) as pos from s),
lt as (select *, trim(regexp_replace(line, '\s+', ' ', 'g')) as t from ls),
lg as (select *, sum(case when t = '' or {_UNIT} then 1 else 0 end) over (partition by section_id order by pos) as g from lt),
bs as (select section_id, g, trim(regexp_replace(string_agg(t, ' ' order by pos), '\s+', ' ', 'g')) as text from lg where t <> '' group by section_id, g),
blocks as (select section_id, row_number() over (partition by section_id order by g) - 1 as block, text from bs)"""


def q_chunks(spark, d):
    return chunking.chunk_sections(sections(spark, d)).select("section_id", "chunk_index", F.length("content").cast("long").alias("chars"), "token_count_est")


SQL = {
    "q_clean_query": r"select item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as cleaned, array_to_string(str_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:8], ' ') as first_words, len(str_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) as words, cast(ceil(length(text) / 4.0) as bigint) as tokens, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped from benchmark",
    "q_exact_keys": r"""with x as (select doc_id, unnest(['SO ' || doc_id, ' Standing  Order ' || doc_id || 'a', doc_id || '/7 ', 'so' || doc_id || 'B', 'rule ' || doc_id]) as q from documents),
y as (select *, lower(trim(regexp_replace(q, '\s+', ' ', 'g'))) as c from x),
z as (select *, case when regexp_matches(c, '^(so|standing order) [0-9]+[a-z]?$') or regexp_matches(c, '^so[0-9]+[a-z]?$') then 'so-' || regexp_extract(c, '([0-9]+[a-z]?)$', 1) when regexp_matches(c, '^[0-9]+/[0-9]+$') then c end as k from y)
select doc_id, q, k as section_key, replace(k, '-', '') as citation from z""",
    "q_singularize": r"""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents),
v as (select word, case when length(word) <= 3 then word when word like '%ies' then left(word, length(word) - 3) || 'y' when word like '%sses' or word like '%ses' then left(word, length(word) - 2) when word like '%s' and word not like '%ss' then left(word, length(word) - 1) else word end as singular from w)
select word, singular, nullif(singular || ' of ' || singular, word || ' of ' || word) as phrase from v""",
    "q_line_classes": f"""with l as (select doc_id, unnest(str_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(str_split(coalesce(text, ''), chr(10))))) as pos from documents), t as (select *, {_CLEAN.format("line")} as t from l)
select doc_id, pos, t = '' or regexp_matches(t, '^[0-9]+$|^SOs?\\s+[0-9–-]+|^CHAPTER [0-9]+') as noise, regexp_matches(t, '{_RULING}') as ruling, regexp_matches(t, '{_ORDER}') as order_start, regexp_matches(t, '{_CITATION}') as citation, {_PLAIN} as plain, {_CAPS} as caps from t""",
    "q_cluster_support": _S + """, k as (select *, case when len(path) <= 3 then array_to_string(path, ' > ') else array_to_string(path[1:len(path) - 2], ' > ') end as cluster_key from s)
select section_id, cluster_key, count(*) filter (where contains(lower(content), 'tion')) over (partition by slug, cluster_key) as support from k""",
    "q_search_like": _search_sql(10, 0, "sup as cluster_support,"),
    "q_search_paged": _search_sql(5, 5, ""),
    "q_term_match": f"{_S}, {_POSTINGS}, {_TERMS}, m as (select t.query_id, p.section_id, t.d, count(distinct p.lexeme) as got, count(*) as hits from posted p join (select distinct query_id, lexeme, d from terms) t using (lexeme) group by all) select query_id, section_id, hits from m where got = d",
    "q_phrase_match": f"{_S}, {_POSTINGS}, {_TERMS}, m as (select t.query_id, p.section_id, p.pos - t.ps as st, t.n, count(*) as c from posted p join terms t using (lexeme) group by all) select query_id, section_id, count(*) as phrases from m where c = n group by query_id, section_id",
    "q_postings_stats": f"{_S}, {_POSTINGS} select class, count(*) as postings, count(distinct lexeme) as lexemes, max(pos) as last_pos from posted group by class",
    "q_best_chunk": f"{_S}, {_BLOCKS}, {_TERMS}, w as (select section_id, block, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) as lexeme from blocks), m as (select t.query_id, w.section_id, w.block as chunk_index, count(*) as term_hits from w join (select distinct query_id, lexeme from terms) t using (lexeme) group by all) select query_id, section_id, chunk_index, term_hits from (select *, row_number() over (partition by query_id, section_id order by term_hits desc, chunk_index) as r from m) where r = 1",
    "q_corpus_counts": "select d.source, count(l.doc_id) as parts from documents d left join (select * from labels where toxic = 1) l on l.doc_id = d.doc_id group by d.source",
    "q_heading_hist": _S + " select heading, count(*) as sections from s group by heading",
    "q_key_hist": "select cast(user_id % 7 as varchar) as chapter, event_type as title, count(*) as rows, user_id % 7 as sort_key from events group by all",
    "q_duplicate_keys": _S + " select slug, heading, count(*) as copies from s group by all having count(*) > 1",
    "q_tail_sample": _S + " select section_id, slug, citation_label from s order by section_id desc limit 20",
    "q_blocks": f"{_S}, {_BLOCKS} select section_id, block, text from blocks",
}


def queries() -> dict:
    from . import catalog_answers, catalog_index, catalog_scores

    return {name: function for name, function in globals().items() if name.startswith("q_")} | catalog_rules.queries() | catalog_index.queries() | catalog_answers.queries() | catalog_scores.queries()


def oracle_sql() -> dict[str, str]:
    from . import catalog_answers, catalog_index, catalog_scores

    return SQL | catalog_rules.SQL | catalog_index.oracle_sql() | catalog_answers.oracle_sql() | catalog_scores.oracle_sql()
