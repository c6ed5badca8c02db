"""The stored index of a rule corpus: postings by lexeme, substring grams, and how often each occurs.

Every table is sorted by what it is looked up by, over files as well as inside them, so a search reads the row groups that its
lexemes or grams can lie in (min/max and dictionary pruning), and a hot lexeme is spread over files by its sections. Lists are kept
between searches; documents are replaced one by one (sources.versions). Words are stemmed once each, in a dictionary of distinct words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import analysis as A
from ..sources import versions
from ..sources.staging import stage

#: name -> what it is sorted by.
TABLES = {
    "base": ("section_id",), "postings": ("lexeme", "section_id"), "chunk_postings": ("lexeme", "section_id"), "lexemes": ("lexeme",),
    "holders": ("kind", "s", "section_id"), "grams": ("gram", "s"), "gram_counts": ("gram",),
}
TEXT, SUBSTRINGS = ("postings", "chunk_postings", "lexemes"), ("holders", "grams", "gram_counts")
#: Substrings are met by grams of this many characters; strings begin and end with EDGE, so short ones have grams too.
GRAM, EDGE = 3, "\u0001"
#: A search with at most so many lexemes or grams names them to the scan; one with more is joined.
NAMED = 2000


@dataclass
class Index:
    base: DataFrame
    postings: DataFrame | None = None
    chunk_postings: DataFrame | None = None
    lexemes: DataFrame | None = None
    holders: DataFrame | None = None
    grams: DataFrame | None = None
    gram_counts: DataFrame | None = None


def cluster_key(slug: Column, path: Column) -> Column:
    n = F.size(path)
    return F.when(n == 0, slug).when(n <= 3, F.array_join(path, " > ")).otherwise(F.array_join(F.slice(path, F.lit(1), F.greatest(n - 2, F.lit(1))), " > "))


def light(sections: DataFrame, *more: Column) -> DataFrame:
    """The sections without their text, as searches look at them, and further columns of them."""
    path = F.array_join("path", " > ")
    return sections.select(
        "section_id", "slug", "corpus", "citation_label", path.alias("path_text"), cluster_key(F.col("slug"), F.col("path")).alias("cluster_key"),
        F.lower("section_key").alias("_k"), F.lower(F.regexp_replace("citation_label", r"\s+", "")).alias("_c"), F.lower("heading").alias("_h"), F.lower(path).alias("_p"), *more,
    )


def word_rows(sections: DataFrame) -> DataFrame:
    """(slug, section_id, part, field, class, word, pos) of the words of label, key, heading, path and text that are no stop words; the
    key is read without stop words and stems. Places count all words, from 1, and each field's go on from the last word of the field before."""
    fields = (("label", "A", "citation_label"), ("key", "A", "section_key"), ("heading", "A", "heading"), ("path", "B", F.array_join("path", " ")), ("content", "C", "content"))
    words = [A.simple_words(F.col(x) if isinstance(x, str) else x) for _, _, x in fields]
    last = [F.coalesce(F.array_max(F.transform(w, lambda x, i: F.when(A.stopped(x), 0).otherwise(i + 1))) if f[0] != "key" else F.size(w), F.lit(0)) for f, w in zip(fields, words, strict=True)]
    starts = [sum(last[:i], F.lit(0)) for i in range(len(last))]
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(c).alias("class"), start.alias("start"), w.alias("words")) for (f, c, _), start, w in zip(fields, starts, words, strict=True)])
    one = sections.select("slug", "section_id", F.explode(each).alias("_f"))
    rows = one.select("slug", "section_id", F.lit(0).cast("long").alias("part"), "_f.field", "_f.class", "_f.start", F.posexplode("_f.words").alias("_i", "word"))
    return rows.filter(~A.stopped(F.col("word")) | (F.col("field") == "key")).select("slug", "section_id", "part", "field", "class", "word", (F.col("start") + F.col("_i") + 1).cast("int").alias("pos"))


def chunk_word_rows(chunks: DataFrame) -> DataFrame:
    """The same of chunks (slug, section_id, chunk_index, content), whose words have no class; part is the chunk's number."""
    rows = chunks.select("slug", "section_id", F.col("chunk_index").cast("long").alias("part"), F.lit("chunk").alias("field"), F.lit("D").alias("class"), F.posexplode(A.simple_words(F.col("content"))).alias("_i", "word"))
    return rows.filter(~A.stopped(F.col("word"))).select("slug", "section_id", "part", "field", "class", "word", (F.col("_i") + 1).alias("pos"))


def dictionary(words: DataFrame) -> DataFrame:
    """(word, lexeme) of the distinct words of a table, each stemmed once; staged."""
    return stage(words.select("word").distinct().withColumn("lexeme", A.stems("word")), "dictionary")


def posted(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(slug, section_id, part, field, class, lexeme, pos): one row for each word, by a dictionary of the words. Rows are neither
    gathered nor shuffled here: sorted by lexeme and section they lie together in the store."""
    words = rows.join(known, "word", "left")
    lexeme = F.when(F.col("field") == "key", F.col("word")).otherwise(F.col("lexeme")).alias("lexeme")
    return words.select("slug", "section_id", "part", "field", "class", lexeme, "pos")


def grams_of(s: Column) -> Column:
    whole = F.concat(F.lit(EDGE), s, F.lit(EDGE))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(whole) - GRAM + 1), lambda i: F.substring(whole, i, GRAM)))


def held_strings(sections: DataFrame) -> DataFrame:
    """(slug, kind, s, section_id): headings, paths and the distinct tokens of texts, in lower case."""
    path = F.lower(F.array_join("path", " > "))
    own = [sections.select("slug", F.lit("heading").alias("kind"), F.lower("heading").alias("s"), "section_id"), sections.select("slug", F.lit("path").alias("kind"), path.alias("s"), "section_id")]
    tokens = sections.select("slug", F.lit("token").alias("kind"), F.explode(F.array_distinct(F.split(F.lower("content"), r"\s+"))).alias("s"), "section_id")
    return own[0].unionByName(own[1]).unionByName(tokens).filter("s <> ''")


def _counted(posted_: DataFrame, part_of: str) -> DataFrame:
    return posted_.groupBy("slug", "lexeme").agg(F.count("*").alias("n")).withColumn("part_of", F.lit(part_of))


def _tables(sections: DataFrame, chunks: DataFrame | None, parts: tuple[str, ...]) -> dict[str, DataFrame]:
    out = {"base": light(sections)}
    if "postings" in parts:
        named = chunks if chunks is None or "slug" in chunks.columns else chunks.join(sections.select("section_id", "slug"), "section_id")
        rows, own = word_rows(sections), None if named is None else chunk_word_rows(named)
        said = rows.filter("field <> 'key'").select("word")
        known = dictionary(said if own is None else said.unionByName(own.select("word")))
        out["postings"] = stage(posted(rows, known), "postings")
        out["lexemes"] = _counted(out["postings"], "section")
        if own is not None:
            out["chunk_postings"] = stage(posted(own, known), "chunk-postings")
            out["lexemes"] = out["lexemes"].unionByName(_counted(out["chunk_postings"], "chunk"))
    if "grams" in parts:
        out["holders"] = held_strings(sections)
        strings = stage(out["holders"].select("slug", "kind", "s").distinct(), "strings")
        out["grams"] = strings.select("slug", "kind", "s", F.explode(grams_of(F.col("s"))).alias("gram"))
        out["gram_counts"] = out["grams"].groupBy("slug", "kind", "gram").agg(F.count("*").alias("n"))
    return out


def _sorted(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def write_index(sections: DataFrame, path: str, chunks: DataFrame | None = None, parts: tuple[str, ...] = TEXT + SUBSTRINGS, block_bytes: int = 8 << 20) -> int:
    """Puts the documents (slugs) of `sections` into the index at `path`, in place of what it holds of them; others stay."""
    tables = {name: _sorted(df, TABLES[name]) for name, df in _tables(sections, chunks, parts).items()}
    return versions.publish(sections.sparkSession, path, tables, "slug", options={"parquet.block.size": str(block_bytes)})


def open_index(spark: SparkSession, path: str, parts: tuple[str, ...] = TEXT + SUBSTRINGS) -> Index:
    return Index(**{name: versions.read(spark, path, name) for name in ("base", *parts)})


def fresh_index(sections: DataFrame, chunks: DataFrame | None = None, parts: tuple[str, ...] = TEXT + SUBSTRINGS) -> Index:
    """An index for the searches of one job: as it comes, neither sorted nor stored, its grams cut as they are asked for."""
    tables = _tables(sections, chunks, parts)
    return Index(**{name: stage(df, name) if name in ("base", "lexemes") else df for name, df in tables.items()})


def looked_up(stored: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """The rows of a stored table whose key occurs in `asked`: a filter that the scan prunes by while they are few, else a join."""
    named = [r[0] for r in asked.select(key).distinct().limit(NAMED + 1).collect()]
    return stored.filter(F.col(key).isin(named)) if len(named) <= NAMED else stored.join(asked.select(key).distinct(), key, "left_semi")


def substring_pairs(index: Index, queries: DataFrame, kinds: Column) -> DataFrame:
    """(query_id, kind, s): which strings of the kinds asked for hold which query (query_id, _q), met by the query's rarest gram and
    verified. Queries shorter than a gram are met by all grams that hold them."""
    own = stage(queries.filter("_q <> ''").select("query_id", "_q", F.explode(kinds).alias("kind")), "substrings")
    some = [r[0] for r in own.select("kind").distinct().collect()]  # of three
    gram_counts, grams = (t.filter(F.col("kind").isin(some)) for t in (index.gram_counts, index.grams))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length("_q") - GRAM + 1, F.lit(1))), lambda i: F.substring("_q", i, GRAM))
    long = own.filter(F.length("_q") >= GRAM).select("query_id", "_q", "kind", F.explode(F.array_distinct(cut)).alias("gram"))
    short = own.filter(F.length("_q") < GRAM)
    counts = looked_up(gram_counts, "gram", long).groupBy("kind", "gram").agg(F.sum("n").alias("n"))
    # A gram that no string has rules its query out; the others keep their rarest.
    listed = long.join(counts, ["kind", "gram"], "left").groupBy("query_id", "_q", "kind").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("_r")).filter("_r.n > 0").select("query_id", "_q", "kind", F.col("_r.gram").alias("gram"))
    if not short.isEmpty():
        pieces = F.array_distinct(F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.lit(GRAM - n + 1)), lambda i: F.substring("gram", i, n)) for n in range(1, GRAM)])))  # noqa: B023
        parts = gram_counts.select("kind", "gram").distinct().select("kind", "gram", F.explode(pieces).alias("_q"))
        listed = listed.unionByName(short.join(parts, ["kind", "_q"]).select("query_id", "_q", "kind", "gram"))
    listed = stage(listed, "gram-queries")
    met = looked_up(grams, "gram", listed).join(listed, ["kind", "gram"]).filter(F.col("s").contains(F.col("_q")))
    return met.select("query_id", "kind", "s").distinct()


def asked_words(queries: DataFrame) -> DataFrame:
    """(query_id, kind, alt, clause, negated, at, lexeme) of the words that queries (query_id, q, _q, _singular) look for. Kind `match` holds the
    clauses of a query's alternatives; `phrase` and `singular` the whole query, and its singular form, as one phrase. Stop words count as places."""
    one = lambda x: F.array(F.array(F.struct(x.alias("text"), F.lit(False).alias("negated"))))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), a.alias("alts")) for k, a in (("match", A.clauses(F.col("q"))), ("phrase", one(F.col("_q"))), ("singular", one(F.col("_singular"))))])
    alts = queries.select("query_id", F.explode(kinds).alias("_k")).select("query_id", "_k.kind", F.posexplode("_k.alts").alias("alt", "_c"))
    each = alts.select("query_id", "kind", "alt", F.posexplode("_c").alias("clause", "_c")).select("query_id", "kind", "alt", "clause", "_c.negated", F.posexplode(A.simple_words(F.col("_c.text"))).alias("at", "word"))
    rows = stage(each.filter(~A.stopped(F.col("word"))), "asked")
    return rows.join(dictionary(rows), "word").drop("word")


def search_trees(words: DataFrame) -> DataFrame:
    """(query_id, kind, tree, needed): the JSON tree of each search, and the lexemes that each of its alternatives needs. An
    alternative of excluded words alone finds nothing and is left out."""
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    phrase = F.array_sort(F.collect_list(F.struct("at", "lexeme")))
    clauses = words.groupBy("query_id", "kind", "alt", "clause", "negated").agg(phrase.alias("_w"))
    first = F.element_at("_w", 1)
    rest = F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0)))
    start = F.struct(first["at"].alias("at"), quoted(first["lexeme"]).alias("t"))
    text = F.aggregate(rest, start, lambda a, x: F.struct(x["at"].alias("at"), F.concat(F.lit("["), (x["at"] - a["at"]).cast("string"), F.lit(","), a["t"], F.lit(","), quoted(x["lexeme"]), F.lit("]")).alias("t")))["t"]
    text = F.when(F.col("negated"), F.concat(F.lit('["!",'), text, F.lit("]"))).otherwise(text)
    own = clauses.select("query_id", "kind", "alt", "clause", text.alias("t"), F.when(F.col("negated"), F.array().cast("array<string>")).otherwise(F.transform("_w", lambda x: x["lexeme"])).alias("l"))
    alts = own.groupBy("query_id", "kind", "alt").agg(F.array_sort(F.collect_list(F.struct("clause", "t"))).alias("_t"), F.array_distinct(F.flatten(F.collect_list("l"))).alias("l")).filter("size(l) > 0")
    joined = lambda op, xs: F.concat(F.lit(f'["{op}",'), F.array_join(F.transform(xs, lambda x: x["t"]), ","), F.lit("]"))
    alts = alts.select("query_id", "kind", "alt", F.when(F.size("_t") == 1, F.element_at("_t", 1)["t"]).otherwise(joined("&", F.col("_t"))).alias("t"), "l")
    whole = alts.groupBy("query_id", "kind").agg(F.array_sort(F.collect_list(F.struct("alt", "t", "l"))).alias("_a"))
    return stage(whole.select("query_id", "kind", F.when(F.size("_a") == 1, F.element_at("_a", 1)["t"]).otherwise(joined("|", F.col("_a"))).alias("tree"), F.transform("_a", lambda a: a["l"]).alias("needed")), "trees")


def ranked_texts(stored: DataFrame, lexemes: DataFrame, part_of: str, words: DataFrame, trees: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(query_id, section_id, part, kind, field, rank) of all texts that a search's tree holds for. Kind match reads all fields of a
    text together, by their classes (field is null); phrases read each field on its own, as words without a class. A search begins
    with the rarest lexeme that each of its alternatives needs, by the stored counts, and meets the texts that hold it. `within`
    (query_id, section_id) bounds them."""
    own = stage(looked_up(stored, "lexeme", words), "met")
    counts = looked_up(lexemes.filter(F.col("part_of") == part_of), "lexeme", words).groupBy("lexeme").agg(F.sum("n").alias("n"))
    needed = trees.select("query_id", "kind", F.posexplode("needed").alias("alt", "_l")).select("query_id", "kind", "alt", F.explode("_l").alias("lexeme"))
    rarest = needed.join(counts, "lexeme", "left").groupBy("query_id", "kind", "alt").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "lexeme")).alias("_r")).filter("_r.n > 0").select("query_id", "kind", F.col("_r.lexeme").alias("lexeme")).distinct()
    owners = own.select("section_id", "part", "lexeme").distinct().join(rarest, "lexeme").select("query_id", "kind", "section_id", "part").distinct()
    if within is not None:
        owners = owners.join(within, ["query_id", "section_id"], "left_semi")
    wanted = owners.join(words.select("query_id", "kind", "lexeme").distinct(), ["query_id", "kind"])
    found = wanted.join(own, ["section_id", "part", "lexeme"])
    match = F.col("kind") == "match"
    weight = F.coalesce(*[F.when(F.col("class") == c, F.lit(w)) for c, w in A.WEIGHTS.items() if c != "D"], F.lit(A.WEIGHTS["D"]))
    hit = F.struct("pos", "lexeme", F.when(match, weight).otherwise(F.lit(A.WEIGHTS["D"])).alias("weight"))
    texts = found.withColumn("field", F.when(~match, F.col("field"))).groupBy("query_id", "kind", "section_id", "part", "field").agg(F.array_sort(F.collect_list(hit)).alias("_h"), F.collect_set("lexeme").alias("_s"))
    able = texts.join(trees, ["query_id", "kind"]).filter(F.exists("needed", lambda l: F.size(F.array_except(l, F.col("_s"))) == 0))  # noqa: E741
    of = lambda name: F.transform("_h", lambda h: h[name])
    return able.withColumn("rank", A.cover_densities("tree", of("pos"), of("lexeme"), of("weight"))).filter("rank is not null").select("query_id", "section_id", "part", "kind", "field", "rank")


def best_parts(ranks: DataFrame) -> DataFrame:
    """(query_id, section_id, chunk_phrase_rank, chunk_rank): of each section's chunks the one with the best phrase, then text, then the first."""
    of = lambda *kinds: F.coalesce(F.max(F.when(F.col("kind").isin(*kinds), F.col("rank"))), F.lit(0.0))
    each = ranks.groupBy("query_id", "section_id", "part").agg(of("phrase", "singular").alias("chunk_phrase_rank"), of("match").alias("chunk_rank"))
    best = each.groupBy("query_id", "section_id").agg(F.max(F.struct("chunk_phrase_rank", "chunk_rank", (-F.col("part")).alias("_p"))).alias("_b"))
    return best.select("query_id", "section_id", "_b.chunk_phrase_rank", "_b.chunk_rank")

