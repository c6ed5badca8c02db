"""Checks of drafted answers. An answer is one row; its lines are an array, so no step of the gate shuffles.

Drafts, verdicts on their claims and retrieved authorities are input tables, as model calls are outside this engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.present import quoted
from ..functions.text import clean
from ..sources.staging import stage

# The headings of an answer, of which all but the last begin sections whose lines need a citation.
BOTTOM, BEST = "Bottom line:", "Best authorities to inspect or cite:"
SUBSTANTIVE = (BOTTOM, "What this means:", "Your options:", "Risks or constraints:")
HEADINGS = (*SUBSTANTIVE, BEST)
# The headings as drafts write them.
WRITTEN = (
    (r"Bottom line\s*:?", BOTTOM), (r"What this means\s*:?", "What this means:"), (r"Your options\s*:?", "Your options:"),
    (r"Risks(?: or)? constraints\s*:?", "Risks or constraints:"), (r"Best authorities to inspect(?: or cite)?\s*:?", BEST),
)
BRACKET = r"\[([^\]]+)\]"
#: Prose mentions of authorities, between ASCII word boundaries.
MENTION = r"(?i)(?<![A-Za-z0-9_])(?:(?:standing order|so)\s+[0-9]+[a-z]?|[0-9]+/[0-9]+(?![A-Za-z0-9_]))"
#: Words that refer to an authority inside another citation.
EMBEDDED = ("mentioned in", "referred to in", "cited in")


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _tidy(x: Column) -> Column:
    return trimmed(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def replaced(text: Column, pattern: str, group: int, by) -> Column:
    """The text with each match of the pattern replaced by a function of its group."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.array_join(F.flatten(F.zip_with(between, found, lambda b, m: F.array(b, F.when(m.isNotNull(), by(m)).otherwise(F.lit(""))))), "")


def formatted(x: Column) -> Column:
    """Bullets as `- `, no blanks at line ends, the first of each heading in its full form."""
    x = F.regexp_replace(F.regexp_replace(x, r"(?m)^\*\s+", "- "), r"(?m)^\*\*\s+", "- ")
    x = trimmed(F.regexp_replace(x, r"[ \t]+\n", "\n"))
    for written, heading in WRITTEN:
        x = F.regexp_replace(x, rf"(?is)\A(.*?)(?m:^{written}$)", f"$1{heading}")
    return x


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def is_heading(line: Column) -> Column:
    return trimmed(line).isin(*HEADINGS)


def sections(lines_: Column) -> Column:
    """The heading in effect at each line, null before the first."""
    return F.aggregate(lines_, F.array().cast("array<string>"), lambda a, x: F.concat(a, F.array(F.when(is_heading(x), trimmed(x)).otherwise(F.try_element_at(a, F.lit(-1))))))


def bracketed(text: Column) -> Column:
    """The contents of [..], as they are."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(BRACKET), 1), trimmed), lambda x: x != "")


def citations(text: Column) -> Column:
    """The distinct contents of [..], split at ; and ,."""
    parts = F.flatten(F.transform(bracketed(text), lambda x: F.split(x, "[;,]")))
    return F.array_distinct(F.filter(F.transform(parts, trimmed), lambda x: x != ""))


def relabelled(text: Column, labels: Column) -> Column:
    """Each [a; b] as [a] [b], once each; a citation of a part of a label (`SO 89(1)`) becomes the label."""

    def own(part: Column) -> Column:
        x = F.regexp_replace(clean(part), r"(?i)^standing order\s+", "SO ")
        same = F.filter(labels, lambda label: F.lower(label) == F.lower(x))
        child = F.filter(labels, lambda label: F.regexp_like(x, F.concat(F.lit("(?iu)^"), quoted(label), F.lit(r"(?:\([^()]+\))+$"))))
        return F.concat(F.lit("["), F.coalesce(F.try_element_at(same, F.lit(1)), F.try_element_at(child, F.lit(1)), part), F.lit("]"))

    def rewritten(inner: Column) -> Column:
        parts = F.filter(F.transform(F.split(inner, "[;,]"), trimmed), lambda p: p != "")
        return F.when(F.size(parts) == 0, F.concat(F.lit("["), inner, F.lit("]"))).otherwise(F.array_join(F.array_distinct(F.transform(parts, own)), " "))

    return replaced(text, BRACKET, 1, rewritten)


def allowed(citation: Column, labels: Column) -> Column:
    """A citation equals a label, or goes on after it with a bracket, space or mark."""
    after = lambda label: F.substr(citation, F.length(label) + 1, F.lit(1))
    return F.exists(labels, lambda label: (citation == label) | (citation.startswith(label) & after(label).isin("(", " ", ",", ";", ":")))


def embedded(citation: Column) -> Column:
    out = F.lit(False)
    for words in EMBEDDED:
        out = out | F.lower(citation).contains(words)
    return out


def invalid_citations(text: Column, labels: Column) -> Column:
    return F.array_distinct(F.filter(bracketed(text), lambda c: ~allowed(c, labels) | embedded(c)))


def mention_key(x: Column) -> Column:
    return F.lower(clean(F.regexp_replace(x, r"(?i)^standing order\s+", "SO ")))


def invalid_mentions(text: Column, labels: Column) -> Column:
    """Authorities that the prose outside brackets names and that were not retrieved."""
    known = F.transform(labels, mention_key)
    said = F.regexp_extract_all(F.regexp_replace(text, BRACKET, " "), F.lit(MENTION), F.lit(0))
    return F.array_distinct(F.filter(said, lambda m: ~F.array_contains(known, mention_key(m))))


def rewritten_mentions(text: Column, labels: Column, by: str = "the retrieved authority") -> Column:
    """Mentions of authorities that were not retrieved, replaced; inside brackets too."""
    known = F.transform(labels, mention_key)
    return replaced(text, MENTION, 0, lambda m: F.when(F.array_contains(known, mention_key(m)), m).otherwise(F.lit(by)))


def _row(line: Column, section: Column) -> Column:
    return F.struct(line.alias("line"), section.alias("section"))


def _cited(line: Column, labels: Column) -> Column:
    own = bracketed(line)
    return (F.size(own) > 0) & F.forall(own, lambda c: allowed(c, labels))


def pruned(text: Column, labels: Column) -> tuple[Column, Column]:
    """(text, removed lines): substantive sections keep lines whose citations are all allowed, the authorities' section its bullets;
    headings, blank lines and all else stay."""
    own = lines(formatted(text))
    rows = F.zip_with(own, sections(own), lambda x, s: _row(F.regexp_replace(x, r"(?U)\s+$", ""), s))

    def keep(r: Column) -> Column:
        t = trimmed(r["line"])
        in_best = r["section"].eqNullSafe(F.lit(BEST))
        needs = F.coalesce(r["section"].isin(*SUBSTANTIVE), F.lit(False))
        return (t == "") | is_heading(t) | F.when(in_best, t.rlike(r"^-\s*\S")).when(needs, _cited(t, labels)).otherwise(True)

    kept = F.transform(F.filter(rows, keep), lambda r: F.when(is_heading(r["line"]), trimmed(r["line"])).otherwise(r["line"]))
    return _tidy(F.array_join(kept, "\n")), F.transform(F.filter(rows, lambda r: ~keep(r)), lambda r: r["line"])


def claims(text: Column) -> Column:
    """array<struct<id,line_index,text,citations>>: the cited lines of the substantive sections, named claim-{line + 1}."""
    own = lines(formatted(text))
    rows = F.zip_with(own, sections(own), _row)
    each = F.transform(rows, lambda r, i: F.struct(F.concat(F.lit("claim-"), (i + 1).cast("string")).alias("id"), i.cast("long").alias("line_index"), trimmed(r["line"]).alias("text"), bracketed(r["line"]).alias("citations"), r["section"].alias("section")))
    good = F.filter(each, lambda c: F.coalesce(c["section"].isin(*SUBSTANTIVE), F.lit(False)) & ~is_heading(c["text"]) & (F.size(c["citations"]) > 0))
    return F.transform(good, lambda c: F.struct(c["id"].alias("id"), c["line_index"].alias("line_index"), c["text"].alias("text"), c["citations"].alias("citations")))


def without_claims(text: Column, ids: Column) -> Column:
    """The text without the lines of the claims with these ids."""
    own = lines(formatted(text))
    numbered = F.transform(own, lambda x, i: F.struct(x.alias("line"), F.concat(F.lit("claim-"), (i + 1).cast("string")).alias("id")))
    kept = F.filter(numbered, lambda r: ~F.array_contains(ids, r["id"]))
    return F.when(F.size(ids) == 0, formatted(text)).otherwise(_tidy(F.array_join(F.transform(kept, lambda r: r["line"]), "\n")))


def without_empty_sections(text: Column) -> Column:
    """The text without headings that have nothing under them."""
    own = lines(formatted(text))
    numbers = F.aggregate(own, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + is_heading(x).cast("int"))))
    rows = F.zip_with(own, numbers, lambda x, n: F.struct(x.alias("line"), n.alias("n")))
    full = F.transform(F.filter(rows, lambda r: (trimmed(r["line"]) != "") & ~is_heading(r["line"])), lambda r: r["n"])
    return _tidy(F.array_join(F.transform(F.filter(rows, lambda r: (r["n"] == 0) | F.array_contains(full, r["n"])), lambda r: r["line"]), "\n"))


def has_content(text: Column, heading: str) -> Column:
    """Whether anything stands under the first heading of this name."""
    own = lines(formatted(text))
    rows = F.zip_with(own, sections(own), _row)
    return F.exists(rows, lambda r: r["section"].eqNullSafe(F.lit(heading)) & (trimmed(r["line"]) != "") & ~is_heading(r["line"]))


def with_gaps(text: Column, gaps: Column, teller: str = "The search") -> Column:
    """The text with a section of the points for which nothing was retrieved."""
    own = F.filter(F.transform(F.coalesce(gaps, F.array().cast("array<string>")), clean), lambda g: g != "")
    said = F.transform(own, lambda g: F.concat(F.lit(f"- {teller} did not retrieve authority establishing "), g, F.lit(". That unresolved point should not be treated as proved either way.")))
    return F.when(F.size(own) == 0, formatted(text)).otherwise(trimmed(F.concat(formatted(text), F.lit("\n\nEvidence gap:\n"), F.array_join(said, "\n"))))


# The sentences of an answer that stands in for a rejected draft.
FALL_BOTTOM = "Relevant authorities were retrieved, but the drafted answer did not pass the grounding checks, so I cannot safely state a stronger procedural conclusion from this result set "
FALL_NONE = "No sufficiently relevant authority was retrieved to support a procedural conclusion."
FALL_MEANS = "Treat the authorities below as inspection points rather than as a synthesised answer "
FALL_MEANS_NONE = "A narrower search or additional authority is needed before giving procedural advice."
FALL_OPTION = ("- Inspect or cite ", " to test whether it directly governs the step in issue [", "].")
FALL_OPTION_NONE, FALL_RISK, FALL_BEST_NONE = "- No clearly relevant authority was retrieved.", "- A substantive answer was withheld because validation failed: ", "- No strong authorities were retrieved."


def fallback(authorities: Column, reason: Column, most: int = 4) -> Column:
    """An answer from authorities (array<struct<citation_label,heading,path,authority_class,authority_function>>) alone."""
    best = F.slice(F.coalesce(authorities, F.array().cast("array<struct<citation_label:string,heading:string,path:array<string>,authority_class:string,authority_function:string>>")), 1, most)
    some = F.size(best) > 0
    cited = lambda a: F.concat(F.lit("["), a["citation_label"], F.lit("]"))
    why = lambda a: F.coalesce(F.nullif(F.trim(a["heading"]), F.lit("")), F.try_element_at(a["path"], F.lit(-1)), F.lit("Relevant authority"))
    option = lambda a: F.concat(F.lit(FALL_OPTION[0]), F.coalesce(a["heading"], F.lit("Relevant authority")), F.lit(FALL_OPTION[1]), a["citation_label"], F.lit(FALL_OPTION[2]))
    line = lambda a: F.concat(F.lit("- "), cited(a), F.lit(" "), why(a), F.lit(" ("), a["authority_class"], F.lit("; "), a["authority_function"], F.lit(")"))
    either = lambda yes, no: F.when(some, yes).otherwise(F.lit(no))
    return F.concat_ws(
        "\n", F.lit(BOTTOM), either(F.concat(F.lit(FALL_BOTTOM), F.array_join(F.transform(best, cited), " "), F.lit(".")), FALL_NONE), F.lit(""),
        F.lit("What this means:"), either(F.concat(F.lit(FALL_MEANS), cited(F.try_element_at(best, F.lit(1))), F.lit(".")), FALL_MEANS_NONE), F.lit(""),
        F.lit("Your options:"), either(F.array_join(F.transform(best, option), "\n"), FALL_OPTION_NONE), F.lit(""),
        F.lit("Risks or constraints:"), F.concat(F.lit(FALL_RISK), reason), F.lit(""), F.lit(BEST), either(F.array_join(F.transform(best, line), "\n"), FALL_BEST_NONE),
    )


def gate(drafts: DataFrame) -> DataFrame:
    """(question_id, status, reason, answer) of drafts (question_id, draft, labels array, verdicts array<struct<id,supported>>, gaps
    array, authorities): status `grounded`, or `fallback` with the first check that failed."""
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    # Each step is written and read again: inside one expression the steps would be put into each other many times over.
    own = F.col("labels")
    d = stage(drafts.withColumn("labels", labels).withColumn("_t0", formatted(relabelled(F.coalesce("draft", F.lit("")), own))), "relabelled")
    d = stage(d.withColumn("_t1", formatted(pruned(F.col("_t0"), own)[0])), "pruned")
    d = d.withColumn("_c1", invalid_citations(F.col("_t1"), own)).withColumn("_m1", invalid_mentions(F.col("_t1"), own)).withColumn("_again", F.when(F.size("_m1") > 0, formatted(rewritten_mentions(F.col("_t1"), own))))
    d = stage(d, "mentions")
    d = stage(d.withColumn("_t2", F.coalesce(formatted(pruned(F.col("_again"), own)[0]), F.col("_t1"))), "grounded")
    supported = F.transform(F.filter(F.coalesce("verdicts", F.array().cast("array<struct<id:string,supported:boolean>>")), lambda v: v["supported"]), lambda v: v["id"])
    d = d.withColumn("_m2", invalid_mentions(F.col("_t2"), own)).withColumn("_c2", invalid_citations(F.col("_t2"), own)).withColumn("_claims", F.transform(claims(F.col("_t2")), lambda c: c["id"]))
    d = stage(d.withColumn("_bad", F.array_except("_claims", supported)), "claims")
    d = stage(d.withColumn("_t3", without_empty_sections(without_claims(F.col("_t2"), F.col("_bad")))), "supported")
    whole = (F.size(claims(F.col("_t3"))) > 0) & (F.size(invalid_citations(F.col("_t3"), own)) == 0) & (F.size(invalid_mentions(F.col("_t3"), own)) == 0)
    reason = (
        F.when(F.col("_t0") == "", "the draft was empty").when(F.col("_t1") == "", "nothing was left after unsupported content was removed")
        .when(F.size("_c1") > 0, F.concat(F.lit("cited authorities that were not retrieved: "), F.array_join("_c1", ", ")))
        .when((F.size("_m1") > 0) & ((F.size("_m2") > 0) | (F.size("_c2") > 0) | (F.col("_t2") == "")), F.concat(F.lit("authorities that could not be grounded: "), F.array_join(F.when(F.size("_m2") > 0, F.col("_m2")).otherwise(F.col("_c2")), ", ")))
        .when(F.size("_claims") == 0, "no grounded claims remained").when(~has_content(F.col("_t3"), BOTTOM), "the bottom line was lost").when(~whole, "no valid set of claims was left")
    )
    d = stage(d.withColumn("reason", reason), "reasons")
    return d.select("question_id", F.when(F.col("reason").isNull(), "grounded").otherwise("fallback").alias("status"), "reason", F.when(F.col("reason").isNull(), with_gaps(F.col("_t3"), F.col("gaps"))).otherwise(fallback(F.col("authorities"), F.col("reason"))).alias("answer"))


def citation_verdicts(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """(answer_id, citation, ok) for answers (answer_id, answer) and the labels retrieved for each (answer_id, labels)."""
    each = answers.select("answer_id", F.explode(citations(F.col("answer"))).alias("citation"))
    ok = allowed(F.col("citation"), F.col("labels")) & ~embedded(F.col("citation"))
    return each.join(labels, "answer_id", "left").select("answer_id", "citation", F.coalesce(ok, F.lit(False)).alias("ok"))


def event_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """(question_id, seq, kind, payload): tables with a question_id as the events of an answer, kinds in the order given."""
    out = None
    for i, (kind, df) in enumerate(parts.items()):
        own = df.select("question_id", F.lit(i).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in df.columns if c != "question_id"])).alias("payload"))
        out = own if out is None else out.unionByName(own)
    return out


def diagnostics(events: DataFrame, kinds: tuple[str, ...], appended: tuple[str, ...] = ("answer_delta",)) -> DataFrame:
    """One row a question: of each kind of event the last payload; payloads of `appended` kinds joined in order."""
    row = F.struct("seq", "payload")
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("payload")), F.when(F.col("kind") == k, F.col("seq"))).alias(k)
    every = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, row))), lambda x: x["payload"]), "").alias(k)
    return events.groupBy("question_id").agg(*[every(k) if k in appended else last(k) for k in kinds])
