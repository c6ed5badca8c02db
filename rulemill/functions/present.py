"""How results are shown: highlights, source links, section HTML, labels; and JSON in a model's reply. All as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, escape_html, first_words, singular, singular_phrase, strip_tags

WORD = "[A-Za-z0-9_]"


def quoted(x: Column) -> Column:
    return F.regexp_replace(x, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def whole(x: Column) -> Column:
    """A pattern for `x` between ASCII word boundaries, in any case."""
    edge = lambda c, ahead: F.when(c.rlike(WORD), F.lit(f"(?{'' if ahead else '<'}!{WORD})")).otherwise(F.lit(f"(?{'' if ahead else '<'}={WORD})"))
    return F.concat(F.lit("(?iu)"), edge(F.left(x, F.lit(1)), False), quoted(x), edge(F.right(x, F.lit(1)), True))


def marked(html: Column, x: Column) -> Column:
    return F.regexp_replace(html, whole(x), F.lit("<mark>$0</mark>"))


def highlight_phrase(text: Column, query: Column) -> Column:
    """The escaped text with the query and its singular form marked, the longer one first; null where neither occurs."""
    q, one = clean(query), singular_phrase(query)
    has = lambda x: F.coalesce((x != "") & F.regexp_like(text, whole(x)), F.lit(False))
    html = F.when(has(q), marked(escape_html(text), q)).otherwise(escape_html(text))
    # A phrase is never shorter than its singular form; where both have one length, the query goes first.
    return F.when(has(one), marked(html, one)).when(has(q), html)


def highlight_words(text: Column, query: Column) -> Column:
    """The escaped text with each word of the query marked, in its singular form."""
    words = F.filter(F.transform(F.split(clean(query), " "), singular), lambda w: w != "")
    return F.aggregate(words, escape_html(text), marked)


def highlight(text: Column, query: Column) -> Column:
    """A query of several words is marked as a phrase where it occurs, else word by word."""
    several = clean(query).contains(" ")
    return F.coalesce(F.when(several, highlight_phrase(text, query)), highlight_words(text, query))


def _escaped(x: Column, kept: str) -> Column:
    """Percent-encoded UTF-8, with letters, digits and the marks in `kept` as they are."""
    x = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for c in kept:
        x = F.replace(x, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return x


# What the two URI encodings leave, besides letters, digits and - _ . *
COMPONENT_MARKS = "!~'()"
ADDRESS_MARKS = COMPONENT_MARKS + ";,/?:@&=+$#"


def source_href(url: Column, anchor: Column, content: Column, words: int = 10) -> Column:
    """The page's address with the anchor and a text fragment of the content's first words."""
    start = first_words(strip_tags(content), words)
    text = F.when(start != "", F.concat(F.lit(":~:text="), _escaped(start, COMPONENT_MARKS)))
    place = F.when(anchor != "", _escaped(anchor, ADDRESS_MARKS))
    tail = F.when(text.isNotNull() | place.isNotNull(), F.concat(F.lit("#"), F.coalesce(place, F.lit("")), F.coalesce(text, F.lit(""))))
    return F.when(url != "", F.concat(F.element_at(F.split(url, "#"), 1), F.coalesce(tail, F.lit(""))))


def citation_href(label: Column, corpus: Column, focus: Column) -> Column:
    return F.concat(F.lit("/?q="), F.url_encode(label), F.lit("&corpus="), F.url_encode(corpus), F.lit("&focus="), F.url_encode(focus))


def href_parameter(href: Column, name: str) -> Column:
    return F.url_decode(F.nullif(F.regexp_extract(href, rf"[?&]{name}=([^&#]*)", 1), F.lit("")))


# The class names of clause labels, bullets and blocks.
CLAUSE_SPAN, SUB_SPAN = '<span class="oo-clauseLabel">$1</span>', '$1<span class="oo-subclauseLabel">$2</span>'
BULLET_SPAN = '<span class="oo-bulletRow"><span class="oo-bulletLabel">•</span><span>$1</span></span>'
BULLETS, CLAUSES, PARAGRAPH = '<div class="oo-sectionBlock oo-sectionBlockBullets">', '<div class="oo-sectionBlock oo-sectionBlockClause">', '<p class="oo-sectionParagraph">'


def clause_markup(html: Column) -> Column:
    x = F.regexp_replace(html, r"(?m)^(\([0-9]+[A-Z]?\))", CLAUSE_SPAN)
    x = F.regexp_replace(x, r"(^|\s)(\([a-z]\))(?=\s)", SUB_SPAN)
    x = F.regexp_replace(x, r"(?i)(^|\s)(\([ivx]+\))(?=\s)", SUB_SPAN)
    return F.regexp_replace(x, r"(?m)^•\s+(.*)$", BULLET_SPAN)


def paragraphs(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"\n{2,}"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def section_html(content: Column, highlighted: Column) -> Column:
    """Paragraphs of the highlighted (else the escaped) content, with bullets, clauses and plain text in their own blocks."""
    base = F.when(F.trim(highlighted) != "", highlighted).otherwise(escape_html(content))

    def block(p):
        lines = F.filter(F.transform(F.split(p, r"\n+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
        bullets = F.concat(F.lit(BULLETS), F.array_join(F.transform(lines, clause_markup), ""), F.lit("</div>"))
        clause = F.concat(F.lit(CLAUSES), clause_markup(p), F.lit("</div>"))
        is_clause = p.rlike(r"(?i)^\([0-9]+[A-Z]?\)|(^|\s)(\([a-z]\)|\([ivx]+\))")
        return F.when(p.rlike(r"(?m)^•\s+"), bullets).when(is_clause, clause).otherwise(F.concat(F.lit(PARAGRAPH), clause_markup(p), F.lit("</p>")))

    return F.array_join(F.transform(paragraphs(base), block), "")


#: Names of the corpora.
CORPUS_NAMES = {"standing_orders": "Standing Orders", "speakers_rulings": "Speakers' Rulings"}


def corpus_label(corpus: Column) -> Column:
    out = corpus
    for name, label in CORPUS_NAMES.items():
        out = F.when(corpus == name, F.lit(label)).otherwise(out)
    return out


#: The reason shown for a result, the first whose signal is set.
REASONS = (("exact_key", "Exact citation"), ("exact_citation", "Exact citation"), ("exact_heading", "Exact heading"), ("heading_match", "Heading phrase"), ("body_match", "Body phrase"))
SIGNAL_NAMES = (("exact_key", "exact section"), ("exact_citation", "exact citation"), ("exact_heading", "exact heading"), ("heading_match", "heading phrase"), ("body_match", "body phrase"), ("path_match", "path phrase"))


def result_reason() -> Column:
    """From the signal columns of a search."""
    return F.coalesce(*[F.when(F.col(name), F.lit(reason)) for name, reason in REASONS], F.lit("Ranked match"))


def signal_list() -> Column:
    return F.coalesce(F.nullif(F.concat_ws(", ", *[F.when(F.col(name), F.lit(label)) for name, label in SIGNAL_NAMES]), F.lit("")), F.lit("none"))


def summary_text(shown: Column, total: Column, corpus: Column, latency_ms: Column) -> Column:
    where = F.coalesce(F.concat(F.lit(" in "), corpus_label(corpus)), F.lit(""))
    return F.concat(shown.cast("string"), F.lit(" of "), total.cast("string"), F.when(total == 1, F.lit(" result")).otherwise(F.lit(" results")), where, F.lit(" · "), latency_ms.cast("string"), F.lit(" ms"))


#: How far an answer is, by what its stage's label holds.
PROGRESS = (("complete", 100), ("answer", 90), ("synth", 82), ("authorit", 72), ("retriev", 58), ("search", 42), ("plan", 22), ("start", 10))


def progress(stage: Column, loading: Column) -> Column:
    x = F.lower(stage)
    known = F.coalesce(*[F.when(x.contains(word), F.lit(value)) for word, value in PROGRESS], F.when(loading, 14).otherwise(100))
    return F.when(F.coalesce(stage, F.lit("")) == "", F.when(loading, 6).otherwise(0)).otherwise(known)


def likely_json(reply: Column) -> Column:
    """The JSON in a model's reply: without code fences, from the first { to the last }, else from [ to ], else all of it."""
    x = F.regexp_replace(F.regexp_replace(reply, r"(?i)^```json\s*", ""), r"^```\s*", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\s*```$", ""), r"^\s+|\s+$", "")
    return F.coalesce(*[F.nullif(F.regexp_extract(x, form, 0), F.lit("")) for form in (r"(?s)\{.*\}", r"(?s)\[.*\]")], x)


def parsed_json(reply: Column) -> Column:
    """As a variant, null where it is no JSON."""
    return F.try_parse_json(likely_json(reply))
