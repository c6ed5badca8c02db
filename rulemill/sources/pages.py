"""Rule books from web pages and from extracted text: page elements, chapters, orders and rulings.

A small tolerant reader turns each page into rows (url, pos, tag, text) of its block elements; everything after that is windows and
groups. An order or ruling begins at a start line and ends before the next start or heading; its headings are those in effect at its
first line. Navigation, scripts and styles are left out; nested elements are read once, with the outer list.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T

BLOCKS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "table"))
SKIPPED = frozenset(("script", "style", "nav", "footer", "noscript", "template"))
ELEMENTS = K.ArrayType(K.StructType([K.StructField("pos", K.IntegerType()), K.StructField("tag", K.StringType()), K.StructField("text", K.StringType()), K.StructField("items", K.ArrayType(K.StringType()))]))


class _Reader(HTMLParser):
    """The block elements of a page, in order. A block ends at its end tag or where the next block begins, as paragraphs may stay
    open; lists gather their items."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.tag, self.text, self.items, self.depth, self.skip = None, [], None, 0, 0

    def _close(self):
        if self.tag:
            text = " ".join("".join(self.text).split())
            items = [t for t in (" ".join("".join(i).split()) for i in self.items or []) if t]
            self.out.append({"pos": len(self.out), "tag": self.tag, "text": text, "items": items})
        self.tag, self.text, self.items = None, [], None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif self.tag in ("ul", "ol", "table") and self.depth:
            self.depth += tag == self.tag
            if tag == "li":
                self.items.append([])
            self.text.append(" ")
        elif tag in BLOCKS:
            self._close()
            self.tag, self.items, self.depth = tag, [], int(tag in ("ul", "ol", "table"))
        elif tag in ("br", "div", "li", "td"):
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == self.tag:
            self.depth -= 1
            if self.depth <= 0:
                self._close()

    def handle_data(self, data):
        if self.skip or not self.tag:
            return
        self.text.append(data)
        if self.items:
            self.items[-1].append(data)


def read_elements(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._close()
    return reader.out


@F.pandas_udf(ELEMENTS)
def _elements(html: pd.Series) -> pd.Series:
    return html.map(read_elements)


#: A page's lines that are no content, and the one that ends it.
PUBLISHED, SHARE = r"(?i)^Originally published:", r"(?i)^Share$"


def elements(pages: DataFrame) -> DataFrame:
    """(url, pos, tag, text, items) of pages (url, html): blocks with text, up to the line that ends the content."""
    each = pages.select("url", F.explode(_elements("html")).alias("_e")).select("url", "_e.*").filter("text <> ''")
    ends = F.max(F.col("text").rlike(SHARE)).over(W.partitionBy("url").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return each.withColumn("_end", ends).filter(~F.col("_end") & ~F.col("text").rlike(PUBLISHED)).drop("_end")


#: Fixed value: the first heading of a chapter's page.
CHAPTER = r"(?i)^Chapter\s+([0-9]+):\s*(.+)$"


def chapters(lines: DataFrame, form: str = CHAPTER) -> tuple[DataFrame, DataFrame]:
    """(url, chapter, chapter_title) of the pages whose first h1 names a chapter, and (url, heading) of the others."""
    first = lines.groupBy("url").agg(F.min_by("text", F.when(F.col("tag") == "h1", F.col("pos"))).alias("heading"))
    named = F.col("heading").rlike(form)
    good = first.filter(named).select("url", F.regexp_extract("heading", form, 1).alias("chapter"), T.title_case(F.regexp_extract("heading", form, 2)).alias("chapter_title"))
    return good, first.filter(F.coalesce(~named, F.lit(True))).select("url", "heading")


def _grouped(lines: DataFrame) -> DataFrame:
    """Rows with `starts` and `ends` flags -> those of each order or ruling, as `unit`; lines before the first start of a run are left out."""
    order = W.partitionBy("url").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("unit", F.sum((F.col("starts") | F.col("ends")).cast("int")).over(order))


def _last(value: Column, level: list[str]) -> Column:
    return F.last(value, ignorenulls=True).over(W.partitionBy("url", *level).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))


def parse_orders(pages: DataFrame, form: str = CHAPTER) -> DataFrame:
    """Orders of chapter pages: (url, seq, order_number, order_label, chapter, chapter_title, part_heading, heading, path, content,
    source_anchor). A heading in capitals is a part; a numbered line begins an order; lists give `• item` lines; tables are dropped."""
    lines = elements(pages)
    good, _ = chapters(lines, form)
    head = F.col("tag").rlike("^h[2-6]$")
    part = head & T.caps_heading(F.col("text")) & ~F.col("text").rlike(r"^SOs?\s")
    start = ~part & (head | (F.col("tag") == "p")) & T.order_start(F.col("text"))
    marked = _grouped(lines.filter("tag <> 'h1'").withColumn("starts", start).withColumn("ends", part)).withColumn("part_heading", _last(F.when(part, F.col("text")), []))
    said = F.when(F.col("tag").isin("ul", "ol"), F.transform("items", lambda i: F.concat(F.lit("• "), i))).when(F.col("tag") == "table", F.array().cast("array<string>")).otherwise(F.array("text"))
    row = F.struct("pos", "starts", F.when(F.col("starts") | F.col("ends"), F.array().cast("array<string>")).otherwise(said).alias("said"))
    units = marked.groupBy("url", "unit").agg(F.min_by("text", "pos").alias("_line"), F.min_by("part_heading", "pos").alias("part_heading"), F.array_sort(F.collect_list(row)).alias("_rows"), F.min("pos").alias("seq")).filter("_rows[0].starts")
    number, heading = T.order_parts(F.col("_line"))
    out = units.join(good, "url").withColumn("order_number", number).withColumn("heading", heading).withColumn("order_label", F.concat(F.lit("SO "), "order_number"))
    path = T.distinct_path(F.array(F.concat(F.lit("Chapter "), "chapter"), "chapter_title", "part_heading", "order_label", "heading"))
    content = F.array_join(F.flatten(F.transform("_rows", lambda r: r["said"])), "\n\n")
    return out.select("url", "seq", "order_number", "order_label", "chapter", "chapter_title", "part_heading", "heading", path.alias("path"), content.alias("content"), F.concat(F.lit("so-"), F.lower("order_number")).alias("source_anchor"))


def parse_rulings(pages: DataFrame, form: str = CHAPTER) -> DataFrame:
    """Rulings of chapter pages: (url, seq, ruling_number, chapter, chapter_title, section_heading, primary_heading, secondary_heading,
    heading, path, content, citations). h4 begins a section, h5 a primary heading, a heading-like paragraph a secondary one; each
    resets what is below it. Rulings without text are dropped."""
    lines = elements(pages)
    good, _ = chapters(lines, form)
    text, tag = F.col("text"), F.col("tag")
    rows = lines.filter(tag.isin("h4", "h5", "p", "ul", "ol"))
    start = (tag == "p") & T.ruling_start(text)
    plain = (tag == "p") & ~start & T.plain_heading(text)
    marked = _grouped(rows.withColumn("starts", start).withColumn("ends", tag.isin("h4", "h5") | plain))
    marked = marked.withColumn("section_heading", _last(F.when(tag == "h4", text), [])).withColumn("_s", F.sum((tag == "h4").cast("int")).over(W.partitionBy("url").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    marked = marked.withColumn("_h5", (tag == "h5") & T.plain_heading(text)).withColumn("primary_heading", _last(F.when(F.col("_h5"), text), ["_s"]))
    marked = marked.withColumn("_p", F.sum(F.col("_h5").cast("int")).over(W.partitionBy("url", "_s").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))).withColumn("secondary_heading", _last(F.when(plain, text), ["_s", "_p"]))
    number, rest = T.ruling_parts(text)
    said = F.when(F.col("starts"), F.array_compact(F.array(rest))).when(tag.isin("ul", "ol"), F.transform("items", lambda i: F.concat(F.lit("• "), i))).otherwise(F.array(text))
    row = F.struct("pos", "starts", F.when(F.col("ends"), F.array().cast("array<string>")).otherwise(said).alias("said"))
    heads = [F.min_by(c, "pos").alias(c) for c in ("section_heading", "primary_heading", "secondary_heading")]
    units = marked.withColumn("_number", number).groupBy("url", "unit").agg(F.min_by("_number", "pos").alias("ruling_number"), *heads, F.array_sort(F.collect_list(row)).alias("_rows"), F.min("pos").alias("seq")).filter("_rows[0].starts")
    return _rulings(units.withColumn("_lines", F.flatten(F.transform("_rows", lambda r: r["said"]))).join(good, "url"), F.coalesce("secondary_heading", "primary_heading", "section_heading"), ["section_heading", "primary_heading", "secondary_heading"])


def _rulings(units: DataFrame, heading: Column, levels: list[str]) -> DataFrame:
    body, cited = T.trailing_citations(F.col("_lines"))
    path = T.distinct_path(F.array(F.concat(F.lit("Chapter "), "chapter"), "chapter_title", *levels))
    out = units.filter("size(_lines) > 0").withColumn("heading", heading)
    return out.select("url", "seq", "ruling_number", "chapter", "chapter_title", *[c for c in levels if c != "heading"], "heading", path.alias("path"), F.array_join(body, "\n").alias("content"), cited.alias("citations"))


# Where the rulings of an extracted text begin and end, and the forms of its lines.
FIRST_RULING, LOOK_BACK, CHAPTER_ONE, INDEX = r"\b1/1\b", 2500, "CHAPTER 1", "\nINDEX"
CHAPTER_LINE = r"^CHAPTER\s+([0-9]+)(.*)$"
NO_HEADING = r"^[0-9]+SOs|^[0-9]+/|^[0-9]{4},\s*Vol\.|^Report of |^Question of privilege |^\(?[0-9]+\)"
TEXT_HEADING = r"^[A-Z][A-Za-z’'()\[\]\-,:;& ]+$"


def _capitals(x: Column) -> Column:
    return (F.length(x) >= 3) & x.rlike("[A-Z]") & (x == F.upper(x))


def parse_text_rulings(files: DataFrame) -> DataFrame:
    """Rulings of extracted texts (url, content): (url, seq, ruling_number, chapter, chapter_title, heading, path, content, citations).
    The text is cut from the last `CHAPTER 1` shortly before ruling 1/1 to the index. A chapter line is met before page noise (a
    deviation: as noise it would never be met); a line of capitals under it is the chapter's title; headings count between rulings,
    so up to the first line of a ruling's text. Files without a ruling 1/1 give no rows."""
    x = F.col("_text")
    first = F.regexp_instr(x, F.lit(FIRST_RULING))
    t = files.select("url", T.pdf_normal(F.col("content")).alias("_text")).withColumn("_first", first).filter("_first > 0")
    before = F.substr(x, F.greatest(F.col("_first") - LOOK_BACK, F.lit(1)), F.least(F.col("_first") - 1, F.lit(LOOK_BACK)))
    t = t.withColumn("_back", F.length(before) - F.length(F.substring_index(before, CHAPTER_ONE, -1))).withColumn("_before", before)
    start = F.when(F.col("_before").contains(CHAPTER_ONE), F.col("_first") - F.length("_before") + F.col("_back") - len(CHAPTER_ONE)).otherwise(F.col("_first"))
    t = t.withColumn("_start", start.cast("int")).withColumn("_end", F.expr(f"locate('{INDEX.encode('unicode_escape').decode()}', _text, _first)"))
    cut = F.substr(x, F.col("_start"), F.when(F.col("_end") > 0, F.col("_end") - F.col("_start")).otherwise(F.length(x)))
    lines = t.select("url", F.posexplode(F.split(cut, "\n")).alias("pos", "_l")).select("url", "pos", T.clean(F.col("_l")).alias("line"))
    line = F.col("line")
    order = W.partitionBy("url").orderBy("pos")
    chapter = line.rlike(CHAPTER_LINE)
    lines = lines.withColumn("_up", F.lag(chapter).over(order)).filter(chapter | ~T.page_noise(line))
    starts = T.ruling_start(line)
    title = ~chapter & F.coalesce(F.col("_up"), F.lit(False)) & ~starts & _capitals(line)
    lines = lines.withColumn("starts", starts).withColumn("_chapter", F.when(chapter, F.regexp_extract(line, CHAPTER_LINE, 1))).withColumn("_is_title", title)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    bound = starts | F.col("_chapter").isNotNull()
    lines = lines.withColumn("unit", F.sum(bound.cast("int")).over(upto)).withColumn("_ruling", F.coalesce(F.last(F.when(bound, starts), ignorenulls=True).over(upto), F.lit(False))).withColumn("_c", F.sum(F.col("_chapter").isNotNull().cast("int")).over(upto))
    # A ruling ends before the next one or the next chapter. Headings stand outside rulings, or after a number without text yet.
    first_said = F.when(starts & T.ruling_parts(line)[1].isNotNull(), True)
    body = ~starts & ~F.col("_chapter").isNotNull() & ~F.col("_is_title")
    like = body & ~line.rlike(NO_HEADING) & (_capitals(line) | line.rlike(TEXT_HEADING))
    lines = lines.withColumn("_has", F.coalesce(F.max(first_said).over(W.partitionBy("url", "unit").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)), F.lit(False))).withColumn("_plain", body & ~like)
    lines = lines.withColumn("_text_before", F.coalesce(F.max("_plain").over(W.partitionBy("url", "unit").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(False)))
    heading = like & (~F.col("_ruling") | ~(F.col("_has") | F.col("_text_before")))
    lines = lines.withColumn("_is_heading", heading)
    lines = lines.withColumn("chapter", F.last("_chapter", ignorenulls=True).over(upto)).withColumn("chapter_title", F.last(F.when(F.col("_is_title"), line), ignorenulls=True).over(W.partitionBy("url", "_c").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    lines = lines.withColumn("heading", F.last(F.when(F.col("_is_heading"), line), ignorenulls=True).over(W.partitionBy("url", "_c").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    number, rest = T.ruling_parts(line)
    said = F.when(F.col("starts"), F.array_compact(F.array(rest))).when(F.col("_chapter").isNotNull() | F.col("_is_title") | F.col("_is_heading"), F.array().cast("array<string>")).otherwise(F.array("line"))
    row = F.struct("pos", said.alias("said"))
    units = lines.filter("_ruling").withColumn("_number", number).groupBy("url", "unit").agg(F.min_by("_number", "pos").alias("ruling_number"), F.min_by("chapter", "pos").alias("chapter"), F.min_by("chapter_title", "pos").alias("chapter_title"), F.min_by(F.struct("heading"), "pos")["heading"].alias("heading"), F.array_sort(F.collect_list(row)).alias("_rows"), F.min("pos").alias("seq"))
    return _rulings(units.withColumn("_lines", F.flatten(F.transform("_rows", lambda r: r["said"]))), F.col("heading"), ["heading"])


#: Where an index page's links are looked for, the first place that has any.
LINK_PLACES = ('#main-content .main[role="main"] a[href]', '.main[role="main"] a[href]', "main a[href]", "a[href]")
#: One part of a selector: #id, .class, [attribute] or [attribute="value"].
CONDITION = re.compile(r"""#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*["']?([^"'\]]*)["']?\s*)?\]""")
#: Elements without an end tag.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


def selector(text: str) -> list[tuple[str, list[tuple]]]:
    """A descendant selector as (tag or "", conditions) of each step. Brackets may hold blanks."""
    steps = re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", text)
    return [(re.match(r"[\w-]*", x)[0].lower(), CONDITION.findall(x)) for x in steps]


def _fits(step, element) -> bool:
    tag, conditions = step
    name, attributes = element
    known = {k: v or "" for k, v in attributes}
    return tag in ("", name) and all(
        known.get("id") == i if i else c in known.get("class", "").split() if c else a.lower() in known and (v == "" or known[a.lower()] == v)
        for i, c, a, v in conditions
    )


def selects(steps, chain) -> bool:
    """Whether the last element of `chain` (an element and all that it stands in, the outermost first) fits the selector."""
    if not _fits(steps[-1], chain[-1]):
        return False
    at = 0
    for element in chain[:-1]:
        at += at < len(steps) - 1 and _fits(steps[at], element)
    return at == len(steps) - 1


class _Links(HTMLParser):
    """The elements of a page that fit any of some selectors, with their attributes and which they fit; end tags may be missing."""

    def __init__(self, selectors):
        super().__init__(convert_charrefs=True)
        self.selectors, self.open, self.found = selectors, [], []

    def handle_starttag(self, tag, attrs):
        chain = [*self.open, (tag, attrs)]
        fit = [selects(s, chain) for s in self.selectors]
        if any(fit):
            self.found.append((dict(attrs), fit))
        if tag not in VOID:
            self.open = chain

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        last = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if last is not None:
            self.open = self.open[:last]


def page_links(html: str, base: str, selectors) -> list[tuple[str, list[bool]]]:
    """(address, which selectors it fits) of the links of a page, in order, resolved against `base`; what is no address is left out."""
    reader, out = _Links(selectors), []
    reader.feed(html)
    reader.close()
    for attributes, fit in reader.found:
        href = " ".join((attributes.get("href") or "").split())
        try:
            url = urljoin(base, href) if href else ""
        except ValueError:
            url = ""
        if url:
            out.append((url, fit))
    return out


def chapter_urls(pages: DataFrame, base: str, wanted: str, selectors: tuple[str, ...] = LINK_PLACES) -> DataFrame:
    """(page_id, place, url, chapter): links of index pages (page_id, html) whose address fits `wanted`, from the first selector that has
    any; each once, in the order of their chapter's number (group 1 of `wanted`), those without one last."""
    steps = [selector(x) for x in selectors]

    @F.pandas_udf("array<struct<url:string,fit:array<boolean>>>")
    def links(html: pd.Series) -> pd.Series:
        return html.map(lambda x: [{"url": u, "fit": f} for u, f in page_links(x or "", base, steps)])

    each = pages.select("page_id", F.posexplode(links("html")).alias("_at", "_l")).select("page_id", "_at", "_l.url", F.posexplode("_l.fit").alias("_s", "_fit")).filter(F.col("_fit") & F.col("url").rlike(wanted))
    first = each.groupBy("page_id", "_s", "url").agg(F.min("_at").alias("_at"))
    best = first.groupBy("page_id").agg(F.min("_s").alias("_s"))
    chapter = F.expr("try_cast(regexp_extract(url, '" + wanted.replace("\\", "\\\\").replace("'", "\\'") + "', 1) as long)") if "(" in wanted else F.lit(None).cast("long")
    found = first.join(best, ["page_id", "_s"]).withColumn("chapter", chapter)
    place = F.row_number().over(W.partitionBy("page_id").orderBy(F.col("chapter").asc_nulls_last(), "_at"))
    return found.select("page_id", place.cast("long").alias("place"), "url", "chapter")


MANIFEST = "sources array<struct<slug:string,title:string,corpus:string,sourceType:string,sourcePath:string,sourceUrl:string,edition:string,language:string,publishedDate:string,metadata:map<string,string>>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a source of a manifest, as the documents table has them; a file of another form fails."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return documents_of(raw.select(F.explode("sources").alias("s")).select("s.*"))


def documents_of(sources: DataFrame) -> DataFrame:
    return sources.select(
        F.sha2("slug", 256).alias("id"), "slug", "title", "corpus", F.col("sourceType").alias("source_type"), F.col("sourceUrl").alias("source_url"), "edition",
        F.expr("try_cast(publishedDate as date)").alias("published_date"), F.coalesce("language", F.lit("en")).alias("language"), F.to_json("metadata").alias("metadata"),
    )


def static_urls(spark: SparkSession, urls: list[str]) -> DataFrame:
    """A given list of chapter addresses, in order; the index page is not read."""
    return spark.createDataFrame(list(enumerate(urls, 1)), "chapter long, url string")
