"""An answer as HTML, and all that was done for a question as one text. Column expressions over nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .present import signal_list
from .text import escape_html

#: Before every class name; a parameter of `answer_html`.
PREFIX = "rm-"
# Lead labels of a line, and how long a bullet is at most that is a heading.
LEAD_LABELS = ("Bottom line", "What this means", "Why this matters", "In practice", "Key point", "Takeaway", "Next step")
HEADING_MOST = 56
REFERENCE = r"[0-9]+/[0-9A-Z]+"


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, _trim), lambda p: p != "")


def _pill(ref: Column, prefix: str) -> Column:
    return F.concat(F.lit(f'<span class="{prefix}aiAuthorityPill">'), ref, F.lit("</span>"))


def pills(x: Column, prefix: str = PREFIX) -> Column:
    """Bold references, and those in brackets, as pills; brackets without a reference stay."""
    x = F.regexp_replace(x, rf"\*\*({REFERENCE})\*\*", f'<span class="{prefix}aiAuthorityPill">$1</span>')

    def piece(p: Column) -> Column:
        inner = F.regexp_extract(p, r"(?s)^\[(.+)\]$", 1)
        refs = F.filter(_filled(F.split(inner, ",")), lambda r: r.rlike(rf"^{REFERENCE}\z"))
        return F.when(p.startswith("[") & (inner != "") & (F.size(refs) > 0), F.array_join(F.transform(refs, lambda r: _pill(r, prefix)), " ")).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(r"\[[^\]]+\]|[^\[]+|\["), F.lit(0)), piece), "")


def lead_label(x: Column, prefix: str = PREFIX) -> Column:
    """A line's lead label marked, with its colon where it has one."""
    names = "|".join(LEAD_LABELS)
    label = f'<span class="{prefix}aiInlineLabel">$1</span>'
    colon = rf"(?i)^({names})(?U:\s*):(?U:\s*)"
    return F.when(x.rlike(colon), F.regexp_replace(x, colon, f'{label}<span class="{prefix}aiInlineLabelColon">:</span> ')).otherwise(F.regexp_replace(x, rf"(?i)^({names})(?=(?U:\s)|—|–|-)", label))


def _without_colon(x: Column) -> Column:
    return _trim(F.regexp_replace(x, r"(?U)\s*:\s*$", ""))


def answer_html(text: Column, prefix: str = PREFIX) -> Column:
    """Paragraphs as blocks between rules. One with bullets is cut into groups: a short bullet is the heading of those after it."""
    inline = lambda x: lead_label(pills(x, prefix), prefix)
    group = lambda inner: F.concat(F.lit(f'<div class="{prefix}aiSectionGroup">'), inner, F.lit("</div>"))
    nothing = F.array().cast("array<struct<heading:string,items:array<string>>>")

    def put(groups: Column, item: Column) -> Column:
        plain = _without_colon(_trim(F.regexp_replace(item, "<[^>]+>", "")))
        is_heading = (plain != "") & (F.length(plain) <= HEADING_MOST)
        last = F.try_element_at(groups, F.lit(-1))
        new = lambda heading, items: F.struct(heading.cast("string").alias("heading"), items.cast("array<string>").alias("items"))
        grown = F.concat(F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(0))), F.array(new(last["heading"], F.concat(F.coalesce(last["items"], F.array().cast("array<string>")), F.array(item)))))
        return F.when(is_heading, F.concat(groups, F.array(new(_without_colon(item), F.array())))).otherwise(grown)

    def bullets(p: Column) -> Column:
        items = F.transform(_filled(F.split(p, r"\n+")), lambda x: inline(_trim(F.regexp_replace(x, "^- ", ""))))
        heading = lambda g: F.coalesce(F.concat(F.lit(f'<div class="{prefix}aiSectionHeading">'), F.nullif(g["heading"], F.lit("")), F.lit("</div>")), F.lit(""))
        item = lambda x: F.concat(F.lit(f'<li class="{prefix}aiListItem">'), x, F.lit("</li>"))
        listed = lambda g: F.when(F.size(g["items"]) > 0, F.concat(F.lit(f'<ul class="{prefix}aiList">'), F.array_join(F.transform(g["items"], item), ""), F.lit("</ul>"))).otherwise("")
        return F.transform(F.filter(F.aggregate(items, nothing, put), lambda g: (heading(g) != "") | (F.size(g["items"]) > 0)), lambda g: group(F.concat(heading(g), listed(g))))

    plain = lambda p: F.array(group(F.concat(F.lit(f'<p class="{prefix}aiParagraph">'), inline(p), F.lit("</p>"))))
    blocks = F.transform(_filled(F.split(escape_html(text), r"\n{2,}")), lambda p: F.when(p.rlike("(?m)^- "), bullets(p)).otherwise(plain(p)))
    return F.array_join(F.flatten(blocks), f'<hr class="{prefix}aiSectionRule" />')


def _or(x: Column, other: str) -> Column:
    return F.coalesce(x.cast("string"), F.lit(other))


def _fixed(x: Column) -> Column:
    """Two digits, halves away from zero; null stays."""
    return F.when(x.isNotNull(), F.format_string("%.2f", x.cast("double")))


def _joined(items: Column, line, between: str = "\n", none: str = "None") -> Column:
    """`line(item, number)` of each item, or `none` where there are none."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(F.transform(items, lambda x, i: line(x, (i + 1).cast("string"))), between)).otherwise(none)


def numbered_list(items: Column) -> Column:
    return _joined(items, lambda x, n: F.concat(n, F.lit(". "), x))


def _rows(*parts: tuple[str, Column] | Column) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(p[0]), p[1]) if isinstance(p, tuple) else p for p in parts])


def _signals(x: Column) -> Column:
    from .present import SIGNAL_NAMES

    return F.coalesce(F.nullif(F.concat_ws(", ", *[F.when(x[name], F.lit(label)) for name, label in SIGNAL_NAMES]), F.lit("")), F.lit("none"))


def _path(x: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(x, " > "), F.lit("")), F.lit("None"))


def _retrieval(r: Column, n: Column) -> Column:
    top = lambda x, k: _rows(
        F.concat(F.lit("    "), k, F.lit(". "), x["citation_label"]), ("       corpus: ", x["corpus"]), ("       title: ", x["title"]), ("       heading: ", _or(x["heading"], "None")), ("       sectionKey: ", x["section_key"]),
        ("       rank: ", _fixed(x["rank"])), ("       sectionRank: ", _fixed(x["section_rank"])), ("       pathRank: ", _fixed(x["path_rank"])), ("       bodyRank: ", _fixed(x["body_rank"])),
        ("       chunkRank: ", F.coalesce(_fixed(x["chunk_rank"]), F.lit("None"))), ("       clusterSupportCount: ", x["cluster_support"].cast("string")), ("       matchSignals: ", _signals(x)),
    )
    d = r["discovery"]
    found = _rows(
        ("   Discovery status: ", d["status"]), ("   Discovery concept: ", d["concept"]), ("   Discovery heading: ", _or(d["heading"], "None")), ("   Discovery evidence count: ", d["evidence"].cast("string")), ("   Discovery slot: ", _or(d["slot_key"], "None")),
        ("   Discovery bridge source query: ", _or(d["source_query"], "None")), ("   Discovery bridge source authority: ", _or(d["source_label"], "None")), ("   Discovery validation: ", d["validation"]),
    )
    return _rows(
        F.concat(n, F.lit(". Query: "), r["query"]), ("   Corpus: ", _or(r["corpus"], "Auto")), ("   Provenance: ", _or(r["provenance"], "unknown")), F.when(d.isNotNull(), found).otherwise("   Discovery status: not evaluated"),
        ("   Result count: ", r["result_count"].cast("string")), F.lit("   Top results:"), _joined(r["top"], top, none="    None"),
    )


def _selected(x: Column, n: Column) -> Column:
    zero = lambda c: _fixed(F.coalesce(x[c], F.lit(0)))
    return _rows(
        F.concat(n, F.lit(". "), x["citation_label"]), ("   query: ", x["query"]), ("   corpus: ", x["corpus"]), ("   heading: ", _or(x["heading"], "None")), ("   baseRank: ", _fixed(x["base_rank"])), ("   routeBoost: ", _fixed(x["route_boost"])),
        ("   slotBoost: ", zero("slot_boost")), ("   preferredTextBoost: ", zero("preferred_text_boost")), ("   bridgeBoost: ", zero("bridge_boost")), ("   discoveryBoost: ", zero("discovery_boost")), ("   authorityFunction: ", _or(x["authority_function"], "None")),
        ("   matchedSlots: ", F.coalesce(F.nullif(F.array_join(x["matched_slots"], ", "), F.lit("")), F.lit("None"))), ("   adjustedRank: ", _fixed(x["adjusted_rank"])), ("   path: ", _path(x["path"])),
    )


def _authority(x: Column, n: Column) -> Column:
    return _rows(F.concat(n, F.lit(". "), x["citation_label"]), ("   corpus: ", x["corpus"]), ("   heading: ", _or(x["heading"], "None")), ("   sectionKey: ", x["section_key"]), ("   rank: ", _fixed(x["rank"])), ("   path: ", _path(x["path"])), ("   sourceHref: ", _or(x["source_href"], "None")))


#: Title and column of the lists of slots.
SLOT_LISTS = (("Blueprint slots:", "blueprint_slots"), ("Required slots:", "required_slots"), ("Optional slots:", "optional_slots"), ("Satisfied slots:", "satisfied_slots"), ("Missing required slots:", "missing_required_slots"))
#: The nested columns that `debug_text` reads.
DEBUG = """question string, requested_corpus string, effective_corpus string, stage string, started_at string, latency_ms long, error string,
plan struct<intent:string,preferred_corpus:string,notes:string,search_queries:array<string>,salient_terms:array<string>>, inferred_concepts array<string>, expanded_queries array<string>,
blueprint_satisfied boolean, blueprint_slots array<string>, required_slots array<string>, optional_slots array<string>, satisfied_slots array<string>, missing_required_slots array<string>,
slot_matches array<struct<slot_key:string,citation_label:string,heading:string>>,
retrievals array<struct<query:string,corpus:string,provenance:string,discovery:struct<status:string,concept:string,heading:string,evidence:long,slot_key:string,source_query:string,source_label:string,validation:string>,result_count:long,
top:array<struct<citation_label:string,corpus:string,title:string,heading:string,section_key:string,rank:double,section_rank:double,path_rank:double,body_rank:double,chunk_rank:double,cluster_support:long,
exact_key:boolean,exact_citation:boolean,exact_heading:boolean,heading_match:boolean,body_match:boolean,path_match:boolean>>>>,
selection array<struct<citation_label:string,query:string,corpus:string,heading:string,base_rank:double,route_boost:double,slot_boost:double,preferred_text_boost:double,bridge_boost:double,discovery_boost:double,authority_function:string,matched_slots:array<string>,adjusted_rank:double,path:array<string>>>,
authorities array<struct<citation_label:string,corpus:string,heading:string,section_key:string,rank:double,path:array<string>,source_href:string>>, answer string"""


def debug_text(title: str = "DEBUG SNAPSHOT") -> Column:
    """The report of a question from the columns of DEBUG, section by section in their order."""
    c = F.col
    head = lambda name: F.lit(f"{name}\n{'-' * len(name)}")
    listed = lambda name, items: _rows(F.lit(name), numbered_list(items))
    match = lambda m, n: F.concat(n, F.lit(". "), m["slot_key"], F.lit(" -> "), m["citation_label"], F.lit(" ("), _or(m["heading"], "None"), F.lit(")"))
    satisfied = F.when(c("blueprint_satisfied").isNull(), "Unknown").when(c("blueprint_satisfied"), "Yes").otherwise("No")
    parts = [
        _rows(
            F.lit(f"{title}\n{'=' * len(title)}\n"), ("Question: ", _or(F.nullif("question", F.lit("")), "None")), ("Requested corpus: ", _or(c("requested_corpus"), "Auto")), ("Effective corpus: ", _or(c("effective_corpus"), "Auto")),
            ("Stage: ", _or(c("stage"), "None")), ("Started at: ", _or(c("started_at"), "None")), ("Latency ms: ", _or(c("latency_ms"), "Unknown")), ("Error: ", _or(c("error"), "None")),
        ),
        _rows(head("PLAN"), ("Intent: ", _or(c("plan.intent"), "None")), ("Preferred corpus: ", _or(c("plan.preferred_corpus"), "None")), ("Notes: ", _or(c("plan.notes"), "None")), listed("Planner search queries:", c("plan.search_queries"))),
        listed("Salient user terms:", c("plan.salient_terms")), listed("Inferred concepts:", c("inferred_concepts")), listed("Expanded queries:", c("expanded_queries")),
        _rows(head("BLUEPRINT COVERAGE"), ("Satisfied: ", satisfied), listed(SLOT_LISTS[0][0], c(SLOT_LISTS[0][1]))), *[listed(name, c(column)) for name, column in SLOT_LISTS[1:]],
        _rows(F.lit("Selected slot matches:"), _joined(c("slot_matches"), match)),
        _rows(head("RETRIEVALS"), _joined(c("retrievals"), _retrieval, "\n\n")), _rows(head("FINAL AUTHORITY SELECTION"), _joined(c("selection"), _selected, "\n\n")), _rows(head("AUTHORITIES"), _joined(c("authorities"), _authority, "\n\n")),
        _rows(head("ANSWER"), _or(F.nullif("answer", F.lit("")), "None"), F.lit("")),
    ]
    return F.concat_ws("\n\n", *parts)


__all__ = ["answer_html", "debug_text", "lead_label", "numbered_list", "pills", "signal_list"]
