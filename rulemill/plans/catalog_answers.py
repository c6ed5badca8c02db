"""Queries over each step of the gate of drafted answers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as AV
from . import catalog_rules
from .catalog_rules import _drafts

LABELS = ("SO 89", "22/5")
GAPS = ("what the  draft left open", " ", "who may ask")


def _stepped(spark, d, make):
    """Digest and length of what a step makes of each draft."""
    out = _drafts(spark, d).select("question_id", make(F.col("draft"), F.col("labels")).alias("t"))
    return out.select("question_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("chars"))


def q_relabel(spark, d):
    return _stepped(spark, d, AV.relabelled)


def q_format_answer(spark, d):
    return _stepped(spark, d, lambda t, _: AV.formatted(t))


def q_empty_sections(spark, d):
    return _stepped(spark, d, lambda t, _: AV.without_empty_sections(t))


def q_rewrite_mentions(spark, d):
    return _stepped(spark, d, AV.rewritten_mentions)


def q_pruned_text(spark, d):
    return _stepped(spark, d, lambda t, labels: AV.pruned(t, labels)[0])


def q_drop_claims(spark, d):
    """The drafts without the claims whose text has a length divisible by four; none in every third draft."""
    ids = lambda t: F.transform(F.filter(AV.claims(t), lambda c: (F.length(c["text"]) % 4 == 0) & (F.col("question_id") % 3 > 0)), lambda c: c["id"])
    return _stepped(spark, d, lambda t, _: AV.without_claims(t, ids(t)))


def q_gaps(spark, d):
    return _stepped(spark, d, lambda t, _: AV.with_gaps(t, F.when(F.col("question_id") % 2 == 0, F.array(*[F.lit(g) for g in GAPS]))))


def q_section_content(spark, d):
    """Which headings have anything under them."""
    r = _drafts(spark, d)
    return r.select("question_id", F.explode(F.array(*[F.struct(F.lit(h).alias("heading"), AV.has_content(F.col("draft"), h).alias("filled")) for h in AV.HEADINGS])).alias("h")).select("question_id", "h.heading", "h.filled")


def q_fallback(spark, d):
    """Answers made of up to six authorities; of none in every fifth."""
    r = _drafts(spark, d)
    one = lambda i: F.struct(
        F.concat(F.lit("SO "), i.cast("string")).alias("citation_label"), F.when(i % 3 > 0, F.when(i % 3 == 1, F.lit("Closure")).otherwise(F.lit(" "))).alias("heading"), F.when(i % 2 == 0, F.array(F.lit("Chapter 1"), F.lit("Rules"))).otherwise(F.array().cast("array<string>")).alias("path"),
        F.lit("governing_rule").alias("authority_class"), F.lit("rule").alias("authority_function"),
    )
    some = F.when(F.col("question_id") % 5 > 0, F.transform(F.sequence(F.lit(1), (F.col("question_id") % 6 + 1).cast("int")), one))
    t = AV.fallback(some, F.concat(F.lit("reason "), (F.col("question_id") % 4).cast("string")))
    return r.select("question_id", t.alias("t")).select("question_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("chars"))


_D = "with " + catalog_rules._DRAFTS
_TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_TIDY = lambda x: _TRIM(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def _formatted(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '(?m)^\*\s+', '- ', 'g'), '(?m)^\*\*\s+', '- ', 'g')"
    x = _TRIM(rf"regexp_replace({x}, '[ \t]+\n', chr(10), 'g')")
    for written, heading in AV.WRITTEN:
        x = f"regexp_replace({x}, '(?im)^{written}$', '{heading}')"
    return x


_HEADS = ", ".join(f"'{h}'" for h in AV.HEADINGS)
_SUBSTANTIVE = ", ".join(f"'{h}'" for h in AV.SUBSTANTIVE)
_OK = r"regexp_matches(c, '^(SO 89|22/5)([( ,;:]|$)')"
_LINES = rf"""fm as (select question_id, {_formatted("draft")} as t from dr),
ln as (select question_id, t, unnest(str_split(t, chr(10))) as l, unnest(range(len(str_split(t, chr(10))))) as i from fm),
hd as (select *, {_TRIM("l")} in ({_HEADS}) as head, {_TRIM("l")} = '' as blank from ln),
sc as (select *, last_value(case when head then {_TRIM("l")} end ignore nulls) over (partition by question_id order by i) as section, sum(head::int) over (partition by question_id order by i) as n,
  list_filter(list_transform(regexp_extract_all(l, '\[([^\]]+)\]', 1), lambda x: {_TRIM("x")}), lambda x: x <> '') as cs from hd)"""
_DIGEST = "select question_id, md5(t) as digest, length(t) as chars from"
_PARTS = rf"list_filter(list_transform(regexp_split_to_array(p[2:length(p) - 1], '[;,]'), lambda x: {_TRIM('x')}), lambda x: x <> '')"
_PLAIN = r"regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '(?i)^standing order\s+', 'SO ')"
_OWN = f"list_transform({_PARTS}, lambda x: '[' || " + "".join(f"case when lower({_PLAIN}) = lower('{label}') or regexp_full_match({_PLAIN}, '(?i){label}(\\([^()]+\\))+') then '{label}' else " for label in LABELS) + "x end end || ']')"
_SAID = r"(?i)(?:\b(?:standing order|so)\s+[0-9]+[a-z]?|\b[0-9]+/[0-9]+\b)"
_FALL = " || chr(10) || ".join(
    [
        f"'{AV.BOTTOM}'", f"case when k > 0 then '{AV.FALL_BOTTOM}' || array_to_string(list_transform(best, lambda a: '[' || a.label || ']'), ' ') || '.' else '{AV.FALL_NONE}' end", "''",
        "'What this means:'", f"case when k > 0 then '{AV.FALL_MEANS}[' || best[1].label || '].' else '{AV.FALL_MEANS_NONE}' end", "''",
        "'Your options:'", f"case when k > 0 then array_to_string(list_transform(best, lambda a: '{AV.FALL_OPTION[0]}' || coalesce(a.heading, 'Relevant authority') || '{AV.FALL_OPTION[1]}' || a.label || '{AV.FALL_OPTION[2]}'), chr(10)) else '{AV.FALL_OPTION_NONE}' end", "''",
        "'Risks or constraints:'", f"'{AV.FALL_RISK}reason ' || (question_id % 4)", "''",
        f"'{AV.BEST}'", f"case when k > 0 then array_to_string(list_transform(best, lambda a: '- [' || a.label || '] ' || coalesce(nullif(trim(a.heading), ''), a.last, 'Relevant authority') || ' (governing_rule; rule)'), chr(10)) else '{AV.FALL_BEST_NONE}' end",
    ]
)

SQL = {
    "q_relabel": rf"""{_D}, x as (select question_id, regexp_extract_all(draft, '\[[^\]]+\]|[^\[]+|\[') as ps from dr),
y as (select question_id, array_to_string(list_transform(ps, lambda p: case when p[1] = '[' and right(p, 1) = ']' and length(p) > 2 and len({_PARTS}) > 0
  then array_to_string(list_filter({_OWN}, lambda o, i: list_position({_OWN}, o) = i), ' ') else p end), '') as t from x) {_DIGEST} y""",
    "q_format_answer": f"{_D}, {_LINES} {_DIGEST} fm",
    "q_empty_sections": f"""{_D}, {_LINES}, f as (select *, max((not blank and not head)::int) over (partition by question_id, n) as filled from sc),
y as (select question_id, {_TIDY("string_agg(l, chr(10) order by i)")} as t from f where n = 0 or n is null or filled = 1 group by question_id) {_DIGEST} y""",
    "q_rewrite_mentions": rf"""{_D}, x as (select question_id, regexp_extract_all(draft, '{_SAID}|(?s:.)') as ps from dr),
y as (select question_id, array_to_string(list_transform(ps, lambda x: case when length(x) > 1 and lower(trim(regexp_replace({_PLAIN}, '\s+', ' ', 'g'))) not in ('so 89', '22/5') then 'the retrieved authority' else x end), '') as t from x) {_DIGEST} y""",
    "q_pruned_text": rf"""{_D}, {_LINES}, k as (select *, blank or head or case when section = '{AV.BEST}' then regexp_matches({_TRIM("l")}, '^-\s*\S') when section in ({_SUBSTANTIVE}) then len(cs) > 0 and len(list_filter(cs, lambda c: not {_OK})) = 0 else true end as keep from sc),
y as (select question_id, {_TIDY("string_agg(case when head then " + _TRIM("l") + r" else regexp_replace(l, '\s+$', '') end, chr(10) order by i)")} as t from k where keep group by question_id) {_DIGEST} y""",
    "q_drop_claims": f"""{_D}, {_LINES}, k as (select *, not head and section in ({_SUBSTANTIVE}) and len(cs) > 0 and length({_TRIM("l")}) % 4 = 0 and question_id % 3 > 0 as gone from sc),
j as (select *, max(coalesce(gone, false)::int) over (partition by question_id) as touched from k),
y as (select question_id, case when max(touched) = 1 then {_TIDY("string_agg(l, chr(10) order by i)")} else max(t) end as t from j where not coalesce(gone, false) group by question_id) {_DIGEST} y""",
    "q_gaps": f"""{_D}, {_LINES}, y as (select question_id, case when question_id % 2 = 0 then {_TRIM("t || chr(10) || chr(10) || 'Evidence gap:' || chr(10) || '- The search did not retrieve authority establishing what the draft left open. That unresolved point should not be treated as proved either way.' || chr(10) || '- The search did not retrieve authority establishing who may ask. That unresolved point should not be treated as proved either way.'")} else t end as t from fm) {_DIGEST} y""",
    "q_section_content": f"""{_D}, {_LINES}, h as (select unnest([{_HEADS}]) as heading)
select d.question_id, h.heading, coalesce(bool_or(s.section = h.heading and not s.blank and not s.head), false) as filled from dr d cross join h left join sc s on s.question_id = d.question_id group by all""",
    "q_fallback": f"""{_D}, a as (select question_id, case when question_id % 5 > 0 then list_transform(range(1, question_id % 6 + 2), lambda i: struct_pack(label := 'SO ' || i, heading := case i % 3 when 1 then 'Closure' when 2 then ' ' end, last := case when i % 2 = 0 then 'Rules' end))[1:4] end as best from dr),
b as (select question_id, best, coalesce(len(best), 0) as k from a), y as (select question_id, {_FALL} as t from b) {_DIGEST} y""",
}


def queries() -> dict:
    return {name: function for name, function in globals().items() if name.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return SQL
