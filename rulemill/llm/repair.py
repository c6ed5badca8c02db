"""Conversation structure repair: error-correcting Earley parsing of the turns' roles under a weighted grammar.

Faults and tokens (one letter a turn) are made by Spark; a conversation's token string goes to a small chart parser, whose result
(cost, audit, and where each repaired turn comes from) is joined to the texts in the JVM again, so no text reaches Python.

The grammar of roles is left-linear: `Empty`, `System` (s), `Asked` (..u) and `Answered` (..ua) stand for what was read so far,
the goal is Empty or Answered. Error productions: a turn may be deleted after any of them, may be read as a turn of another role,
and a turn may be inserted that is not there. As all rules are left-linear, every chart item begins in column 0, a column holds one item a
dotted rule, and only the last column is kept: time and memory follow the number of turns. An item keeps the least (cost, audit);
audits are compared by their rank in the column and the letters since, never as whole strings.

Defined cases: null role and text are one space; a null conv_id is one conversation; rows lie by turn (nulls first), then role, then
text, so ties and repeated rows have a fixed order and each counts; a role other than system, user or assistant is told by its first
letter; rows with is_turn false (the column may be missing) only name their conversation, which is returned with zeros, an empty audit
and no turns if it has no others; an empty table gives no rows; other columns are ignored. A conversation is one row of the result and so
is put together in one task.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: left side -> right sides; small letters are turns by their role's initial.
RULES = (("System", ("Empty", "s")), ("Asked", ("Empty", "u")), ("Asked", ("System", "u")), ("Asked", ("Answered", "u")), ("Answered", ("Asked", "a")))
START, GOALS = "Empty", ("Empty", "Answered")
#: Roles that error productions may give or insert.
MENDED = {"u": "user", "a": "assistant"}
#: The token of a turn that must be deleted; others are a role's initial, in capitals where the text is cut off.
BAD = "x"


def _closure(kernel: dict) -> dict:
    """Completed items of a column, with those that inserted turns complete. An item's value is (cost, rank, letters, steps): the rank of
    its audit up to the column's own turn, the letters after, and its steps as a linked list. Inserting costs, so taking the least item
    first settles each once."""
    done: dict = {}
    agenda = dict(kernel)
    while agenda:
        left = min(agenda, key=lambda x: agenda[x][:3])
        cost, rank, letters, steps = done[left] = agenda.pop(left)
        for lhs, (before, role) in RULES:
            if before == left and lhs not in done and role in MENDED:
                offer(agenda, lhs, (cost + INSERT, rank, letters + "I", (steps, "I", role)))
    return done


def offer(items: dict, name: str, value: tuple) -> None:
    if name not in items or value[:3] < items[name][:3]:
        items[name] = value


def _scan(column: dict, token: str) -> dict:
    """The next column's kernel: every item read on over a turn that is kept, given another role, or deleted."""
    found: dict = {}
    initial, more = token.lower(), TRUNCATED if token.isupper() else 0
    for left, (cost, rank, letters, steps) in column.items():
        offer(found, left, (cost + DELETE, rank, letters + "D", (steps, "D", "")))
        for lhs, (before, role) in RULES if token != BAD else ():
            if before == left and role == initial:
                offer(found, lhs, (cost + KEEP + more, rank, letters + "K", (steps, "K", role)))
            if before == left and role in MENDED:
                offer(found, lhs, (cost + REROLE + more, rank, letters + "R", (steps, "R", role)))
    ranks = {x: i for i, x in enumerate(sorted({v[1:3] for v in found.values()}))}
    return {k: (v[0], ranks[v[1:3]], "", v[3]) for k, v in found.items()}


def parse(tokens: str) -> tuple[int, str, list[int], list[str]]:
    """(cost, audit, from, roles) of the cheapest repair, the ASCII-least audit of several: for each repaired turn the number of its
    turn (from 1; 0: inserted) and the role that it is given ("": its own)."""
    kernel: dict = {START: (0, 0, "", None)}
    for token in tokens:
        kernel = _scan(_closure(kernel), token)
    column = _closure(kernel)
    cost, _, _, steps = min((column[g] for g in GOALS if g in column), key=lambda v: v[:3])
    edits = []
    while steps:
        steps, letter, role = steps
        edits.append((letter, role))
    edits.reverse()
    at, source, roles = 0, [], []
    for letter, role in edits:
        at += letter != "I"
        if letter != "D":
            source.append(0 if letter == "I" else at)
            roles.append("" if letter == "K" else MENDED[role])
    return cost, "".join(letter for letter, _ in edits), source, roles


@lru_cache(maxsize=1 << 15)
def parse_short(tokens: str) -> tuple[int, str, list[int], list[str]]:
    """`parse`, remembered: short conversations share few token strings."""
    return parse(tokens)


@F.pandas_udf(T.StructType([T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("source", T.ArrayType(T.IntegerType())), T.StructField("roles", T.ArrayType(T.StringType()))]))
def _parsed(tokens: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_short(t) if len(t) <= 64 else parse(t) for t in tokens], columns=["cost", "audit", "source", "roles"])


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def judged(turns: DataFrame) -> DataFrame:
    """The turns with their first fault (blank, duplicate, truncated or null), dealt out by conversation."""
    real = F.col("is_turn") if "is_turn" in turns.columns else F.lit(True)
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    t = turns.select("conv_id", "turn", role, text, F.coalesce(real, F.lit(True)).alias("is_turn")).repartition("conv_id")
    again = F.row_number().over(W.partitionBy("conv_id", "role", "text", "is_turn").orderBy("turn")) > 1
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(body == "", "blank").when(again, "duplicate").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated")
    return t.withColumn("fault", F.when(F.col("is_turn"), fault))


def repair_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired: array of (role, text)) of every conversation."""
    head = initial(F.col("role"))
    plain = F.when(head.isin("s", "u", "a"), head).otherwise("o")
    token = F.when(F.col("fault").isin("blank", "duplicate"), BAD).when(F.col("fault") == "truncated", F.upper(plain)).otherwise(plain)
    one = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text", token.alias("token"))  # of equal rows the one that is kept comes before BAD
    count = lambda fault: F.count_if(F.col("is_turn") & (F.col("fault") == fault)).alias(fault)
    whole = judged(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("is_turn"), one))).alias("_t"), *[count(x) for x in ("blank", "duplicate", "truncated")])
    known = F.filter("_t", lambda x: x["known"])
    numbers = F.transform(known, lambda x: x["turn"])
    gaps = F.when(F.size(known) > 0, F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers))).otherwise(0)
    heads = F.transform("_t", lambda x: initial(x["role"]))
    pairs = F.zip_with(F.slice(heads, F.lit(1), F.greatest(F.size(heads) - 1, F.lit(0))), F.slice(heads, F.lit(2), F.greatest(F.size(heads) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))
    out = whole.withColumn("_p", _parsed(F.array_join(F.transform("_t", lambda x: x["token"]), "")))
    mended = F.zip_with("_p.source", "_p.roles", lambda at, role: F.struct(
        F.when(role == "", F.try_element_at("_t", at)["role"]).otherwise(role).alias("role"), F.when(at == 0, "").otherwise(F.try_element_at("_t", F.greatest(at, F.lit(1)))["text"]).alias("text")))
    return out.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal"), "_p.cost", "_p.audit", mended.alias("repaired"))


def damaged(turns: DataFrame) -> DataFrame:
    """The turns with faults put in, by crc32 of `conv_id:turn` modulo 20: 0 drops a row (its conversation stays named), 1 empties
    its text, 2 takes the ends of sentences out, 3 repeats it, 4 makes it a user's."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.col("_kind")
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    t = turns.select("conv_id", "turn", "role", "text", (F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20).alias("_kind"))
    t = t.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("is_turn"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return t.drop("_copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair_turns(damaged(table(spark, sf_dir, "conversations")))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))


def _more(x: str, cost: int | str, letter: str) -> str:
    """SQL: the state `x` (six digits of cost, then the audit) after an edit."""
    return f"(lpad(cast(cast({x}[1:6] as integer) + {cost} as varchar), 6, '0') || {x}[7:] || '{letter}')"


def _closed(states: str) -> str:
    """SQL: states e, s, u, a with inserted turns, as e, s, u1, a1."""
    return f"select *, least(u, {_more('e', INSERT, 'I')}, {_more('s', INSERT, 'I')}, {_more('a', INSERT, 'I')}) as u1, least(a, {_more(f'least(u, {_more("e", INSERT, "I")}, {_more("s", INSERT, "I")}, {_more("a", INSERT, "I")})', INSERT, 'I')}) as a1 from {states}"


def _read(x: str, role: str) -> str:
    """SQL: the state `x` after the turn of token k, as a turn of `role`."""
    rerole = f"when k <> '{BAD}' then {_more(x, f'{REROLE} + w', 'R')}" if role in MENDED else ""
    return f"case when lower(k) = '{role}' then {_more(x, f'{KEEP} + w', 'K')} {rerole} end"


OP11_SQL = f"""
with recursive keyed as (select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
dealt as (select conv_id, turn, coalesce(role, ' ') as role0, coalesce(text, ' ') as text0,
  xor(4294967295, list_reduce(flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(k[i]), 0, 0, 0, 0, 0, 0, 0])),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295)) % 20 as kind from keyed),
t as (select conv_id, turn, case when kind = 4 then 'user' else role0 end as role,
  case when kind = 1 then '' when kind = 2 then regexp_replace(text0, '[.!?]', '', 'g') else text0 end as text,
  unnest(case when kind = 3 then [0, 1] else [0] end) as copy from dealt where kind > 0),
f as (select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body,
  row_number() over (partition by conv_id, role, text order by turn nulls first) as seen from t),
g as (select *, case when body = '' then 'blank' when seen > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' end as fault,
  case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'o' end as head,
  lead(role) over (partition by conv_id order by turn nulls first, role, text) as after from f),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
  count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (after is not null and left(role, 1) || left(after, 1) not in ('su', 'ua', 'au')) as illegal,
  string_agg(case when fault in ('blank', 'duplicate') then '{BAD}' when fault = 'truncated' then upper(head) else head end, '' order by turn nulls first, role, text, seen) as tokens,
  list(struct_pack(role := role, text := text) order by turn nulls first, role, text, seen) as turns from g group by conv_id),
steps as (
  select conv_id, tokens, 0 as i, '000000' as e, cast(null as varchar) as s, cast(null as varchar) as u, cast(null as varchar) as a from c
  union all
  select conv_id, tokens, i + 1, {_more('e', DELETE, 'D')}, least({_more('s', DELETE, 'D')}, {_read('e', 's')}),
    least({_more('u1', DELETE, 'D')}, {_read('e', 'u')}, {_read('s', 'u')}, {_read('a1', 'u')}), least({_more('a1', DELETE, 'D')}, {_read('u1', 'a')})
  from (select *, tokens[i + 1] as k, case when tokens[i + 1] between 'A' and 'Z' then {TRUNCATED} else 0 end as w from ({_closed('steps')}) where i < length(tokens))),
ends as (select conv_id, least(e, a1) as best from ({_closed('(select * from steps where i = length(tokens))')})),
r as (select c.*, cast(best[1:6] as bigint) as cost, best[7:] as audit from c join ends on c.conv_id is not distinct from ends.conv_id),
o as (select *, list_transform(range(1, length(audit) + 1), lambda j: struct_pack(edit := audit[j],
    turn := turns[length(replace(audit[1:j], 'I', ''))], place := length(replace(audit[1:j], 'D', '')))) as edits from r),
p as (select *, list_filter(edits, lambda x: x.edit <> 'D') as out from o),
q as (select *, case when out[1].edit = 'K' and left(out[1].turn.role, 1) = 's' then 1 else 0 end as system from p),
z as (select conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(coalesce(array_to_string(list_transform(out, lambda x:
    (case when x.edit = 'K' then x.turn.role when (x.place - system) % 2 = 1 then 'user' else 'assistant' end) || ':' || (case when x.edit = 'I' then '' else x.turn.text end)), chr(10)), '')) as repaired_sha256 from q),
d as (select distinct conv_id from conversations)
select d.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from d left join z on d.conv_id is not distinct from z.conv_id
"""
