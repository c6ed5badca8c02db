"""Chat formatting (native): schema fingerprints choose declarative mappings that turn any known layout into canonical turns.

A mapping's fingerprint is the hash of its sorted nested field paths. A layout is hashed once for each mapping, over those of its
own field paths that the mapping names: it fits the mappings whose fingerprint it gives, so columns that a mapping doesn't name never
change anything. Of several that fit, the one with the most paths is taken, then the first in the order of MAPPINGS. Typed tables are
fingerprinted from their schema (`canonical_turns`), JSON lines row by row, over all elements of their arrays (`canonical_json_turns`). Canonical turns are rows (conv_id, turn, role, text). `format_turns` renders one string for each
conversation with a turn's start, separator and end marked, and the loss mask as code-point spans over the assistant texts.

Control strings inside roles and texts are escaped: after the first character (< or [) of a control string, which may be
followed by any number of ~, one more ~ is put in; reading takes one out. So no text can hold a control string, and every text
comes back as it was.

Defined cases: null text and role are empty; turns are ordered by turn, then role, then text (nulls first), so ties and
repeated rows have a fixed order and each counts; a null conv_id is one conversation; a conversation without turns gives an
empty string; an empty table gives no rows; unknown layouts raise in typed tables and give mapping null in JSON lines.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

# The template's marks, and other models' control strings that are escaped too. None holds < or [ after its start.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (START, SEP, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<SYS>", "</SYS>", "[INST]", "[/INST]")

#: Declarative mappings. `paths`: the layout's field paths. `turns`: (role, text path) in order, left out where the text is
#: missing; or `each`: the array of messages with its role and text fields; or `row`: one row is one turn.
MAPPINGS: dict[str, dict] = {
    "turn_rows": {"paths": ("role", "text", "turn"), "row": ("role", "text", "turn")},
    "messages": {"paths": ("messages", "messages[].content", "messages[].role"), "each": ("messages", "role", "content")},
    "messages_empty": {"paths": ("messages",), "each": ("messages", "role", "content")},
    "conversations": {"paths": ("conversations", "conversations[].from", "conversations[].value"), "each": ("conversations", "from", "value")},
    "prompt_response": {"paths": ("prompt", "response"), "turns": (("user", "prompt"), ("assistant", "response"))},
    "prompt_completion": {"paths": ("completion", "prompt"), "turns": (("user", "prompt"), ("assistant", "completion"))},
    "instruction": {"paths": ("instruction", "output"), "turns": (("user", "instruction"), ("assistant", "output"))},
    "instruction_input": {"paths": ("input", "instruction", "output"), "turns": (("user", "instruction"), ("user", "input"), ("assistant", "output"))},
    "question_answer": {"paths": ("answer", "question"), "turns": (("user", "question"), ("assistant", "answer"))},
    "system_prompt_response": {"paths": ("prompt", "response", "system"), "turns": (("system", "system"), ("user", "prompt"), ("assistant", "response"))},
}
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


#: (mapping, its paths in order, its fingerprint), the most paths first.
BY_SIZE = tuple((name, tuple(sorted(set(m["paths"]))), fingerprint(m["paths"])) for name, m in sorted(MAPPINGS.items(), key=lambda x: -len(set(x[1]["paths"]))))


def mapping_of(paths) -> str | None:
    """The mapping of a layout with these field paths, None if none fits."""
    have = set(paths)
    return next((name for name, own, print_ in BY_SIZE if fingerprint(have & set(own)) == print_), None)


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """All nested field paths of a schema; [] stands for an array's elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in [prefix + f.name, *field_paths(f.dataType, f"{prefix}{f.name}.")]]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix.removesuffix(".") + "[].")
    return []


def _role(role: Column) -> Column:
    out = role
    for other, own in ROLES.items():
        out = F.when(role == other, F.lit(own)).otherwise(out)
    return out


def _message(role: str, text: str):
    return lambda t: F.struct(_role(t[role]).alias("role"), t[text].alias("text"))


def _from_mapping(df: DataFrame, name: str, conv: Column) -> DataFrame:
    m = MAPPINGS[name]
    if "row" in m:
        role, text, turn = m["row"]
        return df.select(conv.cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"), F.lit(True).alias("is_turn"))
    if "each" in m:
        array, role, text = m["each"]
        each = df.select(conv.cast("long").alias("conv_id"), F.posexplode_outer(array).alias("turn", "_m"))
        return each.select("conv_id", F.col("turn").cast("long").alias("turn"), _role(F.col("_m")[role]).alias("role"), F.col("_m")[text].alias("text"), F.col("turn").isNotNull().alias("is_turn"))
    turns = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), F.col(p).cast("string").alias("text")) for r, p in m["turns"]]), lambda t: t["text"].isNotNull())
    each = df.select(conv.cast("long").alias("conv_id"), F.posexplode_outer(turns).alias("turn", "_m"))
    return each.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("_m.role").alias("role"), F.col("_m.text").alias("text"), F.col("turn").isNotNull().alias("is_turn"))


def canonical_turns(df: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Canonical turns of a typed table; its schema's fingerprint chooses the mapping."""
    paths = field_paths(df.schema)
    name = mapping_of(paths)
    if name is None:
        raise ValueError(f"no mapping fits the layout {paths}")
    return _from_mapping(df, name, F.col(conv_col))


def canonical_json_turns(df: DataFrame, json_col: str = "record", conv_col: str = "conv_id") -> DataFrame:
    """Canonical turns of JSON lines; each row's fingerprint chooses its mapping. Adds `mapping`, null for unknown layouts
    and for text that is no JSON object (such rows have no turns)."""
    v = F.try_parse_json(F.col(json_col))
    rows = df.select(F.col(conv_col).cast("long").alias("conv_id"), v.alias("_v"))

    def found(path: str) -> Column:
        array, _, field = path.partition("[].")
        if not field:
            return F.try_variant_get("_v", f"$.{path}", "variant").isNotNull()
        return F.exists(F.try_variant_get("_v", f"$.{array}", "array<variant>"), lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull())

    mapping = F.lit(None).cast("string")
    for name, paths, print_ in reversed(BY_SIZE):
        present = F.array_compact(F.array(*[F.when(found(p), F.lit(p)) for p in paths]))
        own = F.substring(F.sha2(F.array_join(present, "\n").cast("binary"), 256), 1, 16)
        mapping = F.when(own == print_, F.lit(name)).otherwise(mapping)
    rows = rows.withColumn("mapping", mapping)
    message = "array<struct<role:string,text:string>>"
    turns = F.lit(None).cast(message)
    for name, m in MAPPINGS.items():
        if "each" in m:
            array, role, text = m["each"]
            typed = F.try_variant_get("_v", f"$.{array}", f"array<struct<`{role}`:string,`{text}`:string>>")
            own = F.transform(typed, _message(role, text))
        elif "turns" in m:
            own = F.filter(F.array(*[F.struct(F.lit(r).alias("role"), F.try_variant_get("_v", f"$.{p}", "string").alias("text")) for r, p in m["turns"]]), lambda t: t["text"].isNotNull())
        else:
            own = F.array(F.struct(F.try_variant_get("_v", "$.role", "string").alias("role"), F.try_variant_get("_v", "$.text", "string").alias("text")))
        turns = F.when(F.col("mapping") == name, own).otherwise(turns)
    each = rows.select("conv_id", "mapping", F.posexplode_outer(turns).alias("turn", "_m"))
    return each.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("_m.role").alias("role"), F.col("_m.text").alias("text"), F.col("turn").isNotNull().alias("is_turn"), "mapping")


def _quoted(x: str) -> str:
    return "".join("\\" + c if c in "\\^$.|?*+()[]{}" else c for c in x)


def _heads() -> list[tuple[str, str]]:
    """(first character, alternatives of what follows) of the control strings."""
    return [(c, "|".join(_quoted(x[1:]) for x in CONTROLS if x[0] == c)) for c in sorted({x[0] for x in CONTROLS})]


def escape(text: Column) -> Column:
    for c, rest in _heads():
        text = F.regexp_replace(text, f"{_quoted(c)}(~*)({rest})", f"{c}~$1$2")
    return text


def unescape(text: Column) -> Column:
    for c, rest in _heads():
        text = F.regexp_replace(text, f"{_quoted(c)}~(~*)({rest})", f"{c}$1$2")
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row a conversation; a span is (start, length) in code points of `formatted`."""
    t = turns.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    t = t.withColumn("_role", escape(F.col("role"))).withColumn("_text", escape(F.col("text")))
    t = t.withColumn("_piece", F.when(F.col("is_turn"), F.concat(F.lit(START), "_role", F.lit(SEP), "_text", F.lit(END))).otherwise(""))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    ends = F.sum(F.length("_piece")).over(order.rowsBetween(W.unboundedPreceding, 0))
    t = t.withColumn("_n", F.row_number().over(order)).withColumn("_start", ends - len(END) - F.length("_text"))
    t = t.select("conv_id", "_n", F.struct(F.col("_n").alias("n"), F.col("_piece").alias("piece"), (F.col("is_turn") & (F.col("role") == "assistant")).alias("loss"), F.col("_start").alias("start"), F.length("_text").alias("length")).alias("_t"))
    whole = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    spans = F.transform(F.filter("_ts", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.transform("_ts", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Reads (conv_id, turns, loss_texts, formatted) back from the formatted strings and their loss masks alone."""
    form = f"(?s){_quoted(START)}(.*?){_quoted(SEP)}(.*?){_quoted(END)}"
    roles, texts = (F.regexp_extract_all("formatted", F.lit(form), F.lit(i)) for i in (1, 2))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))
    lost = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"])))
    return formatted.select("conv_id", turns.alias("turns"), lost.alias("loss_texts"), "formatted")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.array(*[F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant")]).alias("messages"))
    turns = canonical_turns(table(spark, sf_dir, "conversations")).unionByName(canonical_turns(own))
    back = read_formatted(format_turns(turns))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _grown(x: str) -> str:
    for c, rest in _heads():
        x = f"regexp_replace({x}, '{_quoted(c)}(~*)({rest})', '{c}~\\1\\2', 'g')"
    return x


OP1_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum({len(START + SEP + END)} + length({_grown("role")}) + length({_grown("text")})) as bigint) as formatted_chars
from t group by conv_id
"""
