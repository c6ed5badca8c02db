"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name -> (module, name of its SQL, or None where SQL cannot express it).
QUERIES = {
    "op1_chat_format": ("chat", "OP1_SQL"),
    "op2_substring_dedup": ("substring_dedup", "OP2_SQL"),
    "op3_mixing": ("mixing", None),
    "op4_toxicity": ("toxicity", None),
    "op5_simhash": ("simhash", None),
    "op6_warc": ("warc", "OP6_SQL"),
    "op7_quality": ("quality", None),
    "op8_exact_dedup": ("exact_dedup", "OP8_SQL"),
    "op9_decontamination": ("decontamination", "OP9_SQL"),
    "op10_suffix_array_dedup": ("suffix_dedup", None),
    "op11_repair": ("repair", "OP11_SQL"),
    "op12_sharding": ("sharding", "OP12_SQL"),
    "op13_hard_negatives": ("hard_negatives", "OP13_SQL"),
}


def _module(name: str):
    return import_module(f"{__package__}.{QUERIES[name][0]}")


def queries() -> dict:
    return {name: getattr(_module(name), name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(_module(name), sql) for name, (_, sql) in QUERIES.items() if sql}
