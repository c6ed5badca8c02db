"""Sections cut to semantic blocks (Catalyst) and packed to chunks (a helper for each section's text)."""

from __future__ import annotations

import re
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TARGET, MOST = 1200, 1800


def block_texts(content: Column) -> Column:
    """The blocks of a text in order: a blank line or a unit start begins a block; its lines are joined by spaces."""
    lines = F.transform(F.split(content, "\n"), T.clean)
    # A clean line has no newline, so one before a line that begins a block makes an empty line there.
    marked = F.array_join(F.transform(lines, lambda x: F.when((x == "") | T.clean_unit_start(x), F.concat(F.lit("\n"), x)).otherwise(x)), "\n")
    return F.filter(F.transform(F.split(marked, "\n{2,}"), lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(" ")))), lambda x: x != "")


def blocks(sections: DataFrame) -> DataFrame:
    """(section_id, block, text) of the blocks of each section."""
    return sections.select("section_id", F.posexplode(block_texts(F.col("content"))).alias("block", "text")).withColumn("block", F.col("block").cast("long"))


#: Fixed value: white space before a clause, a sub-clause or a bullet.
CLAUSE = re.compile(r"\s(?=\([0-9]+[A-Za-z]?\)|\([A-Za-z]\)|\([ivxlcdmIVXLCDM]+\)|•)")
#: A cut must leave at least this share of the room.
LEAST_SHARE = 0.55


def cut_point(text: str, most: int) -> int:
    """Where an oversized block is cut: before the last clause in the room, after its last sentence, semicolon or colon, or at its
    last space, the first of these that lies far enough; else hard."""
    clause = max(takewhile(lambda at: at <= most, (m.start() for m in CLAUSE.finditer(text))), default=-1)
    mark = max(text.rfind(x, 0, most + len(x)) for x in (". ", "; ", ": ")) + 1
    space = text.rfind(" ", 0, most + 1)
    return next((at for at in (clause, mark, space) if at >= int(most * LEAST_SHARE)), most)


def pack(parts: list[str], target: int = TARGET, most: int = MOST) -> list[str]:
    """Greedy packing of blocks in order; a join counts two characters, the stored text has one."""
    pieces = []
    for part in parts:
        while len(part) > most:
            at = cut_point(part, most)
            pieces.append(part[:at].strip())
            part = part[at:].strip()
        if part:
            pieces.append(part)
    out, have = [], ""
    size = 0
    for piece in pieces:
        if have and size + 2 + len(piece) > target:
            out.append(have)
            have, size = "", 0
        have, size = (f"{have} {piece}", size + 2 + len(piece)) if have else (piece, len(piece))
    return out + [have] if have else out


def chunk_sections(sections: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """(section_id, chunk_index, content, token_count_est) of every section."""
    gathered = sections.select("section_id", block_texts(F.col("content")).alias("parts")).filter("size(parts) > 0")

    @F.pandas_udf("array<string>")
    def packed(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: pack(list(p), target, most))

    out = gathered.select("section_id", F.posexplode(packed("parts")).alias("chunk_index", "content"))
    return out.select("section_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content", T.token_estimate(F.col("content")).alias("token_count_est"))
