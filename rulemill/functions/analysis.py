"""Text analysis: words with positions, English stems, search trees, and cover-density ranks.

Stems follow Porter's second English stemmer (the Snowball "english" algorithm, as published). They are made once for each distinct
word (`operators.index.dictionary`), never for each word of a text.

A search tree is JSON of nested lists: a string is a lexeme, ["&", ...] and ["|", ...] hold parts, ["!", part] excludes, and
[distance, left, right] asks for `right` so many words after the end of `left`. Ranks follow Clarke, Cormack and Tudhope, "Relevance
ranking for one to three term queries" (2000): each minimal extent that fulfils the tree adds the harmonic mean of its hits' weights,
divided by one more than the words in it that are no hits.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = r"[\p{L}\p{N}]+"
# The stop words of the English configuration.
STOP = tuple("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they
them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now""".split())
#: Weights of the classes: headings and labels, paths, text, and words without a class.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}

VOWELS = "aeiouy"
# The stemmer's irregular words, the beginnings that fix its first region, and its endings with what replaces them.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
KEPT_AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
BEGINNINGS = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = "cdeghkmnrt"
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _region(word: str, start: int) -> int:
    """Where the text after the first consonant that follows a vowel begins, looking from `start`."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable. A y that sounds as a consonant is written Y."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _by_length(endings) -> list[tuple[int, frozenset[str]]]:
    """The endings of each length, long ones first."""
    return [(n, frozenset(e for e in endings if len(e) == n)) for n in sorted({len(e) for e in endings}, reverse=True)]


_PAST, _STEP2, _STEP3, _STEP4 = (_by_length(x) for x in (("eed", "eedly", "ed", "edly", "ing", "ingly"), STEP2, STEP3, STEP4))


def _longest(word: str, endings: list[tuple[int, frozenset[str]]]) -> str:
    for n, own in endings:
        end = word[-n:]
        if end in own:
            return end
    return ""


def _singular(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        return w[:-1]
    return w


def _without_past(w: str, r1: int) -> str:
    """Without -eed, -ed, -ing and their -ly forms."""
    end = _longest(w, _PAST)
    base = w[: len(w) - len(end)]
    if end.startswith("eed"):
        return base + "ee" if len(base) >= r1 else w
    if not end or not any(c in VOWELS for c in base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(DOUBLES):
        return base[:-1]
    return base + "e" if _short_end(base) and r1 >= len(base) else base


def stem(word: str) -> str:
    """The stem of a lower-case word; words with digits have none and stay."""
    if len(word) <= 2 or (not word.isalpha() and any(c.isdigit() for c in word)):
        return word
    if word in IRREGULAR or word in UNCHANGED:
        return IRREGULAR.get(word, word)
    w = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in VOWELS[:5]) else c for i, c in enumerate(word)) if "y" in word else word
    begun = next((len(b) for b in BEGINNINGS if w.startswith(b)), None) if w.startswith(BEGINNINGS) else None
    r1 = _region(w, 0) if begun is None else begun
    r2 = _region(w, r1)
    w = _singular(w)
    if w in KEPT_AFTER_PLURAL:
        return w
    w = _without_past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    end = _longest(w, _STEP2)
    base = w[: len(w) - len(end)]
    if end and len(base) >= r1 and (end != "ogi" or base.endswith("l")) and (end != "li" or base[-1:] in tuple(BEFORE_LI)):
        w = base + STEP2[end]
    end = _longest(w, _STEP3)
    base = w[: len(w) - len(end)]
    if end and len(base) >= (r2 if end == "ative" else r1):
        w = base + STEP3[end]
    end = _longest(w, _STEP4)
    base = w[: len(w) - len(end)]
    if end and len(base) >= r2 and (end != "ion" or base.endswith(("s", "t"))):
        w = base
    base = w[:-1]
    if (w.endswith("e") and (len(base) >= r2 or (len(base) >= r1 and not _short_end(base)))) or (w.endswith("ll") and len(base) >= r2):
        w = base
    return w.replace("Y", "y")


def simple_words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(WORDS), 0)


def stopped(word: Column, stop: tuple[str, ...] = STOP) -> Column:
    return word.isin(*stop)


@F.pandas_udf(T.StringType())
def stems(words: pd.Series) -> pd.Series:
    """For tables of distinct words."""
    return words.map(stem)


def clauses(query: Column) -> Column:
    """What a search asks for: quoted phrases and single words as (text, negated) of which all must hold, in alternatives
    parted by the word `or`."""
    piece = F.regexp_extract_all(query, F.lit(r'-?"[^"]*"|\S+'), 0)
    clause = lambda p: F.struct(F.trim(F.regexp_replace(p, r'^-|"', " ")).alias("text"), p.startswith("-").alias("negated"))
    kind = "array<array<struct<text:string,negated:boolean>>>"
    start = F.array(F.array().cast("array<struct<text:string,negated:boolean>>")).cast(kind)
    add = lambda a, p: F.when(F.lower(p) == "or", F.concat(a, start)).otherwise(F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.array(clause(p))))))
    alternatives = F.transform(F.aggregate(piece, start, add), lambda a: F.filter(a, lambda c: c["text"].rlike(WORDS)))
    return F.filter(alternatives, lambda a: F.size(a) > 0)


Extents = list[tuple[int, int]]


def minimal(extents) -> Extents:
    """Those extents that hold no other, by their place: starts and ends both rise."""
    out: Extents = []
    for start, end in sorted(extents, key=lambda x: (x[1], -x[0])):
        if not out or start > out[-1][0]:
            out.append((start, end))
    return out


def _both(left: Extents, right: Extents) -> Extents:
    """Minimal extents that hold one of each side: for each end, from the last of either side that ends by then."""
    ends_l, ends_r = [e for _, e in left], [e for _, e in right]
    found = []
    for end in sorted({*ends_l, *ends_r}):
        i, j = bisect_right(ends_l, end), bisect_right(ends_r, end)
        if i and j:
            found.append((min(left[i - 1][0], right[j - 1][0]), end))
    return minimal(found)


def extents(tree, places: dict[str, list[int]], least: bool = True) -> tuple[bool, Extents]:
    """(whether the tree holds, its minimal extents) over the sorted places of each lexeme. An exclusion holds where its part is
    nowhere and has no extents of its own; as a side of a distance it excludes only what stands there. Sides of a distance count with all
    their extents (least: False), except those of a conjunction, which are its minimal ones."""
    if isinstance(tree, str):
        own = [(p, p) for p in places.get(tree, ())]
        return bool(own), own
    kind, *parts = tree
    if kind == "!":
        return not extents(parts[0], places)[0], []
    if kind == "|":
        met = [extents(p, places, least) for p in parts]
        own = {x for _, e in met for x in e}
        return any(ok for ok, _ in met), minimal(own) if least else sorted(own)
    if kind == "&":
        found: Extents | None = None
        for ok, own in (extents(p, places) for p in parts):
            if not ok:
                return False, []
            if own:
                found = own if found is None else _both(found, own)
        return True, found or []
    sides = [(x[1], True) if not isinstance(x, str) and x[0] == "!" else (x, False) for x in parts]
    (left, not_left), (right, not_right) = ((extents(x, places, False)[1], no) for x, no in sides)
    if not_left:
        ends = {e for _, e in left}
        own = [x for x in right if x[0] - kind not in ends]
    elif not_right:
        starts = {s for s, _ in right}
        own = [x for x in left if x[1] + kind not in starts]
    else:
        after: dict[int, list[int]] = {}
        for s, e in right:
            after.setdefault(s, []).append(e)
        own = sorted({(s, end) for s, e in left for end in after.get(e + kind, ())})
    return bool(own), minimal(own) if least else own


def cover_density(tree, hits: list[tuple[int, str, float]]) -> float | None:
    """The rank of a text from its hits (place, lexeme, weight), sorted by place; None where the tree doesn't hold."""
    places: dict[str, list[int]] = {}
    weight: dict[int, float] = {}
    for at, lexeme, w in hits:
        places.setdefault(lexeme, []).append(at)
        weight[at] = w
    ok, found = extents(tree, places)
    if not ok:
        return None
    every = sorted(weight)
    sums = [0.0]
    for at in every:
        sums.append(sums[-1] + 1 / weight[at])
    index = {at: i for i, at in enumerate(every)}
    total = 0.0
    for start, end in found:
        first, last = index[start], index[end]
        own = last - first + 1
        total += own / (sums[last + 1] - sums[first]) / (1 + end - start + 1 - own)
    return total


@lru_cache(maxsize=4096)
def _tree(text: str):
    return json.loads(text)


@F.pandas_udf(T.DoubleType())
def cover_densities(trees: pd.Series, places: pd.Series, lexemes: pd.Series, weights: pd.Series) -> pd.Series:
    """cover_density of each row's tree and hits, given as three arrays in the order of places; null where the tree doesn't hold."""
    rows = zip(trees, places, lexemes, weights, strict=True)
    return pd.Series([None if tree is None or at is None else cover_density(_tree(tree), list(zip(at.tolist(), words, w.tolist(), strict=True))) for tree, at, words, w in rows], dtype="float64")
