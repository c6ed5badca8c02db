"""Small numpy helpers over text: words as byte ranges, 64-bit word hashes and rolling hashes of word windows."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers of the polynomial hashes, and their inverses modulo 2^64.
BYTE_MUL, WORD_MUL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Those of a second hash, where two together tell strings apart.
BYTE_MUL2, WORD_MUL2 = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), U(base), np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_cache: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    size = 1 << max(16, (n - 1).bit_length() if n > 1 else 0)
    if (base, size) not in _cache:
        _cache[base, size] = _powers(base, size)
    return _cache[base, size][:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def word_ranges(data: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs without white space."""
    edge = np.diff(np.concatenate(([True], spaces[data], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each range, by prefix sums of a polynomial."""
    n = len(values)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + U(1)) * powers(base, n))))
        own = (sums[ends] - sums[starts]) * powers(inverse(base), n + 1)[starts]
        return mixed(own ^ mixed((ends - starts).astype(np.uint64)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(data, starts, ends, BYTE_MUL)


def window_hashes(words: np.ndarray, size: int, base: int = WORD_MUL) -> np.ndarray:
    """The hash of each window of `size` values."""
    at = np.arange(len(words) - size + 1)
    return range_hashes(words, at, at + size, base)


def lowest_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the position of its lowest one, the leftmost of equals."""
    n = len(x) - width + 1
    best, at, have = x, np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        a, b = best[: len(best) - step], best[step:]
        take = b < a
        best, at, have = np.where(take, b, a), np.where(take, at[step:], at[: len(at) - step]), have + step
    return at[:n]


def covered(n: int, starts: np.ndarray, size) -> np.ndarray:
    """Which of n places lie in [s, s + size) of any start."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + size, n), -1)
    return np.cumsum(marks[:-1]) > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of True."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8) if flags.dtype == bool else flags, [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def as_bytes(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
