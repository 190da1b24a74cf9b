"""Words and their 64-bit hashes, computed for many texts at once with numpy.

A word is a maximal run of Unicode word characters (letters, digits, underscore),
lower-cased one code point at a time, so offsets are those of the text as given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_LAST = 0x32400  # no word characters and no cased letters are assigned beyond
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _unicode() -> tuple[np.ndarray, np.ndarray]:
    if "lower" not in _tables:
        chars = [chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(_LAST)]
        lower = np.arange(0x110000, dtype=np.uint32)
        lower[:_LAST] = [ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars]
        lower[0xD800:0xE000] = np.arange(0xD800, 0xE000)
        word = np.zeros(0x110000, dtype=bool)
        word[[m.start() for m in re.finditer(r"\w", "".join(chars))]] = True
        _tables["lower"], _tables["word"] = lower, word
    return _tables["lower"], _tables["word"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("pow", ())) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
            for name, base in (("pow", _MULT), ("inv", inverse)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                _tables[name] = np.multiply.accumulate(p)
    return _tables["pow"], _tables["inv"]


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, ptr): text i has words ptr[i] to ptr[i + 1]; offsets are within each text."""
    lower, word = _unicode()
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    base = np.concatenate(([0], np.cumsum(lens + 1)))
    cp = codepoints("\n".join(texts) + "\n") if texts else np.zeros(0, np.uint32)
    edge = np.flatnonzero(np.diff(word[cp].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(cp) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((lower[cp].astype(np.uint64) + np.uint64(1)) * power[: len(cp)])))
        hashes = mix((total[ends] - total[starts]) * inverse[starts])
    ptr = np.searchsorted(starts, base)
    shift = np.repeat(base[:-1], np.diff(ptr))
    return hashes, starts - shift, ends - shift, ptr


def groups(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together, so that the arrays stay small."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def ngrams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive elements."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(count, np.uint64(salt), dtype=np.uint64)
        for k in range(n):
            total = (total * _MULT) + hashes[k : k + count]
    return mix(total)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-gram hashes; a text of fewer than n words has one shingle, all its words."""
    if 0 < len(hashes) < n:
        return ngrams(hashes, len(hashes))
    return np.unique(ngrams(hashes, n))
