"""Words of texts as 64-bit hashes, and hashes of stretches of words."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words a worker remembers; beyond it the memory starts anew.
REMEMBERED, LONGEST = 400_000, 100
BASE = 0x9E3779B97F4A7C15
ALL = (1 << 64) - 1
#: The contracts' white space besides the blank itself.
OTHER_SPACE = "\t\n\x0b\x0c\r"


def words_of(text: str) -> list[str]:
    """Runs of anything but blank and U+0009 to U+000D."""
    for space in OTHER_SPACE:
        if space in text:
            text = text.replace(space, " ")
    return list(filter(None, text.split(" ")))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        found = xxhash.xxh3_64_intdigest(word.encode("utf-8"))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


_KNOWN = _Hashes()


def hashes_of(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that makes all bits depend on all (a public finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive words, built by doubling."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    found, done, power, size = None, 0, hashes, 1
    rest = width
    while rest:
        if rest & 1:
            part = power[done : done + n]
            factor = np.uint64(pow(BASE, size, 1 << 64))
            found = part.copy() if found is None else found * factor + part
            done += size
        rest >>= 1
        if rest:
            factor = np.uint64(pow(BASE, size, 1 << 64))
            power = power[:-size] * factor + power[size:]
            size *= 2
    return mixed(found)


def sliding(x: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` (minimum or maximum) of each ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        x = take(x[:-size], x[size:])
        size *= 2
    return take(x[: len(x) - (width - size)], x[width - size :]) if width > size else x
