"""Minimisers: windows of a sequence grouped by the smallest gram they contain.

Every window of ``window`` units picks its smallest ``gram``-unit gram (the leftmost of equal ones). Consecutive windows
that pick the same place form one run, and equal windows pick the same gram at the same distance from their start, so
two equal windows always lie in runs of the same gram. Grams are compared by fingerprints, which are built by doubling:
the identifier of a longer string is made of the identifiers of two shorter ones, the second at a later offset.
"""

from __future__ import annotations

import numpy as np

#: Low bits of a packed comparison value that hold the place; the others hold the top of the fingerprint.
_PLACE_BITS = 24
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_IDS = mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)


def joined(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Identifiers of strings from those of a first and a second part."""
    x = a * (_MULTIPLIER + np.uint64(2 * salt))
    x += b
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def gram_ids(units: np.ndarray, gram: int) -> np.ndarray:
    """Identifiers of all ``gram``-unit strings of ``units``, by doubling."""
    ids, n = units, 1
    while n < gram:
        step = min(n, gram - n)
        if len(ids) <= step:
            return np.zeros(0, np.uint64)
        ids = joined(ids[:-step], ids[step:], n + step)
        n += step
    return ids


def runs(ids: np.ndarray, starts: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows over concatenated sequences that begin at ``starts`` (last entry: the end).

    ``ids`` are the gram identifiers of the concatenation. Returns, per run: first window, last window (both as places
    in the concatenation), place of the gram, and the number of the sequence.
    """
    none = np.zeros(0, np.int64)
    n_windows = np.maximum(np.diff(starts) - window + 1, 0)
    if not n_windows.any():
        return none, none, none, none
    width = window - gram + 1
    low = (ids >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(ids), dtype=np.uint64)
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    owner = np.repeat(np.arange(len(n_windows)), n_windows)
    first = np.cumsum(n_windows) - n_windows
    at = starts[:-1][owner] + (np.arange(len(owner)) - first[owner])
    place = (low[at] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return at[begin], at[end], place[begin], owner[begin]


def ids_of_words(words: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


class WordIds(dict):
    """64-bit identifiers of words, remembered for the frequent ones; emptied when it gets large."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value
