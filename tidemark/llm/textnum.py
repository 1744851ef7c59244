"""Texts as numbers: hashes of words and of byte n-grams of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 18  # bytes of text hashed at once; a longer text is a chunk of its own

_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(found := _powers.get(base, ())) < n:
        found = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if n <= 1 << 20:  # what a rare huge text needs is not kept
            _powers[base] = found
    return found[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the argument reaches every bit of the result."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes of texts each behind a blank, where each text starts, and the end)."""
    i = 0
    while i < len(texts):
        held, size, j = [], 0, i
        while j < len(texts) and (not held or size < CHUNK):
            held.append((texts[j] or "").encode("utf-8", "surrogatepass"))
            size += len(held[-1]) + 1
            j += 1
        starts = np.cumsum([0, *(len(x) + 1 for x in held)])
        yield i, np.frombuffer(b" " + b" ".join(held) + b" ", dtype=np.uint8), starts + 1
        i = j


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each blank-separated word, how many words stand before each text, and in all)."""
    blank = BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    a, b = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), out=sums[1:])
    h = mixed((sums[b] - sums[a]) * powers(BACK, len(raw))[a] ^ (b - a).astype(np.uint64))
    return h, np.searchsorted(a, starts)
