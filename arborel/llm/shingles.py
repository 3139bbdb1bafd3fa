"""Distinct word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np

ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_powers = {ODD: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, its square and so on, n of them, modulo 2 ** 64."""
    have = _powers[base]
    while len(have) < n:
        with np.errstate(over="ignore"):
            have = np.concatenate((have, have * np.uint64(pow(base, len(have), 1 << 64))))
        _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31)) ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def stretches(blank: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """First and last place of stretches of about most bytes that begin and end with a blank and cover all. What is
    worked out for each byte is so held for a stretch only, however long a text is."""
    cuts = [0]
    while len(blank) - cuts[-1] > 2 * most:
        at = cuts[-1] + most
        while not blank[at : at + 4096].any():
            at += 4096
        cuts.append(at + int(blank[at : at + 4096].argmax()))
    return list(zip(cuts, [*cuts[1:], len(blank) - 1], strict=True))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, hash) of each word: a run of bytes other than space, tab, line feed, vertical tab, form feed
    and carriage return, with A-Z lower-cased. All of a stretch are found at once by differences of one rolling sum."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    blank = _SPACE[raw]
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1] if texts else np.zeros(0, int)
    of, hashes = [], []
    for a, b in stretches(blank):
        part, inside = raw[a : b + 1], ~blank[a : b + 1]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            rolled = np.cumsum(_BYTE[part] * powers(ODD, len(part)), dtype=np.uint64)
            # a word is never at the very beginning, so start - 1 exists
            h = (rolled[end - 1] - rolled[start - 1]) * powers(INVERSE, len(part))[start]
        of.append(np.searchsorted(first, start + a, side="right") - 1)
        hashes.append(mixed(h))
    return np.concatenate(of), np.concatenate(hashes)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of width words; of all its words as one, if it has fewer."""
    of, h = word_hashes(texts)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    with np.errstate(over="ignore"):
        n = max(0, len(h) - width + 1)
        run = np.zeros(n, np.uint64)
        for j in range(width):
            run = mixed(run * np.uint64(3) + h[j : j + n], width)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                s = np.sort(run[a : b - width + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                x = np.zeros(1, np.uint64)
                for w in h[a:b]:
                    x = mixed(x * np.uint64(3) + w, b - a)
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
    return out
