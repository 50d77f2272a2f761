"""Vectorised words and word shingles over Arrow batches of texts.

A *byte table* maps each byte to the byte it stands for, 0 for separators.  Words
are runs of bytes that are not separators, cut at text borders.  A word's hash is the scrambled
sum of random 64-bit values, one for each place in the word and (mapped) byte there, taken from one running sum
over the buffer, so that its cost does not depend on the number of words.  Places and bytes have values of their
own, so no family of words collides by construction (as some do under a polynomial modulo 2**64).
"""

from __future__ import annotations

import numpy as np

from marketlens.llm.common import PASS_BYTES, mix64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: dict[int, np.ndarray] = {}
#: Places of a word whose values are tabled; those of later places are made as needed.
_PLACES = 64
_VALUES = mix64(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _place_values(part: np.ndarray, inside: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Random value of every byte by its place in its word."""
    at = np.arange(len(part))
    place = at - np.maximum.accumulate(np.where(first, at, 0))
    values = _VALUES[np.minimum(place, _PLACES - 1) << 8 | part]
    far = np.flatnonzero(inside & (place >= _PLACES))
    if len(far):
        values[far] = mix64(mix64(place[far].astype(np.uint64)) + _CODE[part[far]])
    return values


def _powers(base: np.uint64, n: int) -> np.ndarray:
    key = int(base)
    if key not in _POWERS or len(_POWERS[key]) < n:
        steps = np.full(max(n, PASS_BYTES + 1024), base, dtype=np.uint64)
        steps[0] = 1
        kept = np.multiply.accumulate(steps)
        if n > PASS_BYTES + 1024:  # a very long text: not kept
            return kept
        _POWERS[key] = kept
    return _POWERS[key][:n]


def white_space_table() -> np.ndarray:
    """Words are runs without ASCII white space; A-Z counts as a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[0] = 65  # no separator: what A stood for is free
    table[[32, 9, 10, 11, 12, 13]] = 0
    return table


def letter_table(also: dict[str, str] | None = None) -> np.ndarray:
    """Words are runs of ASCII letters and non-ASCII bytes; A-Z counts as a-z, and ``also`` maps more bytes to letters."""
    table = np.zeros(256, dtype=np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    for a, b in (also or {}).items():
        table[ord(a)] = ord(b)
    return table


def _cuts(mapped: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Places where the buffer can be cut without cutting a word, at most about ``PASS_BYTES`` apart if words allow."""
    cuts, n = [0], len(mapped)
    while cuts[-1] + PASS_BYTES < n:
        goal = cuts[-1] + PASS_BYTES
        border = int(offsets[np.searchsorted(offsets, goal, side="right") - 1])
        if border <= cuts[-1]:  # inside one long text: back to its last separator, else on to the next one
            gaps = np.flatnonzero(mapped[cuts[-1]: goal] == 0)
            if len(gaps):
                border = cuts[-1] + int(gaps[-1]) + 1
            else:
                stop = int(offsets[np.searchsorted(offsets, goal, side="left")])
                gaps = np.flatnonzero(mapped[goal: stop] == 0)
                border = goal + int(gaps[0]) if len(gaps) else stop
        cuts.append(border)
    return cuts + [n]


def word_hashes(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hash and byte length of every word in order, and for each text the index of its first word (one more at the end).

    For each number in ``stems`` follows the hash of the words' first so many bytes (the whole word if shorter).
    """
    hashes, lengths, starts, begun = [], [], [], [[] for _ in stems]
    mapped = table[buf]
    cuts = _cuts(mapped, offsets)
    with np.errstate(over="ignore"):
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = mapped[a:b]
            inside = part != 0
            border = np.zeros(b - a + 1, dtype=bool)
            inner = offsets[np.searchsorted(offsets, a): np.searchsorted(offsets, b, side="right")]
            border[inner - a] = True
            border[0] = border[-1] = True
            first = inside.copy()
            first[1:] &= ~inside[:-1] | border[1:-1]
            last = inside
            last[:-1] &= first[1:] | (part[1:] == 0)
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            total = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(_place_values(part, inside, first), out=total[1:])
            hashes.append(mix64(total[e] - total[s]))
            for kept, n in zip(begun, stems, strict=True):
                kept.append(mix64(total[np.minimum(e, s + n)] - total[s]))
            lengths.append(e - s)
            starts.append(s + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), *[np.zeros(0, np.uint64) for _ in stems]
    first = np.searchsorted(np.concatenate(starts), offsets)
    return np.concatenate(hashes), np.concatenate(lengths), first, *map(np.concatenate, begun)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each text and the index of each text's first.

    A text of fewer words (one at least) has one shingle, its whole sequence.
    """
    n_words = np.diff(first)
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    which = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], n)  # first word of each shingle
    short = np.repeat(n_words < k, n)
    with np.errstate(over="ignore"):
        made = np.zeros(begin[-1], dtype=np.uint64)
        for j in range(k):
            at = which + j
            word = hashes[np.minimum(at, max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(0, np.uint64)
            step = mix64(made + word * np.uint64(2 * j + 3) + np.uint64(j + 1))
            if j:
                over = short & (at >= np.repeat(first[1:], n))
                step = np.where(over, made, step)
            made = step
    return made, begin


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending; empty where there is no word."""
    hashes, _, first = word_hashes(buf, offsets, white_space_table())
    made, begin = shingle_hashes(hashes, first, k)
    return [np.unique(made[a:b]) for a, b in zip(begin, begin[1:], strict=False)]
