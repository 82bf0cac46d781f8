"""Burrows-Wheeler transform and longest common prefixes of a collection, built column by column.

Round j inserts, for every string, the suffix of length j: its first symbol is the
transform's symbol at the place of the suffix of length j - 1, so its place follows
from counting symbols before that place. Both sequences are read and rewritten once
per round, front to back. A collection is a bounded part of the data, so that the
sequences are held as flat arrays of the task that builds them.
"""

from __future__ import annotations

import numpy as np


#: A collection's suffixes fit a place of so many bits, beside a symbol of eight.
PLACE_BITS = 24
PLACE_MASK = np.uint32((1 << PLACE_BITS) - 1)


def _sorted_symbols(bwt: np.ndarray) -> np.ndarray:
    return np.sort(bwt.astype(np.uint32) << np.uint32(PLACE_BITS) | np.arange(len(bwt), dtype=np.uint32))


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bwt, lcp) of the sorted suffixes, the empty ones first, in the order of the strings.

    Symbols are bytes plus one, 0 at the start of a string; UTF-8 has no byte 255.
    lcp[x] is the common prefix of the suffixes at x - 1 and x; it never crosses a string's end.
    """
    m = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes)
    flat = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
    # the symbol before the suffix of length j of string i: flat[ends[i] - j - 1]
    active = np.arange(m)
    bwt = np.zeros(m, np.uint8)
    full = sizes > 0
    bwt[full] = flat[ends[full] - 1]
    lcp = np.zeros(m + 1, np.uint16)  # and a zero behind the last
    place = np.arange(m)
    for j in range(1, int(sizes.max(initial=0)) + 1):
        live = sizes[active] >= j
        active, place = active[live], place[live]
        by = np.argsort(place, kind="stable")
        active, place = active[by], place[by]
        # symbols with their places, ascending: a symbol's rank is its suffix's next place
        pairs = _sorted_symbols(bwt)
        zeros = int(np.searchsorted(pairs, np.uint32(1 << PLACE_BITS)))
        own = bwt[place].astype(np.uint32)
        t = np.searchsorted(pairs, own << np.uint32(PLACE_BITS) | place.astype(np.uint32))
        new_place = m + t - zeros
        # neighbours that begin with the same symbol share one more than the least prefix between the places they come from
        before = pairs[t - 1]
        same_before = (t > 0) & (before >> np.uint32(PLACE_BITS) == own)
        after = pairs[np.minimum(t + 1, len(pairs) - 1)]
        same_after = (t + 1 < len(pairs)) & (after >> np.uint32(PLACE_BITS) == own)
        before, after = (before & PLACE_MASK).astype(np.int64), (after & PLACE_MASK).astype(np.int64)
        prefix, suffix = _least(lcp, before + 1, place + 1, same_before), _least(lcp, place + 1, after + 1, same_after)
        symbols = np.zeros(len(active), np.uint8)
        more = sizes[active] > j
        symbols[more] = flat[ends[active[more]] - j - 1]
        old = np.ones(len(bwt) + len(active), bool)
        old[new_place] = False
        next_bwt, next_lcp = np.empty(len(old), np.uint8), np.zeros(len(old) + 1, np.uint16)
        next_bwt[old], next_bwt[new_place] = bwt, symbols
        next_lcp[:-1][old] = lcp[:-1]
        next_lcp[new_place + 1] = suffix
        next_lcp[new_place] = prefix
        bwt, lcp, place = next_bwt, next_lcp, new_place
    return bwt, lcp[:-1]


def _least(values: np.ndarray, start: np.ndarray, stop: np.ndarray, use: np.ndarray) -> np.ndarray:
    """1 + min(values[start:stop]) where ``use``, else 0."""
    out = np.zeros(len(start), np.uint16)
    if use.any():
        at = np.empty(2 * np.count_nonzero(use), np.int64)
        at[::2], at[1::2] = start[use], stop[use]
        out[use] = np.minimum.reduceat(values, at)[::2] + 1
    return out


def repeated_starts(strings: list[bytes], span: int) -> list[np.ndarray]:
    """For each string, whether the ``span`` bytes from each offset also start at another place of the collection."""
    bwt, lcp = transform(strings)
    m = len(strings)
    hit = lcp >= span
    hit[:-1] |= hit[1:]
    rank = np.empty(len(bwt), np.int64)
    rank[_sorted_symbols(bwt) & PLACE_MASK] = np.arange(len(bwt))
    zeros = int(np.count_nonzero(bwt == 0))
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes)
    flags = np.zeros(int(sizes.sum()), bool)
    active, place = np.arange(m), np.arange(m)
    for j in range(1, int(sizes.max(initial=0)) + 1):
        live = sizes[active] >= j
        active, place = active[live], m + rank[place[live]] - zeros
        flags[ends[active] - j] = hit[place]
    return np.split(flags, ends[:-1])
