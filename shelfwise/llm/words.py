"""64-bit hashes of the words and word shingles of a batch of texts, in numpy.

A word is a run of bytes other than space and U+0009..U+000D in the UTF-8 text
with A-Z lower-cased; equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1 << 12, np.uint64)
_POWERS[1:] = np.uint64(_BASE)
_POWERS = np.multiply.accumulate(_POWERS)
#: Bytes of text hashed at a time (one text at least).
BLOCK_BYTES = 1 << 22
#: Bytes of texts given to ``word_hashes`` together by ``blocks``, whose work memory is some 40 times as much.
TEXT_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: each output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 texts with A-Z lower-cased), at most about TEXT_BYTES each, one text at least; null is empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append((text or "").encode().lower())
        size += len(held[-1])
        if size >= TEXT_BYTES:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def cut(raw: bytes, space: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(byte offset, piece) of ``raw``, cut after a separator at about every ``size`` bytes; a longer word stays whole."""
    at, tried = 0, 0
    while len(raw) - at - tried > size:
        breaks = np.flatnonzero(space[np.frombuffer(raw, np.uint8, size, at + tried)])
        if len(breaks):
            end = at + tried + int(breaks[-1]) + 1
            yield at, raw[at:end]
            at, tried = end, 0
        else:
            tried += size
    yield at, raw[at:]


def word_hashes(raw: list[bytes], space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end, byte start of each word, byte end), bytes counted within its text.

    ``space``: which bytes part words (U+000A must)."""
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    apart = space[joined]
    before = np.concatenate([[True], apart[:-1]])
    starts = np.flatnonzero(~apart & before)
    ends = np.flatnonzero(apart & ~before)
    first = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), first, starts, ends
    inside = np.zeros(len(joined), np.int64)
    inside[starts] = starts
    inside = np.arange(len(joined)) - np.maximum.accumulate(inside)
    value = (joined.astype(np.uint64) + np.uint64(1)) * _POWERS[inside & (len(_POWERS) - 1)]
    value[apart] = 0
    h = np.add.reduceat(value, starts)
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    base = np.repeat(at[:-1], np.diff(first))
    return h, first, starts - base, ends - base


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 entries of each text cross into the next one and are not to be used."""
    out = mix(h)
    for _ in range(k - 1):
        ahead = np.concatenate([out[1:], out[:1]]) if len(out) else out
        out = mix(h * np.uint64(0xA0761D6478BD642F) + ahead * np.uint64(3))
    return out


def whole(h: np.ndarray) -> np.ndarray:
    """One hash for a word sequence shorter than a shingle; none for no words. It equals no shingle's hash but by chance."""
    if not len(h):
        return np.zeros(0, np.uint64)
    x = np.full(1, 0xE7037ED1A0B428DB + len(h), np.uint64)
    for w in h:
        x = mix(x * np.uint64(0x8EBC6AF09C88C6E3) + w)
    return x


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text, its distinct shingle hashes in ascending order (the whole sequence as one, if shorter than k words)."""
    for _, raw in blocks(texts):
        h, first, _, _ = word_hashes(raw)
        s = shingles(h, k)
        for a, b in zip(first[:-1], first[1:]):
            yield np.unique(s[a : b - k + 1]) if b - a >= k else whole(h[a:b])
