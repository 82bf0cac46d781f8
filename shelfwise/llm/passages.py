"""Near-duplicate passages by compact windows.

A document is its sequence of word shingles. Under each of ``HASHES`` orders (by
hash alone, so that an edit's shingles come first no more often than others) the Cartesian tree of the sequence gives
compact windows (l, c, r): every subsequence of [l, r] that holds c has its
min-hash at c. Nodes whose window is at least ``span`` shingles long are kept;
they are the minima of the sliding windows of that length, and the tree over
them alone has the same windows.

Windows of one order with the same shingle at c form a group: their intervals
around c, where they overlap by ``span`` or more, are candidate passages. Equal
surroundings are one member of a group; members are joined with the group's
leaders and verified shingle by shingle: a stretch of ``span`` positions counts
when its Jaccard similarity, of shingles that agree (at most ``SHIFT`` apart),
reaches the threshold; a repeat word for word, with no shingle in common beyond it, must
have ``min_words`` words. Every member is compared with each leader until all its stretches
that can agree with anything are a leader's, shingle for shingle; what is left of it then
agrees with the leader wherever it agrees with the member. Shingles that no other
member has nearby agree with nothing and don't count. A member that stays becomes a
leader itself. Large groups are dealt out by parts, whose leaders are joined in a second round.

Of each passage the occurrence in the smallest doc_id stays; passages repeated
inside one document only are left alone.

Defined cases: a null, empty or short text has no passage; repeated rows of one
doc_id are one document; rows with null doc_id take no part and stay as they are;
an empty table gives an empty result; other columns pass through ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import MAP_BITS, bit_map, bound_batches, free_name, in_bit_map, written

K, MIN_WORDS, NUMERATOR, DENOMINATOR = 5, 50, 80, 100
HASHES, SHIFT = 3, 2
SEEDS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03)
#: Members of a group dealt to one task.
PART = 4096
#: A leader is compared with all members of a group of so many, and with its candidates in a larger one.
COMPARED = 12
#: Members of a set whose candidates are found by their own rarest shingles, in so many ranges of stretches.
MANY, RANGES = 1024, 4
#: Rows that have a shingle of such a set near each other from which on it is common.
COMMON = 128
#: Rounds after which these are looked for anew.
INDEXED = 8
#: Members compared side by side, one group at least.
TOGETHER = 8_000
#: Members of a set tried as leaders side by side at most, pairs of these with the set's open members, and matches looked at together.
LEADERS, PAIRS, MATCHES = 512, 8_000_000, 2_000_000

WINDOWS = "key long, hi long, lo long, doc_id long, c long, left int, size int"
AROUND = "key long, hi long, lo long, doc_id long, c long, left int, around binary"
#: Bytes kept of each surrounding shingle's hash: a chance agreement is one in 2 ** 24.
HASH_BYTES = 3


class _Windows:
    """Compact windows of a block of texts."""

    def __init__(self, k: int, span: int) -> None:
        self.k, self.span = k, span

    def __call__(self, texts: list[str | None], bounds: bool = True) -> Iterator[tuple]:
        """(first text of the block, shingle hashes, text offsets, then for each order: key, c, l, r, text).

        l and r are looked for up to ``span`` - 1 places from c; without ``bounds`` they are c.
        """
        import numpy as np

        from shelfwise.llm.words import blocks, shingles, word_hashes

        k, span = self.k, self.span
        for start, raw in blocks(texts):
            h, first, _, _ = word_hashes(raw)
            s = shingles(h, k)
            sizes = np.maximum(np.diff(first) - k + 1, 0)
            sizes[sizes < span] = 0
            off = np.concatenate([[0], np.cumsum(sizes)])
            own = np.repeat(np.arange(len(raw)), sizes)
            s = s[np.arange(off[-1]) - np.repeat(off[:-1] - first[:-1], sizes)]
            found = [self._tree(f, s, off, own, bounds) for f in range(HASHES)] if len(s) else []
            yield start, s, off, found

    def _tree(self, f: int, s, off, own, bounds: bool):
        import numpy as np

        from shelfwise.llm.words import mix

        span = self.span
        rank = mix(s ^ np.uint64(SEEDS[f])) >> np.uint64(1)
        place = np.arange(len(s))
        value = ((rank >> np.uint64(6)) << np.uint64(6) | (place & 63).astype(np.uint64)).view(np.int64)
        low, width = value, 1
        while 2 * width <= span:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        low = np.minimum(low[: len(value) - span + 1], low[span - width : span - width + len(value) - span + 1])
        starts = place[: len(low)]
        low, starts = low[starts + span <= off[own[starts] + 1]], starts[starts + span <= off[own[starts] + 1]]
        keep = np.ones(len(low), bool)
        keep[1:] = low[1:] != low[:-1]
        c = np.unique(starts[keep] + ((low[keep] & 63) - starts[keep] & 63))
        doc, v = own[c], value[c]
        left = right = c
        if bounds:
            # the Cartesian tree: previous and next smaller node, each text by itself
            left = self._smaller(c, v, np.maximum(off[doc], c - span + 1))
            right = -self._smaller(-c[::-1], v[::-1], np.maximum(1 - off[doc + 1], 1 - c - span)[::-1])[::-1]
        key = mix((s[c] ^ np.uint64(SEEDS[f])) + np.uint64(f)).view(np.int64)
        return key, c, left, right, doc

    @staticmethod
    def _smaller(place, value, least):
        """For each place (ascending), the first one behind the nearest earlier place of smaller value, ``least`` if that comes first."""
        import numpy as np

        bound, at, step = least.copy(), np.arange(len(place)), 0
        while len(at):
            step += 1
            at = at[at >= step]
            at = at[place[at - step] >= least[at]]
            smaller = value[at - step] < value[at]
            bound[at[smaller]] = place[at[smaller] - step] + 1
            at = at[~smaller]
        return bound


def _keys(docs: DataFrame, k: int, span: int) -> DataFrame:
    def keys(batches: Iterator) -> Iterator:
        import pyarrow as pa

        windows = _Windows(k, span)
        for batch in batches:
            for _, _, _, found in windows(batch.column(1).to_pylist(), bounds=False):
                for key, *_ in found:
                    yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])

    return docs.mapInArrow(keys, "key long")


def _repeated(docs: DataFrame, bits, k: int, span: int, firsts=None) -> DataFrame:
    """The windows whose signature repeats (and a few more), with a digest of their surroundings.

    With ``firsts``, a map of (digest, document, place), those windows alone (and a few more),
    with their surroundings.
    """

    def windows_of(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        windows, wanted = _Windows(k, span), np.frombuffer(bits.value, np.uint8)
        first = np.frombuffer(firsts.value, np.uint8) if firsts is not None else None
        names = ["key", "hi", "lo", "doc_id", "c", "left", "size" if first is None else "around"]
        one = [bytes([i]) for i in range(span)]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, s, off, found in windows(batch.column(1).to_pylist()):
                raw = s.tobytes()
                short = np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()
                for key, c, left, right, doc in found:
                    hit = np.flatnonzero(in_bit_map(wanted, key))
                    if not len(hit):
                        continue
                    key, c, left, end, doc = key[hit], c[hit], left[hit], right[hit] + 1, doc[hit]
                    before, place, own = c - left, c - off[doc], ids[start + doc]
                    digests = [xxhash.xxh3_128_digest(raw[a:b] + one[x]) for a, b, x in zip((8 * left).tolist(), (8 * end).tolist(), before.tolist())]
                    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    columns = [key, both[:, 0], both[:, 1], own, place, before.astype(np.int32)]
                    if first is None:
                        last = pa.array((end - left).astype(np.int32))
                    else:
                        wanted_here = in_bit_map(first, both[:, 0] ^ own << 17 ^ place << 41)
                        columns, left, end = [x[wanted_here] for x in columns], left[wanted_here], end[wanted_here]
                        last = pa.array([short[a:b] for a, b in zip((HASH_BYTES * left).tolist(), (HASH_BYTES * end).tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in columns), last], names=names)

    return docs.mapInArrow(windows_of, WINDOWS if firsts is None else AROUND)


def _least(span: int, numerator: int, denominator: int) -> int:
    """Shingles that two stretches of ``span`` must have in common."""
    return -(-2 * span * numerator // (numerator + denominator))


class _Alike:
    """Which pairs of rows may have a stretch that agrees, by one byte of each shingle: others don't agree anywhere."""

    def __init__(self, table, span: int, numerator: int, denominator: int) -> None:
        import numpy as np

        self.width, self.least = table.shape[1], _least(span, numerator, denominator)
        # outside, a leader and a row differ
        self.rows = np.full((len(table), -(-self.width // 32) * 32), 255, np.uint8)
        self.rows[:, : self.width] = np.where(table < 0, 255, table & 255)
        self.leaders = np.full((len(table), self.rows.shape[1] + 2 * SHIFT), 254, np.uint8)
        self.leaders[:, SHIFT : SHIFT + self.width] = np.where(table < 0, 254, table & 255)

    def __call__(self, leader, row):
        import numpy as np

        out = np.zeros(len(row), bool)
        for x in range(0, len(row), 2048):
            one, other = self.leaders[leader[x : x + 2048]], self.rows[row[x : x + 2048]]
            width = other.shape[1]
            same = other == one[:, :width]
            for shift in range(1, 2 * SHIFT + 1):
                same |= other == one[:, shift : shift + width]
            bits = np.packbits(same, axis=1).view(np.uint32)
            out[x : x + 2048] = np.bitwise_count(bits).sum(axis=1) >= self.least
        return out


def _agree(leader, other, span: int, numerator: int, denominator: int):
    """For each row: positions of ``other`` inside stretches of ``span`` that are similar enough to ``leader`` (both aligned at c, -1 outside)."""
    import numpy as np

    same = np.zeros(other.shape, bool)
    width = other.shape[1]
    for shift in range(-SHIFT, SHIFT + 1):
        a, b = max(0, shift), width + min(0, shift)
        same[:, a:b] |= (other[:, a:b] == leader[:, a - shift : b - shift]) & (other[:, a:b] >= 0)
    total = np.zeros((len(other), width + 1), np.int32)
    np.cumsum(same, axis=1, out=total[:, 1:])
    m = total[:, span:] - total[:, :-span]
    # Jaccard of two stretches of span shingles with m in common
    good = m * denominator >= (2 * span - m) * numerator
    cover = np.zeros((len(other), width + 1), np.int32)
    cover[:, : good.shape[1]] += good
    cover[:, span : span + good.shape[1]] -= good
    inside = np.cumsum(cover[:, :width], axis=1) > 0
    # trimmed to shingles in common, so that nothing beside the passage is taken
    known = same & inside
    column = np.arange(width)
    first = np.where(known.any(axis=1), known.argmax(axis=1), width)
    last = width - 1 - known[:, ::-1].argmax(axis=1)
    # what is shared word for word, without a break, counts from ``span`` shingles on
    short = (last - first + 1 < span) & (known.sum(axis=1) == last - first + 1)
    return inside & (column >= first[:, None]) & (column <= last[:, None]) & ~short[:, None]


def _value_keys(key, table):
    """A hash of (group, shingle) for each place of ``table``."""
    import numpy as np

    from shelfwise.llm.words import mix

    return mix(key.view(np.uint64)[:, None] ^ ((table.astype(np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


def _shared(group, table):
    """Places of ``table`` whose shingle its group has again at most ``SHIFT`` away."""
    import numpy as np

    width = table.shape[1]
    row, column = np.nonzero(table >= 0)
    own = group[row].astype(np.int64) << 31 | table[row, column].astype(np.int64) << 7 | column
    by = np.argsort(own)
    near = np.diff(own[by]) <= SHIFT
    # places of one shingle follow each other; a step to the next shingle is longer, but at the ends of a table as wide as 128
    near &= np.diff(own[by] >> 7) == 0
    again = np.zeros(len(own), bool)
    again[by[1:][near]] = True
    again[by[:-1][near]] = True
    out = np.zeros(table.shape, bool)
    out[row[again], column[again]] = True
    return out


class _Candidates:
    """The rows of large groups that a leader may agree with, by a few of their shingles.

    A stretch holds c and either the ``span // 2`` places before it or those behind it. It lacks at most ``apart`` of the
    leader's shingles, so of ``apart + 1`` combs of these places (every ``apart + 1``-th) one agrees whole, and with it the comb's
    place farthest from c. A run of one word around c agrees there with little else.
    """

    def __init__(self, table, span: int, numerator: int, denominator: int) -> None:
        import numpy as np

        apart = span - _least(span, numerator, denominator)
        half = span // 2
        self.table = table
        #: combs need a place each; without them every row is a candidate
        self.usable = half > apart
        far = list(range(half - apart, half + 1)) if self.usable else []
        self.columns = np.array([span - 1 - d for d in far] + [span - 1 + d for d in far], np.int64)

    def _keys(self, group, rows, shift: int):
        """(keys of group, comb and the shingle ``shift`` places from the comb's, their rows)."""
        import numpy as np

        column = self.columns + shift
        inside = np.flatnonzero((column >= 0) & (column < self.table.shape[1]))
        values = self.table[rows[:, None], column[inside]].astype(np.int64)
        at, comb = np.nonzero(values >= 0)
        return (group[rows[at]].astype(np.int64) * len(self.columns) + inside[comb]) << 8 * HASH_BYTES | values[at, comb], rows[at]

    def linked(self, group, rows):
        """A number for each of ``rows``, equal for any two of which one may be the other's candidate."""
        import numpy as np

        key, row = (np.concatenate(x) for x in zip(*(self._keys(group, rows, s) for s in range(-SHIFT, SHIFT + 1))))
        by = np.argsort(key)
        key, at = key[by], np.searchsorted(rows, row[by])
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        several = np.repeat(size > 1, size)
        at, size = at[several], size[size > 1]
        first = np.cumsum(size) - size
        label = np.arange(len(rows))
        while len(at):
            least = label.copy()
            np.minimum.at(least, at, np.repeat(np.minimum.reduceat(label[at], first), size))
            least = least[least]
            if (least == label).all():
                break
            label = least
        return label

    def index(self, group, rows) -> None:
        import numpy as np

        key, row = self._keys(group, rows, 0)
        by = np.argsort(key, kind="stable")
        self.key, self.row = key[by], row[by]

    def among(self, group, leaders, start_of, place) -> Iterator:
        """For candidates of many leaders, each leader's ``start_of`` plus the row's ``place``, some more than once, about MATCHES at a time."""
        import numpy as np

        key, row = (np.concatenate(x) for x in zip(*(self._keys(group, leaders, s) for s in range(-SHIFT, SHIFT + 1))))
        by = np.argsort(row, kind="stable")
        key, at = key[by], np.searchsorted(leaders, row[by])
        start, stop = np.searchsorted(self.key, key), np.searchsorted(self.key, key, side="right")
        upto, start_of, place = np.cumsum(stop - start), start_of[at], place[self.row]
        cuts = np.unique(np.searchsorted(upto, np.arange(MATCHES, upto[-1] if len(upto) else 0, MATCHES))).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(at)]):
            yield np.repeat(start_of[a:b], stop[a:b] - start[a:b]) + place[_ranges(start[a:b], stop[a:b])]

    def __call__(self, group, leaders):
        import numpy as np

        wanted = np.unique(np.concatenate([self._keys(group, leaders, s)[0] for s in range(-SHIFT, SHIFT + 1)]))
        return np.unique(self.row[_ranges(np.searchsorted(self.key, wanted), np.searchsorted(self.key, wanted, side="right"))])


class _Rarest:
    """The rows of very large sets to which a leader may add anything, by the rows' rarest shingles.

    A stretch that agrees with a leader lacks at most ``apart`` of its places, so of any ``apart + 1`` of them one agrees. For
    each range of stretches a row is found by as many places that all its stretches of the range hold: those whose
    shingle the fewest rows of the set have near. A place that no other row has near finds nothing and is taken first.

    A row of which one run of places is covered already gains by a leader that has one of its other shingles near, or that
    has all shingles of an open stretch and at its ends: of these the rarest one.

    Where such a place is common, the row is found by all its other shingles too. A leader that has none of these agrees
    with it by common ones alone, just as an earlier leader with the same common shingles does: only the first of
    these looks for rows by common places. A row whose common places have others between them is found by all leaders, since
    what lies between could make an exact repeat, which may be too short, of another leader's agreement.
    """

    def __init__(self, number, table, rows, known, stretch, span: int, numerator: int, denominator: int) -> None:
        import numpy as np

        self.number, self.table, self.known, self.stretch = number, table, known, stretch.copy()
        self.span, self.apart = span, span - _least(span, numerator, denominator)
        self.at = np.zeros(len(table), np.int64)
        self.at[rows] = np.arange(len(rows))
        self.near = np.zeros((len(rows), table.shape[1]), np.int32)
        # places whose shingle a common place of another row may agree with
        self.common = np.zeros(self.near.shape, bool)
        self.seen: set[bytes] = set()
        for own in np.split(rows, np.flatnonzero(np.diff(number[rows])) + 1):
            parts = np.split(own, range(8192, len(own), 8192))
            everything = np.concatenate([self._keys(x)[0] for x in parts])
            everything.sort()
            for x in parts:
                key, row, place = self._keys(x)
                by = np.argsort(key)
                at, place = self.at[x[row[by]]], place[by]
                around = lambda reach, key=key[by]: np.searchsorted(everything, key + reach, side="right") - np.searchsorted(everything, key - reach)
                self.near[at, place] = around(SHIFT)
                self.common[at, place] = around(2 * SHIFT) > COMMON

    def index(self, rows, stretch, done) -> None:
        """``rows`` as they are now: ``stretch`` are the starts of open stretches, ``done`` the places covered."""
        import numpy as np

        keys = [self._chosen(rows[x : x + 8192], stretch, done) for x in range(0, len(rows), 8192)]
        self.indexes = []
        for found in zip(*keys):
            key, row = (np.concatenate(x) for x in zip(*found))
            by = np.argsort(key)
            self.indexes.append((key[by], row[by]))

    def _chosen(self, rows, stretch, done):
        import numpy as np

        near, known, held = self.near[self.at[rows]], self.known[rows], done[rows]
        width, never = near.shape[1], np.iinfo(np.int32).max
        column = np.arange(width)
        run = held.any(axis=1) & (held.sum(axis=1) == width - held[:, ::-1].argmax(axis=1) - held.argmax(axis=1))
        chosen = known & ~held & run[:, None]
        for start in range(stretch.shape[1]):
            some = np.flatnonzero(run & stretch[rows, start])
            low, high = max(0, start - SHIFT), start + self.span + SHIFT
            chosen[some, low + np.where(known[some, low:high], near[some, low:high], never).argmin(axis=1)] = True
        starts = self.stretch[rows] & ~run[:, None]
        step = max(1, min(-(-self.span // RANGES), self.span - self.apart))
        for low in range(0, starts.shape[1], step):
            some = starts[:, low : low + step]
            any_of = np.flatnonzero(some.any(axis=1))
            some = some[any_of]
            first, last = low + some.argmax(axis=1), low + some.shape[1] - 1 - some[:, ::-1].argmax(axis=1)
            all_hold = (column >= last[:, None]) & (column < first[:, None] + self.span)
            least = np.argpartition(np.where(all_hold, near[any_of], never), self.apart, axis=1)[:, : self.apart + 1]
            chosen[any_of[:, None], least] = True
        chosen &= near > 1
        common = near > COMMON
        by_common = chosen & common
        apart = common.sum(axis=1) != width - common[:, ::-1].argmax(axis=1) - common.argmax(axis=1)
        by_others = chosen & ~common | by_common.any(axis=1)[:, None] & known & ~common & (near > 1)
        out = []
        for places in (by_others | by_common & apart[:, None], by_common & ~apart[:, None]):
            row, place = np.nonzero(places)
            out.append((self._key(rows[row], place), rows[row]))
        return out

    def _common_of(self, leaders) -> list[bytes]:
        import numpy as np

        values = np.where(self.common[self.at[leaders]], self.table[leaders], -1)
        return [n.tobytes() + x.tobytes() for n, x in zip(self.number[leaders], values)]

    def stayed(self, leaders) -> None:
        """These have met all rows behind them."""
        self.seen.update(self._common_of(leaders))

    def _key(self, row, place):
        """One number of set, shingle and place."""
        import numpy as np

        return (self.number[row].astype(np.int64) << 8 * HASH_BYTES | self.table[row, place]) << 8 | place

    def _keys(self, rows):
        """(``_key``, number of the row in ``rows``, place) for all places."""
        import numpy as np

        row, place = np.nonzero(self.table[rows] >= 0)
        return self._key(rows[row], place), row, place

    def __call__(self, leaders, wanted) -> Iterator:
        """(leaders, rows behind them that are ``wanted`` and may gain by them), about MATCHES at a time."""
        import numpy as np

        new = np.array([x not in self.seen for x in self._common_of(leaders)], bool)
        for (keys, rows), some in zip(self.indexes, (leaders, leaders[new])):
            key, at, _ = self._keys(some)
            start, stop = np.searchsorted(keys, key - SHIFT), np.searchsorted(keys, key + SHIFT, side="right")
            upto = np.cumsum(np.bincount(at, stop - start, len(some)))
            # a leader's rows come together
            cuts = np.unique(np.searchsorted(upto, np.arange(MATCHES, upto[-1] if len(upto) else 0, MATCHES)))
            cuts = np.searchsorted(at, cuts).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                row, by = rows[_ranges(start[a:b], stop[a:b])], np.repeat(some[at[a:b]], stop[a:b] - start[a:b])
                later = (row > by) & wanted[row]
                by, row = np.divmod(np.unique(by[later] * len(self.table) + row[later]), len(self.table))
                yield by, row


def _ranges(start, stop):
    """All numbers from start to stop - 1, range after range."""
    import numpy as np

    size = stop - start
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _table(lefts, arounds, span: int):
    """Surroundings as rows aligned at c, -1 outside."""
    import numpy as np

    width = 2 * span - 1
    size = np.fromiter(map(len, arounds), np.int64, len(arounds)) // HASH_BYTES
    bytes_of = np.zeros((size.sum(), 4), np.uint8)
    bytes_of[:, :HASH_BYTES] = np.frombuffer(b"".join(arounds), np.uint8).reshape(-1, HASH_BYTES)
    start = np.arange(len(size)) * width + span - 1 - np.asarray(lefts, np.int64)
    table = np.full(len(size) * width, -1, np.int32)
    table[_ranges(start, start + size)] = bytes_of.view(np.int32)[:, 0]
    return table.reshape(-1, width)


def _values(members: DataFrame, span: int) -> DataFrame:
    """``_value_keys`` of members, each once a member."""

    def keys(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            table = _table(batch.column(1).to_pylist(), batch.column(2).to_pylist(), span)
            row, column = np.nonzero(table >= 0)
            both = np.stack([row, _value_keys(batch.column(0).to_numpy(), table)[row, column]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(both, axis=0)[:, 1].copy())], names=["key"])

    return members.select("key", "left", "around").mapInArrow(keys, "key long")


def _clustered(members: DataFrame, span: int, numerator: int, denominator: int, shared=None, parts: bool = False) -> DataFrame:
    """Members of each (key, part), in order of their first occurrence, against the group's leaders.

    Gives (key, hi, lo, by_doc, a, b): positions a..b around c repeat a passage of an earlier
    member, first met in document by_doc. With ``parts``, of groups that go on in other parts,
    leaders come too, with by_doc null. ``shared``: a map of the ``_value_keys`` that several
    members have; without it the shingles of the part itself are looked through. Several groups
    together are compared at once, each with its next leader per round; a large group's members that
    can't agree with each other go by sets of their own, one leader a set (``_Candidates``), and those
    of a very large set are compared with leaders that have one of their rarest shingles (``_Rarest``).
    """

    def join(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        wanted = np.frombuffer(shared.value, np.uint8) if shared is not None else None

        def stretches(count):
            total = np.zeros((len(count), count.shape[1] + 1), np.int32)
            np.cumsum(count, axis=1, out=total[:, 1:])
            return total

        def take(t):
            key, part, hi, lo, doc = (t.column(i).to_numpy() for i in range(5))
            group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            table = _table(t.column(6).to_pylist(), t.column(7).to_pylist(), span)
            known = _shared(group, table) if wanted is None else (table >= 0) & in_bit_map(wanted, _value_keys(key, table))
            total = stretches(known)
            m = total[:, span:] - total[:, :-span]
            # stretches that can agree with another member's and are no leader's yet
            own_stretch = m * denominator >= (2 * span - m) * numerator
            done = np.zeros(table.shape, bool)
            out = [[np.zeros(0, np.int64)] for _ in range(4)]
            # a member may come again from a later place that the map of first places can't tell from the first
            same = np.lexsort((lo, hi))
            again = (hi[same][1:] == hi[same][:-1]) & (lo[same][1:] == lo[same][:-1]) & (group[same][1:] == group[same][:-1])
            is_open = own_stretch.any(axis=1)
            is_open[same[1:][again]] = False
            # only open rows are compared; those of a large group by sets that can't agree with each other
            order, own = np.flatnonzero(is_open), group[is_open]
            candidates = _Candidates(table, span, numerator, denominator)
            sets = own.astype(np.int64) * len(group)
            if candidates.usable:
                many = np.bincount(own, minlength=1)[own] > COMPARED
                sets[many] += candidates.linked(group, order[many])
                by = np.argsort(sets, kind="stable")
                order, sets = order[by], sets[by]
            first = np.flatnonzero(np.concatenate([[True], sets[1:] != sets[:-1]])) if len(sets) else np.zeros(0, np.int64)
            end = np.append(first[1:], len(order))[: len(first)]
            number = np.repeat(np.arange(len(first)), end - first)
            set_of = np.zeros(len(group), np.int64)
            set_of[order] = number
            large = (end - first > COMPARED) & candidates.usable
            wide = end - first > MANY
            in_wide = order[np.repeat(wide, end - first)]
            rarest = _Rarest(set_of, table, in_wide, known, own_stretch, span, numerator, denominator) if len(in_wide) else None

            def compared(row, by):
                for x in range(0, len(row), 8192):
                    compare(row[x : x + 8192], by[x : x + 8192])

            def compare(row, by):
                covered = _agree(table[by], table[row], span, numerator, denominator)
                new = covered & ~done[row]
                done[row] |= new
                edge = np.diff(np.pad(new.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                (found, begin), (_, stop) = np.nonzero(edge == 1), np.nonzero(edge == -1)
                out[0].append(row[found]), out[1].append(by[found]), out[2].append(begin - span + 1), out[3].append(stop - span)
                unlike = known[row] & (table[row] != table[by])
                total = stretches(np.pad(unlike, ((0, 0), (SHIFT, SHIFT))))
                size = span + 2 * SHIFT
                left = own_stretch[row] & (total[:, size:] > total[:, :-size])
                if parts:
                    # another part's leader may come from an earlier document than both
                    left = np.where((doc[by] < doc[row])[:, None], left, own_stretch[row])
                own_stretch[row] = left
                is_open[row] = left.any(axis=1)

            # the first open rows of each set, more each time, meet the set's later ones
            alike, tried, rounds = _Alike(table, span, numerator, denominator), 1, 0
            place, undecided = np.zeros(len(group), np.int64), np.zeros(len(group), bool)
            while len(order):
                own = set_of[order]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                size = np.diff(np.append(first, len(order)))
                by_rarest = wide[own[first]]
                several = large[own[first]] & ~by_rarest
                count = np.minimum(size, np.where(by_rarest, tried, np.clip(PAIRS // size, 1, tried)))
                pairs_of = np.where(by_rarest, 0, count * size)
                base = np.cumsum(pairs_of) - pairs_of
                place[order] = _ranges(np.zeros(len(size), np.int64), size)
                pairs = np.zeros(int(pairs_of.sum()), bool)
                pairs[_ranges(base[~several], (base + pairs_of)[~several])] = True
                leaders = order[_ranges(first, first + count)]
                if several.any():
                    candidates.index(set_of, order[np.repeat(several, size)])
                    some = leaders[np.repeat(several, count)]
                    start_of = _ranges(np.zeros(len(size), np.int64), count) * np.repeat(size, count) + np.repeat(base, count)
                    by = np.argsort(some)
                    for at in candidates.among(set_of, some[by], start_of[np.repeat(several, count)][by], place):
                        pairs[at] = True
                at = np.flatnonzero(pairs)
                in_set = np.searchsorted(base, at, side="right") - 1
                by, row = np.divmod(at - base[in_set], size[in_set])
                later = row > by
                by, row = order[(first[in_set] + by)[later]], order[(first[in_set] + row)[later]]
                good = alike(by, row)
                met_by, met_row = [by[good]], [row[good]]
                if by_rarest.any():
                    if tried < LEADERS or not rounds % INDEXED:
                        rarest.index(order[np.repeat(by_rarest, size)], own_stretch, done)
                    rounds += 1
                    for by, row in rarest(leaders[np.repeat(by_rarest, count)], is_open):
                        good = alike(by, row)
                        met_by.append(by[good]), met_row.append(row[good])
                by, row = np.concatenate(met_by), np.concatenate(met_row)
                # each row meets its leaders in their order, as soon as it is known whether the next one of them stays
                sort = np.lexsort((by, row))
                by, row = by[sort], row[sort]
                begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
                end, met = np.append(begin[1:], len(row))[: len(begin)], row[begin]
                undecided[met] = True
                active = np.arange(len(met))
                while len(active):
                    ready = active[~undecided[by[begin[active]]]]
                    lead = by[begin[ready]]
                    begin[ready] += 1
                    stays = is_open[lead]
                    compared(met[ready[stays]], lead[stays])
                    over = ready[(begin[ready] >= end[ready]) | ~is_open[met[ready]]]
                    undecided[met[over]] = False
                    active = active[undecided[met[active]]]
                by_rarest = np.repeat(by_rarest, count)[is_open[leaders]]
                leaders = leaders[is_open[leaders]]
                is_open[leaders] = False
                if by_rarest.any():
                    rarest.stayed(leaders[by_rarest])
                if parts:
                    out[0].append(leaders), out[1].append(np.full(len(leaders), -1)), out[2].append(np.zeros(len(leaders), int)), out[3].append(np.zeros(len(leaders), int))
                order, tried = order[is_open[order]], min(2 * tried, LEADERS)
            row, lead, a, b = (np.concatenate(x) for x in out)
            none = lead < 0
            return pa.RecordBatch.from_arrays(
                [pa.array(key[row]), pa.array(hi[row]), pa.array(lo[row]), pa.array(doc[lead], mask=none), pa.array(a.astype(np.int32), mask=none), pa.array(b.astype(np.int32), mask=none)],
                names=["key", "hi", "lo", "by_doc", "a", "b"],
            )

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if len(held) < TOGETHER:
                continue
            t = held.combine_chunks()
            key, part = t.column(0).to_numpy(), t.column(1).to_numpy()
            # the last group may go on in the next batch
            start = len(key) - int(np.argmax(np.append((key[::-1] != key[-1]) | (part[::-1] != part[-1]), True)))
            if start:
                yield take(t.slice(0, start))
            held = t.slice(start)
        if held is not None and len(held):
            yield take(held.combine_chunks())

    ordered = members.select("key", "part", "hi", "lo", "doc_id", "c", "left", "around").repartition(F.col("key"), F.col("part")).sortWithinPartitions("key", "part", "doc_id", "c", "hi", "lo")
    return ordered.mapInArrow(join, "key long, hi long, lo long, by_doc long, a int, b int")


def repeats(docs: DataFrame, k: int = K, min_words: int = MIN_WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """Passages that repeat one of an earlier document: doc_id, first_word, last_word (numbered from 0), first_doc_id.

    Rows of one document don't overlap; first_doc_id is the smallest document the passage was matched with.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    span = min_words - k + 1
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    again = _keys(docs, k, span).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    bits = spark.sparkContext.broadcast(bit_map(again))
    found = written(_repeated(docs, bits, k, span))

    members = found.groupBy("hi", "lo").agg(
        F.min(F.struct("doc_id", "c")).alias("first"), F.max("doc_id").alias("last_doc"), F.first("key").alias("key"), F.first("left").alias("left"), F.first("size").alias("size")
    )
    members = written(members.select("key", "hi", "lo", "first.*", "last_doc", "left", "size"))
    groups = members.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")

    def surroundings(of: DataFrame) -> DataFrame:
        """The first occurrences of some members, with what surrounds them."""
        place = F.expr("hi ^ shiftleft(doc_id, 17) ^ shiftleft(c, 41)").alias("key")
        return _repeated(docs, bits, k, span, spark.sparkContext.broadcast(bit_map(of.select(place))))

    large = written(groups.filter(F.col("members") > PART))
    around = surroundings(members.join(groups, "key"))
    if large.isEmpty():
        near = written(_clustered(around.withColumn("part", F.lit(0)), span, numerator, denominator))
    else:
        # one scan for all groups
        around = written(around)
        some = around.join(large, "key", "left_anti")
        near = written(_clustered(some.withColumn("part", F.lit(0)), span, numerator, denominator))
        around = written(around.join(large, "key"))
        shared = spark.sparkContext.broadcast(bit_map(_values(around, span).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")))
        dealt = around.withColumn("part", F.pmod(F.col("hi"), F.ceil(F.col("members") / PART)).cast("int"))
        one = written(_clustered(dealt, span, numerator, denominator, shared, parts=True))
        # leaders of the parts of one group meet in a second round
        leaders = one.filter("by_doc is null").select("key", "hi", "lo").distinct()
        again = around.join(leaders, ["key", "hi", "lo"], "left_semi").withColumn("part", F.lit(0))
        near = near.unionAll(one.filter("by_doc is not null")).unionAll(_clustered(again, span, numerator, denominator, shared))

    # Occurrences in a member's first document repeat what the member repeats. Those in later documents repeat the
    # first one whole, and with it all that the member repeats: one row for each, whatever the member was matched with.
    # Each occurrence meets its member once.
    near = near.groupBy("hi", "lo", "a", "b").agg(F.min("by_doc").alias("by"))
    reached = near.groupBy("hi", "lo").agg(
        F.min("a").alias("low"), F.max("b").alias("high"), F.min("by").alias("least"), F.collect_list(F.struct("a", "b", "by")).alias("stretches")
    )
    whole = F.struct(
        F.least(-F.col("left"), "low").alias("a"), F.greatest(F.col("size") - F.col("left") - 1, "high").alias("b"), F.least("own_doc", "least").alias("by")
    )
    owners = members.select("hi", "lo", F.col("doc_id").alias("own_doc"), "last_doc", "left", "size")
    facts = owners.join(reached, ["hi", "lo"], "left").filter("last_doc > own_doc or least < own_doc").select(
        "hi", "lo", "own_doc", whole.alias("whole"), F.filter("stretches", lambda x: x.by < F.col("own_doc")).alias("stretches")
    )
    met = found.select("hi", "lo", "doc_id", "c").join(facts, ["hi", "lo"])
    at = met.select("doc_id", "c", F.inline(F.when(F.col("doc_id") > F.col("own_doc"), F.array("whole")).otherwise(F.col("stretches"))))
    spans = at.select("doc_id", (F.col("c") + F.col("a")).alias("first"), (F.col("c") + F.col("b") + k - 1).alias("last"), "by")
    spans = spans.groupBy("doc_id", "first").agg(F.max("last").alias("last"), F.min("by").alias("by"))
    w = Window.partitionBy("doc_id").orderBy("first")
    spans = spans.withColumn("reach", F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("first") <= F.col("reach") + 1, 0).otherwise(1)).over(w))
    return spans.groupBy("doc_id", "run").agg(F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.min("by").alias("first_doc_id")).select(
        "doc_id", "first_word", "last_word", "first_doc_id"
    )


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """``docs`` (doc_id, text, n_chars, any others) without the passages that repeat an earlier document's.

    Cut passages leave no trace but their white space; n_chars, where it is a column, follows. A
    document whose every word is cut goes.
    """
    name = free_name(docs.columns, "cut_words")
    spans = repeats(docs, **how).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first_word", "last_word"))).alias(name))
    joined = docs.join(spans, "doc_id", "left").select(*docs.columns, name)
    columns = docs.columns

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from shelfwise.llm.words import word_hashes

        for batch in batches:
            texts, spans, keep = batch.column("text").to_pylist(), batch.column(name).to_pylist(), []
            for i, (text, own) in enumerate(zip(texts, spans)):
                if own:
                    raw = text.encode()
                    _, _, start, end = word_hashes([raw.lower()])
                    parts, at = [], 0
                    for s in own:
                        parts.append(raw[at : start[s["first_word"]]])
                        at = end[s["last_word"]]
                    texts[i] = b"".join([*parts, raw[at:]]).decode()
                keep.append(not own or bool(texts[i].strip(" \t\n\v\f\r")))
            arrays = []
            for c in columns:
                x = batch.column(c)
                if c == "text":
                    x = pa.array(texts, pa.string())
                elif c == "n_chars":
                    x = pa.array([n if not own else len(t) for n, own, t in zip(x.to_pylist(), spans, texts)], x.type)
                arrays.append(x)
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep))

    return joined.mapInArrow(cut, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    return repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
