"""Removal of repeated byte strings, by column-wise suffix sorting of collections.

Each byte covered by a ``span``-byte string that also starts anywhere else goes.

1. Every ``span``-byte window has an anchor: the leftmost of its ``GRAM``-byte grams
   with the smallest hash. Equal windows have equal anchors at equal distances, so
   windows that share an anchor form a segment, and a string can repeat only among
   segments with the same anchor gram. Grams that occur once are left out.
2. Equal segments are one member of their gram's group; where it occurs twice, all its
   windows repeat.
3. Unlike segments of a group are sorted together, but for those that agree with no
   other on the bytes that a shared string would need: whole groups are gathered into
   collections of bounded size, whose Burrows-Wheeler transform and common prefixes
   are built column by column (``collection_bwt``). Every string holds the gram of its
   group at its anchor, so two symbols stand for the gram: the columns are fewer, and a
   common prefix of ``span``, less what the gram lost, with either neighbour marks a
   repeated string.
4. A group larger than a collection is split by its windows instead: digests of its
   strings are counted, which needs no group in one place.

Defined cases: a null or empty text has no bytes and nothing removed (the digest is that
of no bytes); texts shorter than ``span`` keep everything; repeated rows are copies of
each other; null doc_ids are allowed; other columns are ignored; an empty table gives an
empty result. Segments and split strings are compared by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import bit_map, bound_batches, in_bit_map, with_mark, written

SPAN, GRAM = 200, 64
#: Segments sorted together, of at most half as many groups; a larger group takes the way of step 4.
COLLECTION = 224
#: A byte that UTF-8 doesn't have: with a byte for the group, it stands for the anchor gram in a collection.
GRAM_MARK = b"\xfe"
#: Ranges of a string's reach before its gram, by which members that can't repeat are told.
PARTS = 16
LARGE_GROUP = 4096
#: Bytes of text whose anchors are found at a time, and the powers of the rolling hash.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


class _Anchors:
    def __init__(self, span: int, gram: int) -> None:
        import numpy as np

        self.span, self.gram = span, gram
        n = 2 * BLOCK + span
        self.power, self.inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        self.power[0] = self.inverse[0] = 1
        self.power, self.inverse = np.multiply.accumulate(self.power), np.multiply.accumulate(self.inverse)

    def blocks(self, raw: list[bytes]) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
        """Pieces (text, its first byte) joined to about BLOCK bytes; a longer text's pieces overlap by span - 1."""
        held: list[tuple[int, int]] = []
        parts: list[bytes] = []
        size = 0
        for i, text in enumerate(raw):
            for at in range(0, max(1, len(text) - self.span + 1), BLOCK):
                part = text[at : at + BLOCK + self.span - 1]
                if len(part) < self.span:
                    continue
                held.append((i, at)), parts.append(part)
                size += len(part)
                if size >= BLOCK:
                    yield held, parts
                    held, parts, size = [], [], 0
        if held:
            yield held, parts

    def __call__(self, parts: list[bytes]):
        """(hash of the anchor gram, anchor, first and last window start, piece), places counted in the joined pieces."""
        import numpy as np

        from shelfwise.llm.words import mix

        span, gram = self.span, self.gram
        data = np.frombuffer(b"".join(parts), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        n = len(data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=total[1:])
        h = mix((total[gram:] - total[:-gram]) * self.inverse[: n - gram + 1])
        # the smallest upper hash, leftmost first; a block is shorter than 2 ** 22 bytes
        low = ((h >> np.uint64(23)) << np.uint64(22)).view(np.int64) | np.arange(len(h))
        wide, width = span - gram + 1, 1
        count = len(low) - wide + 1
        while 2 * width <= wide:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        low = np.minimum(low[:count], low[wide - width : wide - width + count])
        anchor = low & ((1 << 22) - 1)
        piece = np.repeat(np.arange(len(parts)), np.diff(off))[:count]
        valid = np.arange(count) + span <= off[piece + 1]
        starts = np.flatnonzero(valid)
        anchor, piece = anchor[valid], piece[valid]
        change = np.ones(len(starts), bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(starts)) - 1
        a = anchor[first]
        return h[a].view(np.int64), a, starts[first], starts[last], piece[first], off


def _grams(docs: DataFrame, span: int, gram: int) -> DataFrame:
    def grams(batches: Iterator) -> Iterator:
        import pyarrow as pa

        anchors = _Anchors(span, gram)
        for batch in batches:
            for _, parts in anchors.blocks([(t or "").encode() for t in batch.column(0).to_pylist()]):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(parts)[0])], names=["key"])

    return docs.select("text").mapInArrow(grams, "key long")


SEGMENTS = "hi long, lo long, key long, doc_id long, text_hash long, start long, windows int, anchor int, bytes binary"


def _segments(docs: DataFrame, bits, span: int, gram: int) -> DataFrame:
    """Segments whose gram repeats (and a few more), by digest, with gram and bytes where a batch meets them first."""

    def segments(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        anchors, wanted = _Anchors(span, gram), np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            seen: set = set()
            for held, parts in anchors.blocks(raw):
                key, anchor, first, last, piece, off = anchors(parts)
                hit = np.flatnonzero(in_bit_map(wanted, key))
                rows = []
                base = off[piece[hit]]
                for k, a, s, e, p in zip(key[hit].tolist(), (anchor[hit] - first[hit]).tolist(), (first[hit] - base).tolist(), (last[hit] - base).tolist(), piece[hit].tolist()):
                    own = parts[p][s : e + span]
                    digest = xxhash.xxh3_128_digest(own + a.to_bytes(2, "little"))
                    fresh = digest not in seen
                    seen.add(digest)
                    text, at = held[p]
                    rows.append((k if fresh else None, digest, ids[text], hashes[text], at + s, e - s + 1, a if fresh else None, own if fresh else None))
                if rows:
                    k, digest, doc, text_hash, start, windows, a, own = zip(*rows)
                    both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                    long = pa.int64()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(k, long), pa.array(doc, long), pa.array(text_hash, long), pa.array(start, long), pa.array(windows, pa.int32()), pa.array(a, pa.int32()), pa.array(own, pa.binary())],
                        names=["hi", "lo", "key", "doc_id", "text_hash", "start", "windows", "anchor", "bytes"],
                    )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(segments, SEGMENTS)


def _runs(flags) -> list[tuple[int, int]]:
    import numpy as np

    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def _can_repeat(group: list[tuple], span: int, gram: int) -> list[tuple]:
    """The members (.., occurrences, anchor, bytes) of one gram's group whose repeats are still to be found.

    A shared string reaches ``left`` bytes before the gram in one of ``PARTS`` ranges, so two
    members that share one agree on all bytes that every such string holds. Members that agree
    with no other can't repeat, and a set of agreeing members that all occur twice or more
    repeats anyway.
    """
    room = span - gram
    step = -(-(room + 1) // PARTS)
    root = list(range(len(group)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    first: dict[tuple, int] = {}
    for at, (*_, anchor, own) in enumerate(group):
        for i in range(PARTS):
            # strings with i * step <= left < (i + 1) * step hold these bytes at least
            left, right = i * step, max(0, room - (i + 1) * step + 1)
            if anchor >= left and anchor + gram + right <= len(own):
                other = first.setdefault((i, own[anchor - left : anchor + gram + right]), at)
                if other != at:
                    root[find(at)] = find(other)
    sets: dict[int, list[tuple]] = {}
    for at, row in enumerate(group):
        sets.setdefault(find(at), []).append(row)
    return [row for rows in sets.values() if len(rows) > 1 and any(r[3] == 1 for r in rows) for row in rows]


def _sorted_together(members: DataFrame, span: int, gram: int) -> DataFrame:
    """(hi, lo, a, b): windows a..b of a member repeat in another member of its group (or in itself)."""

    def sort(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from shelfwise.llm.collection_bwt import repeated_starts

        held: list = []
        group: list = []

        def flush(rows):
            out = []
            number: dict[int, int] = {}
            brief = [own[:anchor] + GRAM_MARK + bytes([number.setdefault(key, len(number))]) + own[anchor + gram :] for key, *_, anchor, own in rows]
            for (_, hi, lo, *_), flags in zip(rows, repeated_starts(brief, span - gram + 2)):
                out += [(hi, lo, a, b) for a, b in _runs(flags)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, kinds)], names=["hi", "lo", "a", "b"])

        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                if group and row[0] != group[-1][0]:
                    held += _can_repeat(group, span, gram)
                    group = []
                    if len(held) >= COLLECTION:
                        yield flush(held)
                        held = []
                group.append(row)
        held += _can_repeat(group, span, gram)
        if held:
            yield flush(held)

    rows = members.select("key", "hi", "lo", "n", "anchor", "bytes").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(sort, "hi long, lo long, a int, b int")


def _counted_apart(members: DataFrame, span: int) -> DataFrame:
    """The same for groups too large for a collection: digests of all their strings are counted."""

    def strings(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for hi, lo, own in zip(*(x.to_pylist() for x in batch.columns)):
                n = len(own) - span + 1
                d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(own[i : i + span]) for i in range(n)]), np.int64).reshape(-1, 2)
                columns = [pa.array([x] * n, pa.int64()) for x in (hi, lo)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(n), pa.int32()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names=["hi", "lo", "a", "x", "y"])

    each = members.select("hi", "lo", "bytes").mapInArrow(strings, "hi long, lo long, a int, x long, y long")
    again = each.groupBy("x", "y").agg(F.count("*").alias("n")).filter("n > 1").select("x", "y")
    return each.join(again, ["x", "y"]).select("hi", "lo", "a", F.col("a").alias("b"))


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, starts): for each document with repeated strings, runs (first, last) of their start bytes.

    ``docs`` has doc_id (long) and text; text_hash is xxhash64 of the text, and tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    again = _grams(docs, span, gram).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    bits = spark.sparkContext.broadcast(bit_map(again))
    found = written(_segments(docs, bits, span, gram))
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    members = written(found.groupBy("hi", "lo").agg(F.count("*").alias("n"), first("windows"), first("key")))
    # where a member occurs twice, all its windows repeat: a group of such members needs no sorting
    sizes = written(members.groupBy("key").agg(F.count("*").alias("size"), F.min("n").alias("least")).filter("size > 1 and least = 1").drop("least"))
    # bytes move only of groups to be sorted, and of a few that the bounded map can't tell
    held = with_mark(found.filter("bytes is not null"), F.col("key"), sizes.select("key")).filter("mark")
    held = held.groupBy("hi", "lo").agg(first("anchor"), first("bytes"))

    def groups(which: str) -> DataFrame:
        return members.join(sizes.filter(which), "key").join(held, ["hi", "lo"])

    apart = _sorted_together(groups(f"size <= {LARGE_GROUP}"), span, gram)
    if not sizes.filter(F.col("size") > LARGE_GROUP).isEmpty():
        apart = apart.unionAll(_counted_apart(groups(f"size > {LARGE_GROUP}"), span))
    copies = members.filter("n > 1").select("hi", "lo", F.lit(0).alias("a"), (F.col("windows") - 1).alias("b"))
    marked = copies.unionAll(apart)
    at = found.select("hi", "lo", "doc_id", "text_hash", "start").join(marked, ["hi", "lo"])
    return at.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct((F.col("start") + F.col("a")).alias("first"), (F.col("start") + F.col("b")).alias("last"))).alias("starts"))


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, spans (removed runs: first, length), kept (the remaining bytes)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spans = written(repeated_spans(docs, span, gram).withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "th"))
    # texts without spans, but for a few that the bounded map can't tell, are not exchanged
    marked = with_mark(docs, F.xxhash64("text"), spans.select("th"))
    with_spans = marked.filter("mark").join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("th")), "left")
    kind = spans.schema["starts"].dataType
    joined = with_spans.select("doc_id", "text", "starts").unionAll(marked.filter("not mark").select("doc_id", "text", F.lit(None).cast(kind).alias("starts")))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, sizes, removed, spans, kept = batch.column(0), [], [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode()
                runs: list[dict] = []
                end = -1
                for first, last in sorted((x["first"], x["last"]) for x in starts or ()):
                    if runs and first <= end:
                        end = max(end, last + span)
                        runs[-1]["length"] = end - runs[-1]["first"]
                    else:
                        end = last + span
                        runs.append({"first": first, "length": end - first})
                parts, at = [], 0
                for r in runs:
                    parts.append(raw[at : r["first"]])
                    at = r["first"] + r["length"]
                left = b"".join([*parts, raw[at:]])
                sizes.append(len(raw)), removed.append(len(raw) - len(left)), spans.append(runs), kept.append(left)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<first: long, length: long>>, kept binary")


def op9(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    out = without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
