"""Benchmark decontamination: a generalised suffix automaton of the benchmark's items.

Words are runs of 0-9, a-z (A-Z lower-cased) and characters from U+0080 on. An
item of n words has windows of ``min(max_words, ceil(coverage * n))`` words, and
a document word inside any occurrence of a window is hit: it belongs to a span
over the length limit (``max_words``) or over the coverage limit (that share of a
whole item).

The items' word sequences go into suffix automata of at most ``BLOCK_WORDS``
words each, built in Spark tasks (a longer item is cut into pieces that overlap by
a window less one word, so that no window is lost). Each automaton is sent to all
tasks in a round of its own, bounded by BLOCK_WORDS and not by the benchmark, and
the documents are streamed through it where they are: nothing is exchanged. A task
walks many stretches of words side by side (numpy); at each word it holds the
automaton's state and the longest matching length. Stretches are runs of word pairs that
occur in items: elsewhere the match is at most one word long. A window that ends at
a word is the state's suffix-link ancestor of that length, and a table of (ancestor,
window length) names its items.

Words are compared by 64-bit hashes. Defined results: a null or empty text (or one
without words) has no words; an item without words has no window; an item with null id
hits words, but is counted and named nowhere; repeated items count once per id; documents
are judged row by row, so repeated, tied and null doc_ids don't matter; further columns are kept.
"""

from __future__ import annotations

import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import free_name, table, written
from shelfwise.llm.words import BLOCK_BYTES, cut, word_hashes

MAX_WORDS = 10
COVERAGE = 1.0
#: Words of one automaton (at most about 50 MB as arrays).
BLOCK_WORDS = 1 << 18
#: Bytes of item texts handled by one building task.
BUILD_BYTES = 1 << 23
#: Words walked by one lane of a batch.
LANE_WORDS = 2048
_BITS = 1 << 20
_PAIR = np.uint64(0x9E3779B97F4A7C15)
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end), with work memory for about BLOCK_BYTES of text at a time."""
    held, size, parts, counts = [], 0, [], np.zeros(len(texts), np.int64)

    def flush():
        h, first, _, _ = word_hashes([r for _, r in held], APART)
        parts.append(h)
        np.add.at(counts, [i for i, _ in held], np.diff(first))
        held.clear()

    for i, text in enumerate(texts):
        for _, piece in cut((text or "").encode().lower(), APART):
            held.append((i, piece))
            size += len(piece)
            if size >= BLOCK_BYTES:
                flush()
                size = 0
    if held:
        flush()
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum(counts)])


def spots(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte start and end of each word of a text in UTF-8."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, piece in cut(text.encode().lower(), APART):
        _, _, s, e = word_hashes([piece], APART)
        starts.append(s + at)
        ends.append(e + at)
    return np.concatenate(starts), np.concatenate(ends)


def window_of(n_words: int, max_words: int, coverage: float) -> int:
    return min(max_words, math.ceil(coverage * n_words))


def _extend(last: int, c: int, step: list, link: list, length: list) -> int:
    """The state of the longest prefix after symbol ``c``, in an automaton that may have seen it already."""
    q = step[last].get(c)
    if q is None:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p < 0:
            return new
        q = step[p][c]
        link[new] = q if length[q] == length[p] + 1 else _split(p, q, c, step, link, length)
        return new
    return q if length[q] == length[last] + 1 else _split(last, q, c, step, link, length)


def _split(p: int, q: int, c: int, step: list, link: list, length: list) -> int:
    """Part the strings of q that end a step from p, as a state of their own."""
    own = len(step)
    step.append(dict(step[q]))
    length.append(length[p] + 1)
    link.append(link[q])
    link[q] = own
    while p >= 0 and step[p].get(c) == q:
        step[p][c] = own
        p = link[p]
    return own


class Automaton:
    """Suffix automaton of word sequences with, for each window, the items that hold it."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def of(cls, pieces: list[tuple[int | None, int, np.ndarray]]) -> Automaton:
        """pieces: (item id, its window's length, word hashes)."""
        alphabet = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for _, _, h in pieces]]))
        step, link, length = [{}], [-1], [0]
        ends, pairs = [], [np.zeros(0, np.uint64)]
        for item, w, h in pieces:
            last = 0
            for i, c in enumerate(np.searchsorted(alphabet, h).tolist()):
                last = _extend(last, c, step, link, length)
                if i + 1 >= w:
                    ends.append((last, w, item))
            pairs.append(pair_keys(h[:-1], h[1:]))
        size = max(len(alphabet), 1)
        keys = np.array([s * size + c for s, to in enumerate(step) for c in to], np.int64)
        targets = np.array([q for to in step for q in to.values()], np.int32)
        order = np.argsort(keys)
        out = cls({"alphabet": alphabet, "keys": keys[order], "targets": targets[order], "link": np.array(link, np.int32), "length": np.array(length, np.int32), "pairs": np.unique(np.concatenate(pairs))})
        out.bits = np.zeros(_BITS, bool)
        out.bits[(alphabet & np.uint64(_BITS - 1)).astype(np.int64)] = True
        out.widths = np.unique([w for _, w, _ in ends]).astype(np.int64)
        state = np.array([s for s, _, _ in ends], np.int64)
        wide = np.array([w for _, w, _ in ends], np.int64)
        ids = sorted({i for _, _, i in ends if i is not None})
        number = {i: k for k, i in enumerate(ids)} | {None: -1}
        item = np.array([number[i] for _, _, i in ends], np.int64)
        key = out.climbed(state, wide) * len(out.widths) + np.searchsorted(out.widths, wide)
        held = np.unique(np.stack([key, item]), axis=1) if len(key) else np.zeros((2, 0), np.int64)
        out.windows, out.first = np.unique(held[0], return_index=True)
        out.first = np.append(out.first, held.shape[1]).astype(np.int64)
        out.item, out.ids = held[1], np.array(ids, np.int64)
        return out

    def climbed(self, state: np.ndarray, width) -> np.ndarray:
        """The suffix-link ancestor that holds the suffix of ``width`` words."""
        state, width = state.copy(), np.broadcast_to(width, state.shape)
        at = np.arange(len(state))
        while len(at):
            up = self.link[state[at]]
            more = (up >= 0) & (self.length[up] >= width[at])
            at = at[more]
            state[at] = up[more]
        return state

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: v for k, v in self.__dict__.items() if k != "bits"})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Automaton:
        out = cls(dict(np.load(io.BytesIO(raw))))
        out.bits = np.zeros(_BITS, bool)
        out.bits[(out.alphabet & np.uint64(_BITS - 1)).astype(np.int64)] = True
        return out

    def tokens(self, h: np.ndarray) -> np.ndarray:
        """Place of each word in the alphabet, -1 if it is not there."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.bits[(h & np.uint64(_BITS - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.alphabet, h[maybe]), max(len(self.alphabet) - 1, 0))
        found = self.alphabet[at] == h[maybe] if len(self.alphabet) else np.zeros(len(maybe), bool)
        out[maybe[found]] = at[found]
        return out

    def runs(self, h: np.ndarray, first: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, words) of the stretches in which each word pair occurs in items, if as long as the shortest window."""
        known = token >= 0
        joined = np.zeros(len(h), bool)  # to the word before
        both = np.flatnonzero(known[1:] & known[:-1]) + 1
        if len(both):
            own = pair_keys(h[both - 1], h[both])
            at = np.minimum(np.searchsorted(self.pairs, own), max(len(self.pairs) - 1, 0))
            joined[both] = self.pairs[at] == own if len(self.pairs) else False
        joined[first[:-1][first[:-1] < len(h)]] = False
        starts = np.flatnonzero(known & ~joined)
        after = np.append(joined[1:], False)
        ends = np.flatnonzero(known & ~after) + 1
        long = ends - starts >= self.widths[0]
        return starts[long], (ends - starts)[long]

    def walked(self, token: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, state, longest matching length) wherever a match is as long as the shortest window."""
        overlap, least = int(self.widths[-1]) - 1, int(self.widths[0])
        stride = max(LANE_WORDS, 4 * overlap) - overlap
        n = np.maximum(1, -(-(sizes - overlap) // stride))
        lane = np.repeat(np.arange(len(starts)), n)
        nth = np.arange(len(lane)) - np.repeat(np.cumsum(n) - n, n)
        begin = starts[lane] + nth * stride
        size = np.minimum(stride + overlap, starts[lane] + sizes[lane] - begin)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        state, matched = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        symbols = max(len(self.alphabet), 1)
        for j in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -j, side="left"))  # lanes of over j words
            c = token[begin[:live] + j]
            open_ = np.arange(live)
            while len(open_):
                key = state[open_] * symbols + c[open_]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                done = open_[hit]
                state[done] = self.targets[at[hit]]
                matched[done] += 1
                open_ = open_[~hit]
                root = state[open_] == 0
                matched[open_[root]] = 0
                open_ = open_[~root]
                state[open_] = self.link[state[open_]]
                matched[open_] = self.length[state[open_]]
            far = np.flatnonzero(matched[:live] >= least)
            if len(far):
                yield begin[far] + j, state[far], matched[far]

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end of each hit window, as words), and (text, item) pairs as columns."""
        none = np.zeros(0, np.int64)
        if not len(self.windows) or not len(h):
            return none, none, np.zeros((2, 0), np.int64)
        token = self.tokens(h)
        found = list(self.walked(token, *self.runs(h, first, token)))
        if not found:
            return none, none, np.zeros((2, 0), np.int64)
        place, state, matched = (np.concatenate(x) for x in zip(*found))
        begins, ends, pairs = [], [], []
        for k, w in enumerate(self.widths):
            fit = matched >= w
            key = self.climbed(state[fit], int(w)) * len(self.widths) + k
            at = np.minimum(np.searchsorted(self.windows, key), len(self.windows) - 1)
            good = self.windows[at] == key
            end = place[fit][good] + 1
            begins.append(end - w)
            ends.append(end)
            text = np.searchsorted(first, end - 1, side="right") - 1
            pairs.append(np.unique(np.stack([text, at[good]]), axis=1) if len(text) else np.zeros((2, 0), np.int64))
        text, window = np.unique(np.concatenate(pairs, axis=1), axis=1)
        n = self.first[window + 1] - self.first[window]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = self.item[np.repeat(self.first[window], n) + nth]
        named = item >= 0
        owners = np.unique(np.stack([np.repeat(text, n)[named], item[named]]), axis=1) if named.any() else np.zeros((2, 0), np.int64)
        return np.concatenate(begins), np.concatenate(ends), owners


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * _PAIR) ^ (b + (a >> np.uint64(29)))


def _builder(max_words: int, coverage: float):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0

        def block():
            return pa.RecordBatch.from_pydict({"number": [uuid.uuid4().hex], "block": pa.array([Automaton.of(held).to_bytes()], pa.binary())})

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, _ = hashed([text])
                if not len(h):
                    continue
                w = window_of(len(h), max_words, coverage)
                stride = max(1, BLOCK_WORDS - w + 1)
                for at in range(0, max(1, len(h) - w + 1), stride):
                    piece = h[at : at + stride + w - 1]
                    if held and size + len(piece) > BLOCK_WORDS:
                        yield block()
                        held, size = [], 0
                    held.append((item, w, piece))
                    size += len(piece)
        if held:
            yield block()

    return build


def automata(items: DataFrame, max_words: int = MAX_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """The automata of ``items`` (id, text), one a row, stored in the shared folder."""
    item, text = items.columns
    rows = items.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(1, -(-total // BUILD_BYTES))
    return written(rows.repartition(tasks).mapInArrow(_builder(max_words, coverage), "number string, block binary"))


def _scanner(block: bytes, text_at: str, names: tuple[str, str, str], drop_text: bool):
    """A task's pass over documents: words, spans and items are added, or joined to those of earlier automata."""
    n_words, spans, found = names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton.from_bytes(block) if block else None
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            h, first = hashed(texts)
            begin, end, owners = machine.hits(h, first) if machine else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((2, 0), np.int64))
            items = [[] for _ in texts]
            for t, i in owners.T.tolist():
                items[t].append(int(machine.ids[i]))
            if spans in batch.schema.names:
                was = batch.column(spans).to_pylist()
                begin = np.concatenate([begin, np.array([first[t] + s["start"] for t, x in enumerate(was) for s in x], np.int64)])
                end = np.concatenate([end, np.array([first[t] + s["stop"] for t, x in enumerate(was) for s in x], np.int64)])
                items = [sorted({*a, *b}) for a, b in zip(items, batch.column(found).to_pylist())]
            depth = np.bincount(begin, minlength=len(h) + 1) - np.bincount(end, minlength=len(h) + 1)
            inside = np.concatenate([[False], np.cumsum(depth[: len(h)]) > 0, [False]])
            cuts = np.zeros(len(h) + 1, bool)
            cuts[first] = True
            rise = np.flatnonzero(inside[1:] & (~inside[:-1] | cuts))
            fall = np.flatnonzero(inside[:-1] & (~inside[1:] | cuts))
            out: list[list] = [[] for _ in texts]
            for t, a, b in zip((np.searchsorted(first, rise, side="right") - 1).tolist(), rise.tolist(), fall.tolist()):
                out[t].append({"start": a - int(first[t]), "stop": b - int(first[t])})
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in names and not (drop_text and n == text_at)]
            kept.append((n_words, pa.array(np.diff(first), pa.int64())))
            kept.append((spans, pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))))
            kept.append((found, pa.array(items, pa.list_(pa.int64()))))
            yield pa.RecordBatch.from_arrays([c for _, c in kept], names=[n for n, _ in kept])

    return scan


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", max_words: int = MAX_WORDS, coverage: float = COVERAGE, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, hit_spans (runs of hit words: start, stop) and hit_items (ids of ``items``: id, text).

    One round over the documents for each automaton; a benchmark of under
    BLOCK_WORDS words is one round. The names get underscores where ``docs`` has them.
    """
    spark = docs.sparkSession
    names = tuple(free_name(docs.columns, n) for n in ("n_words", "hit_spans", "hit_items"))
    blocks = automata(items, max_words, coverage)
    numbers = [r.number for r in blocks.select("number").sort("number").toLocalIterator()] or [None]
    out = docs
    added = f"`{names[0]}` long, `{names[1]}` array<struct<start: long, stop: long>>, `{names[2]}` array<long>"
    for k, number in enumerate(numbers):
        block = blocks.filter(F.col("number") == number).first().block if number else b""
        last = k + 1 == len(numbers)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if keep_text or not last or f.name != text)
        out = out.mapInArrow(_scanner(block, text, names, last and not keep_text), f"{schema}, {added}" if schema else added)
        if not last and k % 8 == 7:
            out = written(out)
    return out


def _remover(text_at: str, spans_at: str):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            for i, spans in enumerate(batch.column(spans_at).to_pylist()):
                if spans:
                    raw, (start, end) = texts[i].encode(), spots(texts[i])
                    at, parts = 0, []
                    for s in spans:
                        parts.append(raw[at : start[s["start"]]])
                        at = int(end[s["stop"] - 1])
                    texts[i] = b"".join([*parts, raw[at:]]).decode()
            kept = [n for n in batch.schema.names if n != spans_at]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text_at else batch.column(n) for n in kept], names=kept)

    return remove


def without_contamination(docs: DataFrame, items: DataFrame, text: str = "text", max_words: int = MAX_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with every hit span gone from its text, from the span's first word to its last; all other columns stay."""
    marked = contamination(docs, items, text, max_words, coverage)
    spans = marked.columns[-2]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return marked.select(*docs.columns, spans).mapInArrow(_remover(text, spans), schema)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and occurring items of every document against the whole benchmark."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), keep_text=False)
    names = F.array_join(F.array_sort(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )
