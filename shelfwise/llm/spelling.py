"""Spelling variant grouping by reduced-alphabet generation.

Words are maximal runs of A-Z, a-z and U+00C0..U+00FF with A-Z lower-cased.
``variants(vocabulary)`` finds, for every word of a vocabulary (word, n), the words that
differ from it by exactly one inserted, deleted or replaced code point:

1. Letters are hashed to a few symbols. Each word length has its own alphabet, of as
   many symbols as keep reduced words of that length more numerous than the vocabulary
   (``SPREAD`` times); letters go to symbols by their frequency, so that symbols are even.
2. One-edit neighbourhoods of reduced words are generated as hashes: the word itself,
   every replaced symbol, every deleted symbol. A neighbour with an inserted symbol is the
   deletion of the longer word, and a replacement by a smaller symbol that of the other word,
   so each pair of neighbourhoods is met from one side only, once.
3. Neighbours are joined with the reduced vocabulary (lengths L and L - 1 meet under the
   alphabet of L), and pairs are verified on the original words.

Hashes of neighbours come from prefix sums in numpy, so a word of a million letters costs
its length times the alphabet and no more. A bit map of the vocabulary's own
hashes (8 MB at any size) keeps most of the neighbours that no word has out of the exchange;
a full map only lets more through.

A word's form is its near word of the largest n (ties: smallest in code-point order), if that is at
least ``FACTOR`` times its own; its root is where forms lead, found by pointer doubling (n
doubles along a path, so it has at most 63 steps).

Defined results: a null or empty text has no words; a null doc_id is written as nothing;
repeated rows count each; an empty table gives no words; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import bit_map, in_bit_map, table, written
from shelfwise.llm.words import mix

MIN_LETTERS = 5
MIN_COUNT = 3
FACTOR = 2
#: Of the occurrences whose hash this divides, a letter is deleted (op11's given damage).
DAMAGE = 97
#: Reduced words of a length to one vocabulary word, at least.
SPREAD = 32
MAX_SYMBOLS = 26
#: Distinct words that a counting task holds before it hands on its counts.
HELD_WORDS = 1 << 19
#: Symbols of a block of words whose neighbours are made at once.
BLOCK_SYMBOLS = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
#: Letters by their code in Latin-1, all other codes as spaces.
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def letter_runs(text: str | None) -> list[bytes]:
    """The words of a text in Latin-1, one byte a code point."""
    return (text or "").encode("latin-1", "replace").lower().translate(_LETTERS).split()


def _counted(min_letters: int, damage: int | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            words = [w.decode("latin-1") for w, n in held.items() if n]
            counts = [n for n in held.values() if n]
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_pydict({"word": pa.array(words[at : at + 50_000], pa.string()), "n": pa.array(counts[at : at + 50_000], pa.int64())})

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = [w for w in letter_runs(text.as_py()) if len(w) >= min_letters]
                held.update(runs)
                if damage:
                    start = zlib.crc32(b":", zlib.crc32(str("" if key is None else key).encode()))
                    own = None
                    for w in set(runs):
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % damage == 0:
                            own = own or Counter(runs)
                            at = h % len(w)
                            held[w] -= own[w]
                            if len(w) > min_letters:
                                held[w[:at] + w[at + 1 :]] += own[w]
                if len(held) > HELD_WORDS:
                    yield from out()
                    held.clear()
        yield from out()

    return task


def vocabulary(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, damage: int | None = None) -> DataFrame:
    """(word, n) of all words of ``docs`` (doc_id, text) with so many letters and occurrences.

    With ``damage``, an occurrence loses its letter h mod length where h, the unsigned
    CRC-32 of ``doc_id:word``, is divisible by it. Counts are summed per task before the exchange.
    """
    counts = docs.mapInArrow(_counted(min_letters, damage), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def alphabets(letters: dict[str, int], words: int, longest: int) -> dict[int, np.ndarray]:
    """Word length -> symbol of each Latin-1 code: the most frequent letters first, each to the lightest symbol.

    Lengths from which two symbols are enough share one alphabet (key 0).
    """
    by_count = sorted(letters, key=lambda c: (-letters[c], c))
    out: dict[int, np.ndarray] = {}
    size = 0
    for length in range(1, longest + 2):
        size = 2
        while size**length < SPREAD * max(words, 1) and size < MAX_SYMBOLS:
            size += 1
        symbol, load = np.zeros(256, np.uint8), [0] * size
        for c in by_count:
            k = load.index(min(load))
            symbol[ord(c)] = k
            load[k] += letters[c]
        out[0 if size == 2 else length] = symbol
        if size == 2:
            break
    return out


class Reducer:
    """Hashes of reduced words and of their one-edit neighbours, for words of one length as rows of Latin-1 codes."""

    def __init__(self, alphabets: dict[int, np.ndarray]):
        self.alphabets = alphabets
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def _sums(self, codes: np.ndarray, level: int):
        symbol = self.alphabets[level if level in self.alphabets else 0][codes]
        power = np.full(codes.shape[1] + 1, _BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        terms = self.value[symbol] * power[:-1]
        return symbol, power, terms, np.cumsum(terms, axis=1, dtype=np.uint64)

    @staticmethod
    def _key(total: np.ndarray, length: int, level: int) -> np.ndarray:
        return mix(total + np.uint64((length * 0x2545F4914F6CDD1D + level * 0x9FB21C651E98DF25) & 0xFFFFFFFFFFFFFFFF)).view(np.int64)

    def own(self, codes: np.ndarray, level: int) -> np.ndarray:
        """Key of each word itself under the alphabet of ``level``."""
        *_, sums = self._sums(codes, level)
        return self._key(sums[:, -1], codes.shape[1], level)

    def neighbours(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, key) of every neighbour with a larger symbol or one symbol less."""
        n, level = codes.shape[1], codes.shape[1]
        symbol, power, terms, sums = self._sums(codes, level)
        total = sums[:, -1:]
        top = int(self.alphabets[level if level in self.alphabets else 0].max())
        for s in range(1, top + 1):
            row, place = np.nonzero(symbol < s)
            yield row, self._key(total[row, 0] + (self.value[s] - self.value[symbol[row, place]]) * power[place], n, level)
        last = np.ones(symbol.shape, bool)  # of a run of equal symbols: deleting any gives the same
        last[:, :-1] = symbol[:, 1:] != symbol[:, :-1]
        row, place = np.nonzero(last)
        rest = sums[row, place] - terms[row, place] + (total[row, 0] - sums[row, place]) * _INVERSE
        yield row, self._key(rest, n - 1, level)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, codes) of words of one length, in blocks."""
    length = np.array([len(w) for w in words], np.int64)
    order = np.argsort(length, kind="stable")
    sizes, starts = np.unique(length[order], return_index=True)
    for size, a, b in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
        rows = max(1, BLOCK_SYMBOLS // size)
        for at in range(a, b, rows):
            places = order[at : min(b, at + rows)]
            codes = np.frombuffer("".join(words[i] for i in places).encode("latin-1"), np.uint8).reshape(len(places), size)
            yield places, codes


def _keyed(reducer: Reducer, bits: bytes | None):
    """Without a bit map, each word's own keys (as its length and as the shorter of two); with one, the keys of its neighbours and its own."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bits is None else np.frombuffer(bits, np.uint8)
        for batch in batches:
            words, counts = batch.column(0), batch.column(1)
            for places, codes in _by_length(words.to_pylist()):
                size = codes.shape[1]
                if held is None:
                    found = [(np.arange(len(places)), reducer.own(codes, size)), (np.arange(len(places)), reducer.own(codes, size + 1))]
                else:
                    found = [(np.arange(len(places)), reducer.own(codes, size)), *reducer.neighbours(codes)]
                for k, (row, key) in enumerate(found):
                    if held is not None and k:
                        there = in_bit_map(held, key)
                        row, key = row[there], key[there]
                    if len(row):
                        at = pa.array(places[row])
                        same = np.full(len(row), k == 0)
                        yield pa.RecordBatch.from_arrays([pa.array(key), words.take(at), counts.take(at), pa.array(same)], names=["key", "word", "n", "same"])

    return task


#: Letters up to which levenshtein() verifies a pair; its time grows with the square of the length.
SHORT = 64
#: Whether ``word`` and ``other`` differ by exactly one edit. Of long words, the common prefix is found by
#: doubling steps, and what follows the edit must be equal: a few comparisons of whole words.
ONE_EDIT = f"""CASE WHEN abs(length(word) - length(other)) > 1 THEN false
  WHEN length(word) <= {SHORT} THEN levenshtein(word, other, 1) = 1
  ELSE word <> other AND aggregate(
    sequence(30, 0, -1), 0,
    (p, k) -> if(p + shiftleft(1, k) <= least(length(word), length(other))
                 AND substr(word, p + 1, shiftleft(1, k)) = substr(other, p + 1, shiftleft(1, k)), p + shiftleft(1, k), p),
    p -> substr(word, p + if(length(word) < length(other), 1, 2)) = substr(other, p + if(length(other) < length(word), 1, 2)))
  END"""
_KEYED = "key long, word string, n long, same boolean"


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every two near words once, of a stored vocabulary (word, n)."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count()
    counted = {r.c: r["count"] for r in letters.collect() if r.c}  # 58 letters at most
    words, longest = vocabulary.agg(F.count("*"), F.coalesce(F.max(F.length("word")), F.lit(0))).first()
    reducer = Reducer(alphabets(counted, words, longest))
    own = vocabulary.mapInArrow(_keyed(reducer, None), _KEYED)
    bits = bit_map(own.select("key"))
    probes = vocabulary.mapInArrow(_keyed(reducer, bits), _KEYED)
    targets = own.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    # a word's own key meets that of another word from both sides; all other keys from one
    once = (~F.col("same") | (F.col("word") < F.col("other"))) & F.expr(ONE_EDIT)
    return probes.join(targets, "key").filter(once).select("word", "n", "other", "other_n")


def variants(vocabulary: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``vocabulary`` (word, n; words distinct and in Latin-1)."""
    words = written(vocabulary.select("word", "n"))
    pairs = near_pairs(words)
    both = F.array(
        F.struct("word", F.col("other").alias("to"), F.col("other_n").alias("to_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("to"), F.col("n").alias("to_n")),
    )
    sides = pairs.select(F.explode(both).alias("s")).select("s.*")
    best = F.min(F.struct((-F.col("to_n")).alias("low"), F.col("to").alias("to")))
    near = sides.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = F.col("best.low") <= -factor * F.col("n")
    found = words.join(near, "word", "left").select(
        "word",
        F.when(formed, F.col("best.to")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, -F.col("best.low")).alias("form_n"),
    )
    found = written(found)
    roots = _roots(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, next): each round doubles the steps, until none leads further."""
    while True:
        links = written(links)
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if links.join(ahead, "root", "left_semi").isEmpty():
            return links
        links = links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, of which some have lost a letter."""
    return variants(vocabulary(table(spark, sf_dir, "documents", "doc_id", "text"), damage=DAMAGE))
