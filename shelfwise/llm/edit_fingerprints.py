"""Document fingerprints by randomised edit embedding.

A shared random walk reads a text: at step j it emits the character under it and then
stays or moves on by a random bit that depends on j and that character alone. Walks over
texts a few edits apart meet again, so edit distance becomes Hamming distance of what
is emitted. A fingerprint keeps sampled steps of the walk, four bits of each: the steps
whose shared random rank is below a bound that halves with each doubling of length, so
that fingerprints of any two lengths have steps in common.

``near_duplicates`` cuts fingerprints into bands of sampled steps, as wide as ``RECALL``
at the threshold allows, and verifies every two different fingerprints of a band by likeness.

Defined cases: a null text is empty; the fingerprint of an empty text holds no step, two
empty texts are alike (1) and an empty and a non-empty one are not (0); equal texts have
equal fingerprints; rows of one doc_id follow each other by their text's hash; a null
doc_id sorts first; a single row is its own next document; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import bound_batches, written

#: Sampled steps of a walk, on average, and the walk's steps per character of the length class.
SAMPLES, STEPS = 256, 2
#: Documents whose doc_ids share a block are read in order by one task.
BLOCK = 1024
#: Rows walked side by side.
BATCH = 4000
#: Fewer walks than this go one by one.
FEW = 24
PERIOD = 4096
#: Least share of pairs at the threshold, whose unlike steps lie anywhere, that share a band.
RECALL = 0.98
_PAD = "-"


@lru_cache(maxsize=64)
def sampled_steps(size_class: int):
    """Steps sampled for texts of up to 2 ** size_class characters, ascending."""
    import numpy as np

    from shelfwise.llm.words import mix

    total = STEPS << size_class
    bound = np.uint64(min(2**64 - 1, SAMPLES * 2**64 // total))
    found = []
    for a in range(0, total, 1 << 22):
        j = np.arange(a, min(total, a + (1 << 22)), dtype=np.uint64)
        found.append(j[mix(j + np.uint64(0x632BE59BD9B4E019)) <= bound].astype(np.int64))
    return np.concatenate(found)


@lru_cache(maxsize=1)
def _moves():
    """moves[j mod PERIOD][symbol]: stay or move on; the symbol after the end never moves."""
    import numpy as np

    moves = np.random.default_rng(20).integers(0, 2, (PERIOD, 256), np.uint8)
    moves[:, 0] = 0
    return moves, [bytes(x) for x in moves]


def _symbols(text: str):
    """Characters as 1..255 (equal characters alike, nearby scripts apart), with the end's 0 after them."""
    import numpy as np

    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    out = np.zeros(len(code) + 1, np.uint8)
    out[:-1] = 1 + (code * 167 + (code >> 8) * 59) % 255
    return out


def size_class(n: int) -> int:
    return max(0, (n - 1).bit_length())


def fingerprints(texts: list[str]) -> list[str]:
    """Length in eight hex digits, then a hex digit for each sampled step of the length class, ``-`` where the walk is over."""
    import numpy as np

    moves, rows = _moves()
    out = [""] * len(texts)
    groups: dict[int, list[int]] = {}
    for i, text in enumerate(texts):
        groups.setdefault(size_class(len(text)), []).append(i)
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    for c, members in groups.items():
        steps = sampled_steps(c)
        lanes = [_symbols(texts[i]) for i in members]
        seen = np.zeros((len(members), len(steps)), np.uint8)
        if len(members) < FEW:
            for lane, line in zip(lanes, seen):
                data, at, j = lane.tobytes(), 0, 0
                last = len(data) - 1
                for k, step in enumerate(steps.tolist()):
                    while j < step:
                        at += rows[j % PERIOD][data[at]]
                        j += 1
                    line[k] = data[at]
                    if at == last:
                        break
        else:
            flat = np.concatenate(lanes)
            at = np.concatenate([[0], np.cumsum([len(x) for x in lanes])[:-1]])
            j = 0
            for k, step in enumerate(steps.tolist()):
                while j < step:
                    at += moves[j % PERIOD][flat[at]]
                    j += 1
                now = flat[at]
                seen[:, k] = now
                if not now.any():
                    break
        shown = np.where(seen > 0, digits[seen & 15], np.uint8(ord(_PAD)))
        for i, line in zip(members, shown):
            out[i] = f"{len(texts[i]):08x}" + line.tobytes().decode()
    return out


def _common(a: str, b: str):
    """What two fingerprints hold at the steps both have sampled, as byte arrays."""
    import numpy as np

    ca, cb = size_class(int(a[:8], 16)), size_class(int(b[:8], 16))
    x, y = (np.frombuffer(f[8:].encode(), np.uint8) for f in (a, b))
    if ca == cb:
        return x, y
    if ca > cb:
        y, x = _common(b, a)
        return x, y
    few, many = sampled_steps(cb), sampled_steps(ca)
    # steps of the longer class within the shorter's walk; beyond it, the shorter text is over
    own = np.full(len(few), ord(_PAD), np.uint8)
    inside = few < STEPS << ca
    own[inside] = x[np.searchsorted(many, few[inside])]
    return own, y


def likeness(a: str, b: str) -> float:
    """Share of common steps, where either walk is not over, that hold the same (0 to 1)."""
    if a == b:
        return 1.0
    x, y = _common(a, b)
    open_steps = (x != ord(_PAD)) | (y != ord(_PAD))
    n = int(open_steps.sum())
    return float(((x == y) & open_steps).sum() / n) if n else 0.0


def _first_of_next_block(docs: DataFrame) -> DataFrame:
    """For each block, the first document of the next block with documents (of the first block, after the last)."""
    firsts = written(docs.groupBy("block").agg(F.min(F.struct("place", "text_hash", "text")).alias("f")))
    # neighbours in two levels, so that no window spans all blocks
    ids = firsts.select("block", F.floor(F.col("block") / BLOCK).alias("top"))
    tops = ids.groupBy("top").agg(F.min("block").alias("first"))
    tops = tops.withColumn("after", F.lead("first").over(Window.orderBy("top"))).crossJoin(F.broadcast(ids.agg(F.min("block").alias("start"))))  # one row
    after = F.coalesce(F.lead("block").over(Window.partitionBy("top").orderBy("block")), F.col("after"), F.col("start"))
    after = ids.join(tops, "top").select(after.alias("next"), F.col("block").alias("for_block"))
    return after.join(firsts, F.col("next") == F.col("block")).select(F.col("for_block").alias("block"), F.lit(None).cast("long").alias("doc_id"), "f.place", "f.text_hash", "f.text", F.lit(True).alias("halo"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): fingerprints of its text and of its edited text, and their likeness.

    The edited text ends in the next document's beginning instead of its own last quarter.
    """
    bound_batches(docs.sparkSession, BATCH)
    place = F.coalesce("doc_id", F.lit(-(2**63)))
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("place", place).withColumn("text_hash", F.xxhash64("text")).withColumn("block", F.floor(F.col("place") / BLOCK))
    rows = docs.select("block", "doc_id", "place", "text_hash", "text", F.lit(False).alias("halo")).unionByName(_first_of_next_block(docs))
    rows = rows.repartition("block").sortWithinPartitions("block", "halo", "place", "text_hash")

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None  # the row that waits for its next
        for batch in batches:
            ids, texts, nexts = [], [], []
            for block, doc_id, text, halo in zip(*(x.to_pylist() for x in batch.columns)):
                if held is not None:
                    ids.append(held[1]), texts.append(held[2]), nexts.append(text)
                held = None if halo else (block, doc_id, text)
            if not ids:
                continue
            edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, nexts)]
            different = list(dict.fromkeys([*texts, *nexts, *edited]))
            known = dict(zip(different, fingerprints(different)))
            own, other, after = ([known[t] for t in x] for x in (texts, edited, nexts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(own), pa.array(other),
                    pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, after)], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return rows.select("block", "doc_id", "text", "halo").mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def band_width(steps: int, least: float) -> int:
    """The most steps a band may have for ``RECALL`` at likeness ``least``, among ``steps`` in all."""
    width = 1
    while width < steps and 1 - (1 - least ** (width + 1)) ** (steps // (width + 1)) >= RECALL:
        width += 1
    return width


def near_duplicates(found: DataFrame, least: float = 0.8, bands: int | None = None) -> DataFrame:
    """(a, b, likeness), a < b: every two documents of ``found`` (doc_id, fingerprint) that share a band and are alike.

    Every fingerprint gives bands under its own length class and the next one, so that
    texts on both sides of a class boundary meet. Equal fingerprints are one class: each of
    its documents comes with its smallest doc_id, at likeness 1, and that one stands for
    the class in other pairs. Rows with null doc_id take no part.
    """

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc_id, f in zip(*(x.to_pylist() for x in batch.columns)):
                c, own = size_class(int(f[:8], 16)), np.frombuffer(f[8:].encode(), np.uint8)
                for use in (c, c + 1):
                    steps = sampled_steps(use)
                    steps = steps[steps < STEPS << c]
                    line = own[np.searchsorted(sampled_steps(c), steps)].tobytes()
                    width = max(1, len(sampled_steps(use)) // bands) if bands else band_width(len(steps), least)
                    for b in range(0, len(line) - width + 1, width):
                        part = line[b : b + width]
                        if part.strip(_PAD.encode()):
                            out.append((doc_id, f, f"{use}/{b}/{part.decode()}"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))], names=["b", "fb", "band"])

    @F.pandas_udf("double")
    def alike(a, b):
        import pandas as pd

        return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype=float)

    found = written(found.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "fingerprint").distinct())
    classes = found.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    equal = found.join(classes, "fingerprint").filter("doc_id > first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("likeness"))
    rows = written(classes.select("first", "fingerprint").mapInArrow(cut, "b long, fb string, band string"))
    pairs = rows.select(F.col("b").alias("a"), F.col("fb").alias("fa"), "band").join(rows, "band").filter("a < b").select("a", "fa", "b", "fb").distinct()
    near = pairs.withColumn("likeness", alike("fa", "fb")).filter(F.col("likeness") >= least)
    return near.select("a", "b", "likeness").unionAll(equal).groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def op8(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    return fingerprint(table(spark, sf_dir, "documents", "doc_id", "text"))
