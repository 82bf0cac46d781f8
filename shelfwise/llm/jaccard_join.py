"""N-gram Jaccard self-join by vertical partitioning, and its groups.

Every document is the set of its distinct word shingles. One global order of
the shingles (rarer ones first) is cut into fragments; a candidate pair's
overlap is counted in each fragment by itself and summed per pair.

1. The global order: shingles that repeat inside a batch are counted; the most
   frequent (at most ``FREQUENT``, a fixed bound) come last, by count. The order
   decides cost only, never the result.
2. Documents with equal sets form a class; its smallest doc_id stands for it.
3. Prefixes: with overlap >= o, the first |x| - o + l shingles of both sets share
   at least l. Only these are exchanged, and only those that two classes share.
4. Candidates: first each document against the leader of each shingle's group,
   whose verified links join most copies at once; then the pairs that share l
   shingles within both prefixes and are still in different components. No link that
   could join two components is lost.
5. Verification by fragments, exact on the whole sets, then components.
6. All links: linked sets are in one component, so each component's classes are joined
   all with all. They are dealt into tiles; a task holds two tiles, adds up their
   overlaps fragment by fragment and returns how many documents each class links with.

Defined cases: a null, empty or wordless text has an empty set and links with
nothing; fewer than ``k`` words are one shingle; repeated rows fall in one class and are
one document; a row with null doc_id keeps a null component and has no links; ties change nothing; other
columns are ignored; an empty table gives an empty result. Shingles are compared
by 64-bit hashes, classes by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import bound_batches, components, giving_back, written

K, NUMERATOR, DENOMINATOR = 3, 90, 100
#: Shingles known to be frequent: a bound of what every task gets (9 bytes each).
FREQUENT = 500_000
#: Shingles two prefixes must share.
SHARED = 3
FRAGMENTS = 8
#: Classes of a tile, about; a task compares two tiles at a time.
TILE = 512
#: Columns of the matrices multiplied at a time, and pairs of a shingle up to which they are counted one by one.
COLUMNS, FEW = 2048, 64
#: Bits of the map of documents whose sets are needed (2 MB): a hint for the scan only.
MAP_BITS = 1 << 24


def least_overlap(n, numerator: int, denominator: int):
    """Smallest overlap of a linked set of size ``n`` with any other (integers, rounded up)."""
    return -((-n * numerator) // denominator)


class _Order:
    """Maps shingle hashes to positions in the global order: frequency tier above, hash below."""

    def __init__(self, frequent) -> None:
        self._h, self._tier = frequent

    def tier(self, hashes):
        """0 for rare shingles, more for frequent ones, in the bits above 55."""
        import numpy as np

        tier = np.zeros(len(hashes), np.uint64)
        if len(self._h) and len(hashes):
            at = np.minimum(np.searchsorted(self._h, hashes), len(self._h) - 1)
            known = self._h[at] == hashes
            tier[known] = self._tier[at[known]].astype(np.uint64) << np.uint64(55)
        return tier

    def __call__(self, hashes):
        """Ascending positions (int64 >= 0) of a set's hashes."""
        import numpy as np

        position = self.tier(hashes) | (hashes >> np.uint64(9))
        position.sort()
        return position.view(np.int64)


def _frequent(docs: DataFrame, k: int):
    """(hashes in ascending order, tiers): the most frequent shingles that repeat in a batch, by the bit length of their count."""
    import numpy as np

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from shelfwise.llm.words import shingle_sets

        for batch in batches:
            sets = {s.tobytes(): s for s in shingle_sets(batch.column(0).to_pylist(), k)}
            if sets:
                h, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                h, n = h[n > 1], n[n > 1]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    seen = docs.select("text").mapInArrow(giving_back(count), "h long, n long")
    top = seen.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT)
    t = top.toArrow()
    h = t.column("h").to_numpy().astype(np.int64).view(np.uint64)
    tier = np.minimum(127, 1 + np.floor(np.log2(np.maximum(1, t.column("n").to_numpy().astype(float))))).astype(np.uint8)
    by = np.argsort(h)
    return h[by], tier[by]


def _prefixes(docs: DataFrame, k: int, order, numerator: int, denominator: int) -> DataFrame:
    """(doc_id, n, hi, lo, prefix): set size, 128-bit set hash, first positions in the global order."""

    def prefix(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        from shelfwise.llm.words import shingle_sets

        rank = _Order(order.value)
        for batch in batches:
            n, hi, lo, sizes, parts = [], [], [], [0], []
            for s in shingle_sets(batch.column(1).to_pylist(), k):
                d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                own = rank(s)[: len(s) - least_overlap(len(s), numerator, denominator) + SHARED]
                n.append(len(s)), hi.append(int(d[0])), lo.append(int(d[1])), sizes.append(len(own)), parts.append(own)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype("i4")), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), lists], names=["doc_id", "n", "hi", "lo", "prefix"]
            )

    return docs.select("doc_id", "text").mapInArrow(giving_back(prefix), "doc_id long, n long, hi long, lo long, prefix array<long>")


def needed_map(ids: DataFrame) -> dict[int, bytes]:
    """A bit map of fixed size over hashes of ``ids`` (column id): every id given has its bit set."""
    bit = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    rows = ids.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return {r.bucket: bytes(r.bits) for r in rows.collect()}  # at most MAP_BITS / 32768 + 1 rows of 4 KB


def _in_map(bits: dict[int, bytes]):
    """A filter on column ``bit`` values in Python tasks; the numbering is Spark's: bucket 1 + (bit - 1) div 32768."""
    import numpy as np

    maps = {b: np.frombuffer(x, np.uint8) for b, x in bits.items()}
    size = 32768

    def test(values):
        v = np.asarray(values, np.int64)
        bucket = np.where(v > 0, 1 + (v - 1) // size, v // size)
        place = np.where(v > 0, (v - 1) % size, -v % size)
        out = np.zeros(len(v), bool)
        for b in np.unique(bucket):
            if int(b) in maps:
                m = bucket == b
                out[m] = maps[int(b)][place[m] >> 3] >> (place[m] & 7) & 1
        return out

    return test


def _fragments(docs: DataFrame, ids: DataFrame, k: int, order, hashes: bool = False) -> DataFrame:
    """(doc_id, f, part): the sets of the documents with an id in ``ids`` (and a few more), cut into fragments of the global order.

    With ``hashes``, the set's 128-bit hash too (hi, lo).
    """
    bits = docs.sparkSession.sparkContext.broadcast(needed_map(ids))

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        from shelfwise.llm.words import shingle_sets

        rank, wanted = _Order(order.value), _in_map(bits.value)
        # the first fragments share the rare tier evenly, the last has the frequent ones
        pivots = np.array([(1 << 55) * i // (FRAGMENTS - 1) for i in range(1, FRAGMENTS)], np.int64)
        for batch in batches:
            keep = wanted(batch.column(2).to_numpy())
            batch = batch.filter(pa.array(keep & batch.column(0).is_valid().to_numpy(zero_copy_only=False)))
            ids, fs, sizes, parts, digests = [], [], [0], [], []
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), k)):
                p = rank(s)
                digest = xxhash.xxh3_128_digest(s.tobytes()) if hashes else b""
                edges = [0, *np.searchsorted(p, pivots).tolist(), len(p)]
                for f, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    if b > a:
                        ids.append(doc_id), fs.append(f), sizes.append(b - a), parts.append(p[a:b]), digests.append(digest)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype("i4")), pa.array(flat))
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            named = [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())] if hashes else []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fs, pa.int32()), lists, *named], names=["doc_id", "f", "part", "hi", "lo"][: 3 + len(named)])

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)).alias("bit")
    return docs.select("doc_id", "text", bit).mapInArrow(giving_back(cut), "doc_id long, f int, part array<long>" + (", hi long, lo long" if hashes else ""))


def verified(docs: DataFrame, pairs: DataFrame, k: int, order, numerator: int, denominator: int) -> DataFrame:
    """Those of ``pairs`` (a, b, na, nb) that reach the threshold, with their overlap summed over fragments."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    parts = written(_fragments(docs, ids, k, order))
    left = pairs.join(parts.select(F.col("doc_id").alias("a"), "f", F.col("part").alias("pa")), "a")
    both = left.join(parts.select(F.col("doc_id").alias("b"), "f", F.col("part").alias("pb")), ["b", "f"])
    partial = both.select("a", "b", "na", "nb", "f", F.size(F.array_intersect("pa", "pb")).cast("long").alias("partial"))
    return (
        partial.groupBy("a", "b", "na", "nb", "f")
        .agg(F.max("partial").alias("partial"))  # a repeated row's fragments count once
        .groupBy("a", "b", "na", "nb")
        .agg(F.sum("partial").alias("overlap"))
        .filter(F.col("overlap") * denominator >= (F.col("na") + F.col("nb") - F.col("overlap")) * numerator)
    )


def _can_link(numerator: int, denominator: int):
    """Whether x and y, which share a shingle at positions px and py of their orders, can link and share it within both prefixes.

    Linked sets overlap in at least o = numerator / (numerator + denominator) of their sizes' sum.
    """
    sizes = F.least("nx", "ny") * denominator >= F.greatest("nx", "ny") * numerator
    o = F.ceil((F.col("nx") + F.col("ny")) * numerator / (numerator + denominator))
    return sizes & (F.col("x") != F.col("y")) & (F.col("px") < F.col("nx") - o + SHARED) & (F.col("py") < F.col("ny") - o + SHARED)


def _candidates(df: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Rows (x, nx, y, ny), one per shared shingle, as pairs (a, b, na, nb) that share enough of them."""
    low = F.col("x") < F.col("y")
    df = df.select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(low, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(low, F.col("ny")).otherwise(F.col("nx")).alias("nb")
    )
    enough = F.least(F.lit(SHARED), F.ceil((F.col("na") + F.col("nb")) * numerator / (numerator + denominator)))
    return df.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).filter(F.col("shared") >= enough).drop("shared")


def _add_overlaps(out, left, right, rows, columns) -> None:
    """Adds to ``out[rows[i], columns[j]]`` how many values ``left[i]`` and ``right[j]`` (lists of distinct values) share."""
    import numpy as np

    def of_both(values, of):
        at = np.searchsorted(both, values)
        keep = both[np.minimum(at, len(both) - 1)] == values
        at, of = at[keep], of[keep]
        by = np.argsort(at, kind="stable")
        return at[by], of[by], np.bincount(at, minlength=len(both))

    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right)]
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if not len(both):
        return
    a, row, in_left = of_both(np.concatenate(left), np.repeat(rows, sizes[0]))
    b, column, in_right = of_both(np.concatenate(right), np.repeat(columns, sizes[1]))
    few = in_left * in_right <= FEW
    some = few[a]
    each = in_right[a[some]]
    start = (np.cumsum(in_right) - in_right)[a[some]]
    np.add.at(out, (np.repeat(row[some], each), column[np.arange(each.sum()) + np.repeat(start - (np.cumsum(each) - each), each)]), 1)
    # values of many sets: products of 0/1 matrices, whose sums float32 holds exactly
    number = np.cumsum(~few) - 1
    a, row, b, column = number[a[~some]], row[~some], number[b[~few[b]]], column[~few[b]]
    for low in range(0, int((~few).sum()), COLUMNS):
        x, y = np.zeros((out.shape[0], COLUMNS), np.float32), np.zeros((out.shape[1], COLUMNS), np.float32)
        for matrix, at, of in ((x, a, row), (y, b, column)):
            begin, end = np.searchsorted(at, [low, low + COLUMNS])
            matrix[of[begin:end], at[begin:end] - low] = 1
        out += (x @ y.T).astype(out.dtype)


class _Cell:
    """Two tiles of one component, or one with itself, while their fragments come in."""

    def __init__(self) -> None:
        import numpy as np

        # for each side: class by its hash, and what is known of it
        self.number: list[dict] = [{}, {}]
        self.facts: list[list] = [[], []]
        self.overlap = np.zeros((TILE, TILE), np.int32)

    def add(self, rows: list[tuple]) -> None:
        """``rows`` of one fragment: (sides, class, (size, rep, documents), values); a repeated row counts once."""
        import numpy as np

        sides: list[dict] = [{}, {}]
        for on, name, facts, values in rows:
            for side in on:
                at = self.number[side].setdefault(name, len(self.number[side]))
                if at == len(self.facts[side]):
                    self.facts[side].append(facts)
                sides[side][at] = values
        if not (sides[0] and sides[1]):
            return
        grown = np.zeros([max(n, len(f)) for n, f in zip(self.overlap.shape, self.facts)], np.int32)
        grown[: self.overlap.shape[0], : self.overlap.shape[1]] = self.overlap
        self.overlap = grown
        _add_overlaps(self.overlap, list(sides[0].values()), list(sides[1].values()), np.array([*sides[0]]), np.array([*sides[1]]))

    def links(self, numerator: int, denominator: int, alone: bool) -> Iterator[tuple]:
        """(class, documents of the other side that it links with), of the left side only where both are one tile (``alone``)."""
        import numpy as np

        if not (self.facts[0] and self.facts[1]):
            return
        (n, rep, copies), (other_n, other_rep, other_copies) = (np.array(x, np.int64).T for x in self.facts)
        overlap = self.overlap[: len(n), : len(other_n)].astype(np.int64)
        linked = overlap * denominator >= (n[:, None] + other_n - overlap) * numerator
        linked &= rep[:, None] != other_rep
        yield from zip(self.number[0], np.where(linked, other_copies, 0).sum(axis=1).tolist())
        if not alone:
            yield from zip(self.number[1], np.where(linked, copies[:, None], 0).sum(axis=0).tolist())


def _link_counts(docs: DataFrame, members: DataFrame, k: int, order, numerator: int, denominator: int) -> DataFrame:
    """(hi, lo, links) of ``members`` (component, hi, lo, rep, n, copies): the documents of other classes of its component that a class links with."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def counted(cell, at):
            found = [(*name, links) for name, links in cell.links(numerator, denominator, at[1] == at[2]) if links]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)] if found else [pa.array([], pa.int64())] * 3, names=["hi", "lo", "links"])

        cell, at, held, fragment = _Cell(), None, [], None
        for batch in batches:
            *columns, parts = (batch.column(i) for i in range(11))
            edges, values = parts.offsets.to_numpy(), parts.values.to_numpy()
            for x, (component, i, j, f, tile, hi, lo, *facts) in enumerate(zip(*(c.to_pylist() for c in columns))):
                if (at, fragment) != ((component, i, j), f):
                    cell.add(held)
                    held, fragment = [], f
                    if at and at != (component, i, j):
                        yield counted(cell, at)
                        cell = _Cell()
                    at = component, i, j
                held.append(([side for side in (0, 1) if tile == at[1 + side]], (hi, lo), facts, values[edges[x] : edges[x + 1]]))
        cell.add(held)
        if at:
            yield counted(cell, at)

    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = members.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("hi", "lo"), F.col("tiles")).cast("int"))
    parts = _fragments(docs, members.select(F.col("rep").alias("id")), k, order, hashes=True).withColumnRenamed("doc_id", "rep")
    cells = parts.join(dealt, ["rep", "hi", "lo"]).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = cells.select("component", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"), "f", "tile", "hi", "lo", "n", "rep", "copies", "part")
    sorted_cells = cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "f")
    return sorted_cells.mapInArrow(giving_back(count), "hi long, lo long, links long").groupBy("hi", "lo").agg(F.sum("links").alias("links"))


def link_components(docs: DataFrame, k: int = K, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, links: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept_links.

    Two documents link when ``denominator * |intersection| >= numerator * |union|``;
    component_id is the smallest doc_id reachable by links; ``kept_links`` counts all
    other documents that it links with, copies included. Without ``links``, that
    column and the joins inside components that it takes are left out.
    """
    import math

    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = spark.sparkContext.broadcast(_frequent(docs, k))
    sets = written(_prefixes(docs, k, order, numerator, denominator))
    classes = sets.filter("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    rows = classes.filter("rep is not null").select("rep", "n", F.posexplode("prefix").alias("p", "h"))
    # the leader has the fewest rarer shingles: of edited copies, the least edited
    lead = rows.groupBy("h").agg(F.min(F.struct("p", "rep", "n")).alias("lead"), F.count("*").alias("group")).filter("group > 1")
    shared = written(rows.join(lead.select("h", F.col("lead.p").alias("px"), F.col("lead.rep").alias("x"), F.col("lead.n").alias("nx")), "h"))
    star = shared.select("x", "nx", "px", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("p").alias("py")).filter(_can_link(numerator, denominator))
    star = _candidates(star, numerator, denominator)
    edges = written(verified(docs, written(star), k, order, numerator, denominator).select("a", "b"))

    # what is left: pairs in one group whose ends the links so far don't join
    joined = components(edges)
    own = shared.select("h", "rep", "n", "p").join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = own.groupBy("h").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p <> q").select("h")
    # sizes that can link are at most one size class apart
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(denominator / numerator) + 1e-9).cast("int")
    open_rows = written(own.join(mixed, "h").withColumn("c", size_class))
    near = open_rows.select("h", F.explode(F.array(F.col("c"), F.col("c") + 1)).alias("c"), F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("p").alias("px"), F.col("component").alias("cx"))
    far = open_rows.select("h", "c", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("p").alias("py"), F.col("component").alias("cy"))
    once = F.expr("cx <> cy and (nx < ny or (nx = ny and x < y))")
    rest = _candidates(near.join(far, ["h", "c"]).filter(once & _can_link(numerator, denominator)), numerator, denominator)
    more = written(verified(docs, written(rest), k, order, numerator, denominator).select("a", "b"))

    final = components(edges.unionAll(more)).select(F.col("id").alias("rep"), "component")
    named = classes.select("hi", "lo", "rep").join(final, "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("component"))
    counted = []
    if links:
        copies = sets.filter("n > 0 and doc_id is not null").select("hi", "lo", "doc_id").distinct().groupBy("hi", "lo").agg(F.count("*").alias("copies"))
        members = written(classes.select("hi", "lo", "rep", "n").join(final, "rep").join(copies, ["hi", "lo"]))
        others = written(_link_counts(docs, members, k, order, numerator, denominator))
        named = named.join(copies, ["hi", "lo"], "left").join(others, ["hi", "lo"], "left")
        all_links = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0))
        counted = [F.when(F.col("doc_id").isNotNull(), all_links).otherwise(0).cast("long").alias("kept_links")]
    return sets.select("doc_id", "n", "hi", "lo").join(named, ["hi", "lo"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        *counted,
    )


def keep_one(docs: DataFrame, k: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """``docs`` with one document of each group: the one of smallest doc_id (a row with null doc_id stays)."""
    groups = link_components(docs, k, numerator, denominator, links=False)
    keep = groups.filter("doc_id = component_id").select("doc_id").distinct()
    return docs.filter("doc_id is null").unionByName(docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns))


def op7(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    return link_components(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept_links")
