"""Approximate nearest neighbours (largest inner product) by multi-index hashing.

Vectors are lifted to one more dimension so that inner product orders as angle,
centred, turned by learned rotations (iterative quantisation) and cut to signs:
``ROTATIONS`` bits per dimension. Codes are split into substrings, each with its own
buckets. Within radius r, one of m substrings differs by at most r / m bits, so
probing the buckets near each substring retrieves every code in the radius; these
are ranked by inner products of the original vectors.

Rotations and radius are fitted on at most ``SAMPLE`` vectors: the radius is the
least that holds ``TARGET`` of the sample's own nearest pairs. All rows are indexed,
in blocks; all queries meet every block. Of equal vectors only the first k + 1 ids
are indexed, since no answer can hold more.

Defined cases: vectors that are null, empty, zero or hold null or non-finite parts
take no part, nor do rows without id and vectors of another than the commonest
dimension; repeated rows count once; a query never finds its own id; equal scores go
by smaller id; fewer than k candidates give all of them; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import written

ROTATIONS, SUBSTRING = 2, 8
SAMPLE, TARGET, SEED = 8000, 0.985, 5
#: Rows and queries of a block.
ROWS, QUERIES = 16_384, 2_048


@dataclass
class Coder:
    """Binary codes of vectors; ``largest`` is the largest norm of the table."""

    largest: float
    mean: object
    turns: list
    radius: int

    def lifted(self, x, as_query: bool):
        import numpy as np

        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if as_query:
            return np.hstack([x / norm, np.zeros_like(norm)])
        x = x / self.largest
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (norm / self.largest) ** 2))])

    def codes(self, x, as_query: bool):
        """Packed bits, uint8 (n, bytes)."""
        import numpy as np

        z = self.lifted(x, as_query) - self.mean
        return np.packbits(np.hstack([z @ t > 0 for t in self.turns]), axis=1)


def distances(a, b):
    """Hamming distances of one code to many (packed bytes)."""
    import numpy as np

    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def fit(sample, largest: float, k: int, seed: int = SEED) -> Coder:
    import numpy as np

    rng = np.random.default_rng(seed)
    coder = Coder(largest, 0.0, [], 0)
    z = coder.lifted(sample, False)
    coder.mean = z.mean(axis=0)
    z = z - coder.mean
    for _ in range(ROTATIONS):
        turn = np.linalg.qr(rng.standard_normal((z.shape[1], z.shape[1])))[0]
        for _ in range(20):
            u, _, v = np.linalg.svd(z.T @ np.sign(z @ turn))
            turn = u @ v
        coder.turns.append(turn)
    codes = coder.codes(sample, False)
    found = []
    for i in rng.permutation(len(sample))[:300]:
        score = sample @ sample[i]
        score[i] = -np.inf
        near = np.argpartition(-score, min(k, len(score) - 1))[:k]
        found.append(distances(coder.codes(sample[i : i + 1], True)[0], codes[near[near != i]]))
    found = np.sort(np.concatenate(found))
    coder.radius = int(found[min(len(found) - 1, int(TARGET * len(found)))]) if len(found) else 8 * codes.shape[1]
    return coder


class Index:
    """Buckets of each substring of a block of codes."""

    def __init__(self, codes) -> None:
        import numpy as np

        self.codes = codes
        self.tables = []
        for s in range(codes.shape[1]):
            order = np.argsort(codes[:, s], kind="stable")
            values, counts = np.unique(codes[:, s], return_counts=True)
            self.tables.append((values, counts, order))

    def within(self, code, radius: int):
        """Rows whose code is at most ``radius`` bits from ``code``, by probing every substring."""
        import numpy as np

        m = len(self.tables)
        reach, rest = divmod(radius, m)
        hit = np.zeros(len(self.codes), bool)
        for s, (values, counts, order) in enumerate(self.tables):
            # radius = m * reach + rest: one of the first rest + 1 substrings is within reach, or another within reach - 1
            near = np.bitwise_count(values ^ code[s]) <= (reach if s <= rest else reach - 1)
            hit[order[np.repeat(near, counts)]] = True
        rows = np.flatnonzero(hit)
        return rows[distances(code, self.codes[rows]) <= radius]


def _usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & good)


def search(vectors: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """For each row that ``is_query`` (a condition on column vec_id) holds: its k nearest rows found.

    query_id, rank (from 1), vec_id, score (the inner product, in double precision).
    """
    import math

    import numpy as np

    out_schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    usable = written(_usable(vectors, id_column, vector_column))
    shape = usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("largest"))
    shape = shape.orderBy(F.desc("n"), "d").first()
    if shape is None:
        return spark.createDataFrame([], out_schema)
    usable = usable.filter(F.size("v") == shape.d)
    first_ids = Window.partitionBy("v").orderBy("vec_id")
    # rows repeated whole count once: rank by id, not by row
    indexed = usable.withColumn("place", F.dense_rank().over(first_ids)).filter(F.col("place") <= k + 1).select("vec_id", "v").distinct()
    indexed = written(indexed)
    sample = indexed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().column("v").combine_chunks()
    coder = fit(np.asarray(sample.flatten()).reshape(-1, shape.d).copy(), shape.largest, k)
    shared = spark.sparkContext.broadcast(coder)

    queries = usable.filter(is_query).distinct()
    blocks = max(1, math.ceil(indexed.count() / ROWS))
    query_blocks = max(1, math.ceil(queries.count() / QUERIES))
    dealt = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int"))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    cell = ["block", "query_block"]
    left = dealt(queries, query_blocks, "query_block").select("*", every(blocks, "block"))
    right = dealt(indexed, blocks, "block").select("*", every(query_blocks, "query_block"))

    def find(asked, rows):
        import pandas as pd

        found = []
        if len(asked) and len(rows):
            coder = shared.value
            x, ids = np.stack(rows["v"].to_list()), rows["vec_id"].to_numpy()
            index = Index(coder.codes(x, False))
            q, own = np.stack(asked["v"].to_list()), asked["vec_id"].to_numpy()
            for one, me, code in zip(q, own, coder.codes(q, True)):
                near = index.within(code, coder.radius)
                if len(near) <= k:  # too few in the radius: widen it to the k nearest codes
                    d = distances(code, index.codes)
                    near = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)])
                near = near[ids[near] != me]
                rough = x[near] @ one
                if len(near) > k:
                    near = near[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * (1 + np.abs(rough).max())]
                # summed alike for every row, so that equal vectors tie
                score = (x[near] * one).sum(axis=1)
                best = np.lexsort((ids[near], -score))[:k]
                found.append(pd.DataFrame({"query_id": me, "vec_id": ids[near][best], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    near = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(find, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)
