"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded and convolved by learned filters (16 bytes wide, every 8
bytes); each overlapping chunk of 512 bytes is max-pooled over its positions and
scored; a document's score combines the mean, largest and smallest chunk logit
over chunks that cover its whole text.

Fitting uses a bounded sample of labelled rows (``SAMPLE`` documents, the first
by a hash of doc_id, ``CHUNKS`` evenly spread chunks of each); scoring reads every
byte. Only the text enters a score.

Defined cases: null and empty texts are one blank chunk and get its score;
labels that are null take no part; without labelled rows every score is 0.5;
with one class only, the smoothed share of that class; repeated rows are scored
each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.llm.common import bound_batches, free_name, giving_back

#: Labelled documents used for fitting, at most, and chunks of each.
SAMPLE, CHUNKS = 6000, 6
THRESHOLD = 0.3
BLOCK, HALF, EMBED, FILTERS = 8, 32, 8, 24
CHUNK_BYTES = 2 * HALF * BLOCK
EPOCHS, RATE, MINIBATCH = 6, 4e-3, 64
#: Padded bytes scored at a time.
SCORED_BYTES = 1 << 20


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


class ByteNet:
    """Parameters and forward pass of the network."""

    def __init__(self, seed: int = 7) -> None:
        import numpy as np

        rng = np.random.default_rng(seed)
        self.embed = (rng.standard_normal((256, EMBED)) * 0.5).astype(np.float32)
        self.embed[0] = 0
        self.filters = (rng.standard_normal((2, BLOCK * EMBED, FILTERS)) / np.sqrt(BLOCK * EMBED)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = (rng.standard_normal(FILTERS) * 0.3).astype(np.float32)
        self.out_bias = np.float32(0)
        #: document logit = combine . (1, mean, max, min of the chunk logits)
        self.combine = np.array([0, 1, 0, 0], float)
        self.constant: float | None = None

    def convolved(self, data, last):
        """ReLU filter outputs at every block of ``data`` (blocks, BLOCK); blocks in ``last`` see no block after them."""
        import numpy as np

        x = self.embed[data].reshape(len(data), BLOCK * EMBED)
        y = x @ self.filters[0] + self.bias
        after = x @ self.filters[1]
        y[:-1] += after[1:]
        if last is not None:
            stop = last[last < len(data) - 1]
            y[stop] -= after[stop + 1]
        return np.maximum(y, 0, out=y), x

    def score(self, texts: list[bytes]) -> list[float]:
        import numpy as np

        if self.constant is not None:
            return [self.constant] * len(texts)
        scores: list[float] = []
        unit = HALF * BLOCK
        group: list[bytes] = []
        held = 0
        for i, raw in enumerate(texts):
            raw = raw + b"\0" * (unit - len(raw) % unit)
            group.append(raw)
            held += len(raw)
            if held >= SCORED_BYTES or i == len(texts) - 1:
                scores += self._scores(group)
                group, held = [], 0
        return scores

    def _scores(self, padded: list[bytes]) -> list[float]:
        import numpy as np

        unit = HALF * BLOCK
        sizes = np.array([len(r) // unit for r in padded])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, BLOCK)
        halves = []
        step = SCORED_BYTES // BLOCK  # a very long text passes in parts, with one block of overlap
        last = ends * HALF - 1
        for a in range(0, len(data), step):
            b = min(len(data), a + step)
            part = data[a : b + 1]
            y, _ = self.convolved(part, last[(last >= a) & (last < b)] - a)
            halves.append(y[: b - a].reshape(-1, HALF, FILTERS).max(axis=1))
        halves = np.concatenate(halves)
        start = ends - sizes
        pooled = np.maximum(halves, np.concatenate([halves[1:], halves[-1:]]))
        pooled[ends - 1] = halves[ends - 1]
        logits = pooled @ self.out + self.out_bias
        # the last half alone is a chunk only where it is the whole text
        many = sizes > 1
        stop = np.where(many, ends - 1, ends)
        at = np.stack([start, stop], 1).ravel()
        logits = np.append(logits, 0.0)
        mean = np.add.reduceat(logits, at)[::2] / (stop - start)
        top, low = np.maximum.reduceat(logits, at)[::2], np.minimum.reduceat(logits, at)[::2]
        z = self.combine[0] + self.combine[1] * mean + self.combine[2] * top + self.combine[3] * low
        # float32 sums differ in the last bits with a text's place in its batch
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 5).tolist()


def fit(chunks: list[bytes], labels, docs) -> ByteNet:
    """Adam on the chunks' log-loss against their document's label, then a logistic fit of the combination.

    ``chunks`` have CHUNK_BYTES each (zero-padded), ``docs`` numbers each chunk's document.
    """
    import numpy as np

    net = ByteNet()
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.constant = float((y.sum() + 1) / (len(y) + 2))
        return net
    data = np.frombuffer(b"".join(chunks), np.uint8).reshape(len(chunks), 2 * HALF, BLOCK)
    rng = np.random.default_rng(11)
    params = {"embed": net.embed, "filters": net.filters, "bias": net.bias, "out": net.out, "out_bias": np.zeros(1, np.float32)}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    net.out_bias = params["out_bias"][0] = np.float32(np.log(y.mean() / (1 - y.mean())))
    steps, total = 0, EPOCHS * ((len(y) + MINIBATCH - 1) // MINIBATCH)
    every = np.arange(1, MINIBATCH + 1) * 2 * HALF - 1
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(y), MINIBATCH):
            pick = order[a : a + MINIBATCH]
            m = len(pick)
            part = data[pick].reshape(-1, BLOCK)
            conv, x = net.convolved(part, every[:m])
            conv = conv.reshape(m, 2 * HALF, FILTERS)
            where = conv.argmax(axis=1)
            pooled = np.take_along_axis(conv, where[:, None, :], axis=1)[:, 0, :]
            p = 1 / (1 + np.exp(-(pooled @ net.out + params["out_bias"][0])))
            g = ((p - y[pick]) / m).astype(np.float32)
            grads = {"out": pooled.T @ g, "out_bias": np.array([g.sum()], np.float32)}
            down = g[:, None] * net.out[None, :] * (pooled > 0)
            dconv = np.zeros_like(conv)
            np.put_along_axis(dconv, where[:, None, :], down[:, None, :], axis=1)
            grads["bias"] = down.sum(axis=0)
            dnext = np.zeros_like(dconv)
            dnext[:, 1:] = dconv[:, :-1]
            dconv, dnext = dconv.reshape(-1, FILTERS), dnext.reshape(-1, FILTERS)
            grads["filters"] = np.stack([x.T @ dconv, x.T @ dnext])
            dx = (dconv @ net.filters[0].T + dnext @ net.filters[1].T).reshape(-1, EMBED)
            flat = part.ravel()
            grads["embed"] = np.stack([np.bincount(flat, dx[:, j], 256) for j in range(EMBED)], 1).astype(np.float32)
            grads["embed"][0] = 0
            steps += 1
            rate = RATE * (1 - steps / (total + 1))
            for k, v in params.items():
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                v -= rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
            net.out_bias = params["out_bias"][0]
    # document level: logistic regression by Newton steps, lightly regularised
    conv = np.concatenate([net.convolved(data[a : a + 256].reshape(-1, BLOCK), np.arange(1, len(data[a : a + 256]) + 1) * 2 * HALF - 1)[0].reshape(-1, 2 * HALF, FILTERS).max(axis=1) for a in range(0, len(data), 256)])
    logit = conv @ net.out + net.out_bias
    ids, own = np.unique(docs, return_inverse=True)
    n = np.bincount(own)
    top, low = np.full(len(ids), -np.inf), np.full(len(ids), np.inf)
    np.maximum.at(top, own, logit), np.minimum.at(low, own, logit)
    x = np.stack([np.ones(len(ids)), np.bincount(own, logit) / n, top, low], 1)
    target = np.bincount(own, y) / n
    w = net.combine
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + 1e-2 * (w - [0, 1, 0, 0])
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(4), gradient)
    net.combine = w
    return net


def sample_chunks(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, label, chunk): evenly spread chunks of the sampled labelled documents outside the held-out fold."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
    picked = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)

    def chunks(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, ys, own = [], [], []
            for doc_id, label, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = (text or "").encode()
                room = max(0, len(raw) - CHUNK_BYTES)
                n = min(CHUNKS, 1 + room // (CHUNK_BYTES // 2))
                for i in range(n):
                    at = room * i // max(1, n - 1)
                    ids.append(doc_id), ys.append(label), own.append(raw[at : at + CHUNK_BYTES].ljust(CHUNK_BYTES, b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(own, pa.binary())], names=["doc_id", "label", "chunk"])

    # the sample has at most ``limit`` rows of 12 bytes
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    return texts.select("doc_id", "label", "text").mapInArrow(giving_back(chunks), "doc_id long, label int, chunk binary")


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> ByteNet:
    import numpy as np

    bound_batches(docs.sparkSession)
    t = sample_chunks(docs, labels, limit).toArrow()
    rows = sorted(zip(t.column("doc_id").to_pylist(), t.column("label").to_pylist(), t.column("chunk").to_pylist()))
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], float), np.array([r[0] for r in rows], np.int64))


def scored(docs: DataFrame, net: ByteNet, name: str = "score") -> DataFrame:
    """``docs`` (doc_id, text, any others but ``name``) with column ``name``, one row each."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(net)  # some 30 KB

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield batch.append_column(name, pa.array(shared.value.score(texts), pa.float64()))

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(giving_back(score), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def without_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that the classifier scores below ``threshold``."""
    name = free_name(docs.columns, "score")
    return scored(docs, train(docs, labels), name).filter(F.col(name) >= threshold).select(docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    out = scored(docs, net)
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
