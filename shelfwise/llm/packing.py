"""Packing by power-of-two decomposition.

A document's ids (with the end id) are cut into pieces of ``max_length`` and
then by the binary digits of the rest, longest first. Pieces of one length form
a bucket, and each piece is a sequence of its own: no sequence crosses documents
and none needs padding, since every length is a power of two.

Defined cases: a null or empty text has the end id only (one piece of length 1);
a null doc_id stays null; repeated rows are packed like any other; an empty table
gives an empty result. There is no shuffle: a lost task is computed again alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import bound_batches, giving_back
from shelfwise.llm.encoding import ChunkEncoder, word_bpe_path

END_ID = 2
MAX_LENGTH = 4096
#: Pieces handed back to Spark at a time.
OUT_IDS = 500_000

SCHEMA = "doc_id long, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long"


def pieces(n: int, max_length: int = MAX_LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; every length is a power of two."""
    out = [(s, max_length) for s in range(0, n - n % max_length, max_length)]
    at, rest = n - n % max_length, n % max_length
    while rest:
        length = 1 << (rest.bit_length() - 1)
        out.append((at, length))
        at, rest = at + length, rest - length
    return out


def pack(
    docs: DataFrame, tokenizer_path: str | None = None, max_length: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (array), ids_crc32, doc_tokens, bucket, sequence_id, offset.

    ``docs`` needs doc_id and text; other columns are not read. ``max_length`` is a power of two.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    path = tokenizer_path or word_bpe_path()
    bound_batches(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator) -> Iterator:
        encoder = ChunkEncoder(path)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                for start, length in pieces(n, max_length):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, own, zlib.crc32(own), n))
                held += n
                if held >= OUT_IDS:
                    yield _arrow(rows, with_ids)
                    rows, held = [], 0
            if rows:
                yield _arrow(rows, with_ids)

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(giving_back(cut), SCHEMA)
    return out.select(
        "doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens",
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def _arrow(rows: list[tuple], with_ids: bool):
    import numpy as np
    import pyarrow as pa

    doc_id, start, length, own, crc, n = zip(*rows)
    if with_ids:
        offsets = np.concatenate([[0], np.cumsum(length)]).astype("i4")
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(own), "<i4")))
    else:
        ids = pa.nulls(len(rows), pa.list_(pa.int32()))
    columns = [pa.array(x, pa.int64()) for x in (doc_id, start, length, crc, n)]
    return pa.RecordBatch.from_arrays([*columns[:3], ids, *columns[3:]], names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"])


def op10(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), with_ids=False).drop("ids")
