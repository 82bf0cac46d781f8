"""Global (un-partitioned) ranks and running sums that scale.

``NTILE(k) OVER (ORDER BY ...)`` and a running ``SUM ... ROWS UNBOUNDED
PRECEDING`` have no PARTITION BY; Spark's Window operator then moves every
row into one task (``Exchange SinglePartition``).  Here rows are compared by one
key, a struct of the ordering columns (``order_key``), and nothing is sorted globally:

* a tile is known from its last row's key, and that row is found by exact selection
  (``keys_at``): rows are counted between ``FAN`` keys taken from a hashed sample,
  the range that holds the wanted rank is narrowed the same way until it has
  at most ``LEAF`` rows, and only those are sorted.  Every row then gets its
  tile by comparison with the k - 1 boundary keys;
* a running sum comes from a histogram: ranges of the key between sampled keys,
  their sums as offsets (a number per range), and a window inside each range.

Ranges are literals of the plan, so a recomputation after executor loss puts each
row where it was, without a checkpoint.  The sample moves range bounds only; ranks, tiles
and sums are exact.  A hot value of the first column is split by the others, since
the whole key is unique.

``Params.global_window="builtin"`` uses Spark's Window instead, with the same
result: a comparator for tests, since all rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.params import DEFAULT, Params

#: Ranges that one pass counts, and rows of a range that is sorted.
FAN, LEAF = 16, 16_384
#: Sampled keys per range bound, so that ranges are near to even.
OVERSAMPLE = 32
#: Ranges of a running sum, at most: the depth of its comparisons is the logarithm.
MAX_RANGES = 256


class By(NamedTuple):
    """One ordering column: ascending with NULLs first, unless said otherwise (descending: numbers only)."""

    column: str
    desc: bool = False
    nulls_last: bool = False


def order_key(order: Sequence[By]) -> Column:
    """One value per row that compares as ORDER BY does: a struct, in which NULL is the least."""
    parts = []
    for i, by in enumerate(order):
        value = -F.col(by.column) if by.desc else F.col(by.column)
        if by.nulls_last:
            parts.append(F.col(by.column).isNull().alias(f"n{i}"))
        parts.append(value.alias(f"v{i}"))
    return F.struct(*parts)


def _literal(key: Sequence, kind: T.StructType) -> str:
    """A collected key as SQL text, of its own types (text, since a plan of many constants is built by one call)."""
    parts = []
    for value, field in zip(key, kind.fields):
        text = str(value).replace("\\", "\\\\").replace("'", "\\'")
        parts.append(f"'{field.name}', CAST({'NULL' if value is None else f"'{text}'"} AS {field.dataType.simpleString()})")
    return f"named_struct({', '.join(parts)})"


def _sampled(keys: DataFrame, rows: int, ranges: int) -> list[Row]:
    """At most ranges - 1 keys that part ``keys`` (column key, ``rows`` rows) into near to even ranges, ascending."""
    wanted = max(1, ranges * OVERSAMPLE)
    every = max(1, rows // wanted)
    hashed = keys.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0) if every > 1 else keys
    found = [r.key for r in hashed.orderBy("key").limit(4 * wanted).collect()]
    return [found[len(found) * i // ranges] for i in range(1, ranges)] if len(found) >= ranges else found


def _range_of(key: str, bounds: Sequence[str], low: int = 0) -> str:
    """How many of the ascending bounds are below the key, by bisection (SQL text)."""
    if not bounds:
        return str(low)
    middle = len(bounds) // 2
    above = _range_of(key, bounds[middle + 1 :], low + middle + 1)
    return f"CASE WHEN {key} > {bounds[middle]} THEN {above} ELSE {_range_of(key, bounds[:middle], low)} END"


def tile_ends(rows: int, k: int) -> list[int]:
    """Rank of the last row of each tile but the last: the first rows % k tiles have a row more."""
    return [i * (rows // k) + min(i, rows % k) for i in range(1, k)]


def keys_at(keys: DataFrame, rows: int, ranks: Sequence[int]) -> list[Row | None]:
    """The keys at the given 1-based ranks of ``keys`` (column key, ``rows`` rows); None at rank 0."""
    kind = keys.schema["key"].dataType
    # (keys, rows before, rows) of the range in which each wanted rank lies
    held = {rank: (keys, 0, rows) for rank in ranks if rank}
    found: dict[int, Row | None] = {0: None}
    while held:
        rank, (inside, before, rows) = held.popitem()
        sampled = _sampled(inside, rows, FAN) if rows > LEAF else []
        if len(set(sampled)) < 2:  # a few rows, or (where keys repeat) rows that are mostly one key
            found[rank] = inside.orderBy("key").offset(rank - before - 1).limit(1).first().key
            continue
        bounds = [_literal(k, kind) for k in sampled]
        counts = dict(inside.groupBy(F.expr(_range_of("key", bounds)).alias("range")).count().collect())
        fellows = [rank, *[r for r, h in held.items() if h[0] is inside]]  # ranks of the same range: one pass
        for i in range(len(bounds) + 1):
            n = counts.get(i, 0)
            wanted = [r for r in fellows if before < r <= before + n]
            if wanted:
                part = inside.filter(f"key > {bounds[i - 1]}") if i else inside
                part = part.filter(f"key <= {bounds[i]}") if i < len(bounds) else part
                held |= {r: (part, before, n) for r in wanted}
            before += n
    return [found[r] for r in ranks]


def tile_keys(df: DataFrame, k: int, order: Sequence[By], tiles: Sequence[int] | None = None) -> list[list | None]:
    """The key of the last row of each tile of NTILE(k) OVER (ORDER BY order) (all but the last tile, unless
    named), its values as text so that they can be stored; None for a tile that ends before the first row."""
    keys, rows = df.select(order_key(order).alias("key")), df.count()
    ends = tile_ends(rows, k)
    found = keys_at(keys, rows, [ends[t - 1] for t in tiles] if tiles else ends)
    return [key and [None if v is None else str(v) for v in key] for key in found]


def above(df: DataFrame, order: Sequence[By], key: list | None) -> Column:
    """Whether a row of ``df`` is after the row of that key: a comparison with a constant."""
    own = order_key(order)
    return F.lit(True) if key is None else own > F.expr(_literal(key, df.select(own.alias("key")).schema["key"].dataType))


def with_ntile(
    df: DataFrame, k: int, order: Sequence[By], out: str, params: Params = DEFAULT, keys: list | None = None
) -> DataFrame:
    """df + ``out`` = NTILE(k) OVER (ORDER BY order); order must be a total order.  ``keys``: its ``tile_keys``, if known."""
    if params.global_window == "builtin":
        return df.withColumn(out, F.ntile(k).over(Window.orderBy(order_key(order))))
    tile = F.lit(1)
    for key in tile_keys(df, k, order) if keys is None else keys:
        if key is not None:
            tile = tile + above(df, order, key).cast("int")
    return df.withColumn(out, tile.cast("int"))


def range_sums(df: DataFrame, value: str, order: Sequence[By], ranges: int) -> dict:
    """A histogram of ``df`` by ``order``: the bounds of near to even ranges, and per range the sum and the count of
    ``value`` in the ranges before; with the total. Text and numbers only, MAX_RANGES of them at most."""
    keys = df.select(order_key(order).alias("key"))
    sampled = _sampled(keys, keys.count(), min(ranges, MAX_RANGES))
    bounds = [[None if v is None else str(v) for v in key] for key in sampled]
    text = [_literal(key, keys.schema["key"].dataType) for key in bounds]
    ranged = df.select(order_key(order).alias("key"), value).withColumn("range", F.expr(_range_of("key", text)))
    per = {r["range"]: r for r in ranged.groupBy("range").agg(F.sum(value).alias("s"), F.count(value).alias("c")).collect()}
    sums, counts, reached, seen = [], [], None, 0
    for i in range(len(bounds) + 1):
        sums.append(None if reached is None else str(reached))
        counts.append(seen)
        if i in per and per[i].s is not None:
            reached = per[i].s if reached is None else reached + per[i].s
        seen += per[i].c if i in per else 0
    return {"bounds": bounds, "sums": sums, "counts": counts, "total": None if reached is None else str(reached)}


def _ranged(df: DataFrame, order: Sequence[By], bounds: list) -> DataFrame:
    """df + _key and _range: the row's range between bounds that are constants of the plan."""
    keyed = df.withColumn("_key", order_key(order))
    text = [_literal(key, keyed.schema["_key"].dataType) for key in bounds]
    return keyed.withColumn("_range", F.expr(_range_of("_key", text)))


def with_running_sum(
    df: DataFrame,
    value: str,
    order: Sequence[By],
    out: str,
    params: Params = DEFAULT,
    total: str | None = None,
    histogram: dict | None = None,
) -> DataFrame:
    """df + ``out`` = SUM(value) OVER (ORDER BY order ROWS UNBOUNDED PRECEDING); with ``total``, also
    the sum over all rows in a column of that name.  ``histogram``: its ``range_sums``, if known."""
    if params.global_window == "builtin":
        w = Window.orderBy(order_key(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumn(out, F.sum(value).over(w))
        return df.withColumn(total, F.sum(value).over(Window.partitionBy())) if total else df
    ranges = params.window_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = range_sums(df, value, order, ranges) if histogram is None else histogram
    kind = df.groupBy().agg(F.sum(value).alias("s")).schema["s"].dataType.simpleString()
    constant = lambda v: f"CAST({'NULL' if v is None else repr(v)} AS {kind})"
    before = F.expr(f"element_at(array({', '.join(map(constant, known['sums']))}), _range + 1)")
    seen = F.expr(f"element_at(array({', '.join(f'{n}L' for n in known['counts'])}), _range + 1)")
    inside = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # SQL semantics: NULLs are skipped; the sum is NULL while no non-NULL value has been seen yet
    running = F.coalesce(before, F.lit(0)) + F.coalesce(F.sum(value).over(inside), F.lit(0))
    summed = _ranged(df, order, known["bounds"]).withColumn(out, F.when(seen + F.count(value).over(inside) > 0, running))
    if total:
        summed = summed.withColumn(total, F.expr(constant(known["total"])))
    return summed.drop("_key", "_range")
