"""Stored inventory tables: the fact table and the lattice of its grains.

``store_inventory(fact, path)`` writes the fact table and every grain of
``operators.metrics.GRAINS`` under a folder once and ``open_inventory(spark, path)``
reads them in any later application; every report then reads the smallest grain that
answers it instead of scanning the fact table. ``inventory_data(spark, sf_dir)`` does so
for the fact table derived from the source tables, in a folder of the application
(a table there is written when a report first reads it) under ``spark.checkpoint.dir`` (a shared folder on a cluster).  Where that
setting is missing, a local session (tests) gets a folder of its own and a
cluster an error.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import threading
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfwise.params import DEFAULT, Params
from shelfwise.schema import COLUMNS, INVENTORY_SCHEMA, PAIR
from shelfwise.schema import GRAIN as KEY
from shelfwise.sources.derive import keyed_days, source_frames, with_measures

#: Grains written side by side: most are small, so their jobs leave cores free.
WRITERS = 6
#: Rows of a shuffle partition or scan task, about: wide aggregates of so many groups stay in a task's memory.
ROWS_PER_PARTITION = 500_000

_LOCK = threading.Lock()
_PATHS: dict[tuple[str, str], str] = {}
# One DataFrame handle per stored (immutable) table and application, like a
# catalog entry: its schema and file listing are resolved once instead of by
# a schema-inference job on every read.
_FRAMES: dict[tuple[str, str], DataFrame] = {}
_ROWS: dict[tuple[str, str], int] = {}


def _context(spark: SparkSession):
    """The SparkContext of a classic session (None on a remote session)."""
    try:
        return spark.sparkContext
    except Exception:
        return None


def app_id(spark: SparkSession) -> str:
    sc = _context(spark)
    return sc.applicationId if sc is not None else spark.conf.get("spark.app.id", "remote")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session; only a local session may lack the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if not root:
        master = sc.master if sc is not None else "remote"
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-")
        sc.setCheckpointDir(root)
    return root


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure ``DataFrame.checkpoint`` has a reliable target folder."""
    sc = _context(spark)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_root(spark))


def scratch_path(spark: SparkSession, *parts: str) -> str:
    return "/".join([checkpoint_root(spark).rstrip("/"), f"shelfwise-{app_id(spark)}", *parts])


def _label(sf_dir: str) -> tuple[str, str]:
    """The folder's full path and a name that no other path has."""
    sf_dir = os.path.abspath(sf_dir) if "://" not in sf_dir else sf_dir.rstrip("/")
    return sf_dir, hashlib.sha256(sf_dir.encode()).hexdigest()[:24]


def sized_session(spark: SparkSession, rows: int) -> SparkSession:
    """A session of this application for jobs over ``rows`` rows: the caller's settings, but at least a partition per
    ROWS_PER_PARTITION rows, so that no task's share grows with the input.  AQE joins small partitions, up to 16 MB:
    sorted keys compress to a few bytes, so its default of 64 MB is more rows than a task sorts in memory."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    wanted = -(-rows // ROWS_PER_PARTITION)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        own.conf.set("spark.sql.shuffle.partitions", str(wanted))
        own.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
        own.conf.set("spark.sql.files.minPartitionNum", str(wanted))
        own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
    return own


def work_session(spark: SparkSession, sf_dir: str) -> SparkSession:
    """``sized_session`` for the fact table of ``sf_dir``; its rows are counted once, from the footers of lineitem."""
    src, name = _label(sf_dir)
    key = (app_id(spark), name)
    if key not in _ROWS:
        _ROWS[key] = source_frames(spark, src)[0].count()
    return sized_session(spark, _ROWS[key])


def fact_layout(fact: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write layout of the fact table: range partitions on (SKU, warehouse, date), sorted.

    Bounds are sampled on the whole key, so one pair with a third of all rows
    spreads over about a third of the partitions.  Their number is the session's
    (``spark.sql.shuffle.partitions``, joined by size under AQE) unless given."""
    key = [*PAIR, "Date"]
    dealt = fact.repartitionByRange(partitions, *key) if partitions else fact.repartitionByRange(*key)
    return dealt.sortWithinPartitions(*key)


def inventory_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory fact table derived from ``sf_dir``, written once, then scanned.

    Layout: range-partitioned and sorted by SKU, warehouse, date, so that each
    file holds a contiguous run of pairs: map-side partial aggregation by pair
    folds almost everything before the shuffle, and Parquet min/max statistics
    prune files on SKU.  Range bounds are sampled on the full key, so a pair
    holding a third of all rows is split across files by date.  Narrow rows are
    moved and sorted; the measures are computed as the files are written.
    """
    src, name = _label(sf_dir)
    key = (app_id(spark), f"fact|{name}")
    with _LOCK:
        if key not in _FRAMES:
            path = scratch_path(spark, name, "fact")
            days = keyed_days(*source_frames(work_session(spark, sf_dir), src))
            with_measures(fact_layout(days)).write.mode("overwrite").parquet(path)
            _PATHS[key] = path
            _FRAMES[key] = spark.read.schema(INVENTORY_SCHEMA).parquet(path)
        return _FRAMES[key]


def sized_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``inventory_table`` in a session whose partitions follow its rows."""
    fact = inventory_table(spark, sf_dir)
    return work_session(spark, sf_dir).read.schema(fact.schema).parquet(inventory_path(spark, sf_dir))


def inventory_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the fact table that ``inventory_table`` has written."""
    return _PATHS[(app_id(spark), f"fact|{_label(sf_dir)[1]}")]


class Lattice(Mapping):
    """The tables of a stored inventory: each is written under ``path`` when it is first asked for.

    ``bases`` makes the tables that come from rows; the other grains are rolled up from a finer
    one.  ``parts/<grain>`` is a grain before its distinct counts: rows of the grains that hold both keys.
    Jobs run in the session ``own``, tables are read back in ``spark``."""

    def __init__(self, spark: SparkSession, own: SparkSession, path: str, bases: dict[str, Callable[[], DataFrame]]):
        self._spark, self._own, self._path, self._bases = spark, own, path.rstrip("/"), bases
        self._schemas: dict[str, StructType] = {}
        self._frames: dict[str, DataFrame] = {}
        self._lock = threading.RLock()

    def __iter__(self) -> Iterator[str]:
        from shelfwise.operators.metrics import GRAINS

        return iter([*GRAINS, *(n for n in self._bases if n not in GRAINS)])

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def __contains__(self, name) -> bool:
        return name in [*self] or name.startswith("parts/") and self._base(name[6:]) == name

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self:
            raise KeyError(name)
        with self._lock:
            if name not in self._frames:
                self.write(name)
                self._frames[name] = self._read(self._spark, name)
            return self._frames[name]

    def _read(self, session: SparkSession, name: str) -> DataFrame:
        return session.read.schema(self._schemas[name]).parquet(f"{self._path}/{name}")

    def _base(self, name: str) -> str:
        from shelfwise.operators.metrics import GRAINS

        return f"parts/{name}" if name in GRAINS and GRAINS[name].distinct else name

    def _needs(self, name: str) -> list[str]:
        """The tables that one table is made from."""
        from shelfwise.operators.metrics import GRAINS, KEY_GRAINS

        grain = GRAINS.get(name.removeprefix("parts/"))
        if grain is None:
            return ["repeated_keys"] if name == "repeated_rows" else []
        if name != self._base(grain.name):
            counted = [self._base(KEY_GRAINS[k]) for k in grain.distinct] if not grain.keys else [self._both(grain, k) for k in grain.distinct]
            return [self._base(grain.name), *counted]
        return [self._base(grain.finer)] if grain.finer else []

    @staticmethod
    def _both(grain, other: str) -> str:
        """The grain that holds the grain's key and the other one."""
        return "pair" if {*grain.keys, other} == set(PAIR) else "supplier_pair"

    def _made(self, name: str) -> DataFrame:
        from shelfwise.operators.metrics import GRAINS, KEY_GRAINS, key_counts, merged

        read = lambda n: self._read(self._own, n)
        grain = GRAINS.get(name.removeprefix("parts/"))
        if grain is None:
            return self._bases[name]()
        if name == self._base(grain.name):
            return merged(read(self._base(grain.finer)), grain) if grain.finer else self._bases[grain.name]()
        own = read(self._base(grain.name))
        for other in grain.distinct:
            if not grain.keys:
                own = own.withColumn(f"d_{other}", read(self._base(KEY_GRAINS[other])).agg(F.count(other)).scalar())
                continue
            both = self._both(grain, other)
            counts = key_counts(read(both), grain.keys, other, unique=both == "pair").withColumnRenamed(grain.keys[0], "_key")
            own = own.join(counts, own[grain.keys[0]].eqNullSafe(counts["_key"]), "left").drop("_key")
        return own

    def write(self, *names: str) -> None:
        """Write those of the named tables that are missing, and what they are made from, side by side where they can be."""
        with self._lock:
            missing = [n for n in names if n not in self._schemas]
            for name in missing:
                missing += [n for n in self._needs(name) if n not in self._schemas and n not in missing]
            while missing:
                ready = [n for n in missing if all(m in self._schemas for m in self._needs(n))]
                # the first table of a folder is written alone: jobs that make the same parent folder at once can fail
                used = {os.path.dirname(n) for n in self._schemas}
                first = {os.path.dirname(n): n for n in reversed(ready) if os.path.dirname(n) not in used}
                if first:
                    ready = [first.get("") or next(iter(first.values()))]
                with ThreadPoolExecutor(WRITERS) as pool:
                    self._schemas |= dict(pool.map(self._write, ready))
                missing = [n for n in missing if n not in ready]

    def _write(self, name: str) -> tuple[str, StructType]:
        df = self._made(name)
        df.write.mode("overwrite").parquet(f"{self._path}/{name}")
        return name, df.schema


def lattice(spark: SparkSession, fact: DataFrame, path: str, params: Params) -> Lattice:
    """The lattice of a fact table under ``path``; its jobs run in the session of ``fact``.

    Grains without a finer one are aggregated from the rows, each reading its own columns;
    the others are rolled up from the pairs. Business keys and whole rows that repeat are found here once
    (few, in a fact table that is nearly clean).
    """
    from shelfwise.operators.metrics import GRAINS, from_rows
    from shelfwise.operators.quality import duplicate_groups

    def repeated_rows() -> DataFrame:
        # a row that repeats has a business key that repeats: only those rows are grouped whole
        repeats = tables._read(fact.sparkSession, "repeated_keys").select(*[F.col(c).alias(f"_{c}") for c in KEY])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
        return duplicate_groups(fact.join(repeats, same, "left_semi"), COLUMNS)

    bases = {n: lambda g=g: from_rows(fact, g, params) for n, g in GRAINS.items() if not g.finer}
    bases |= {"repeated_keys": lambda: duplicate_groups(fact, KEY), "repeated_rows": repeated_rows}
    tables = Lattice(spark, fact.sparkSession, path, bases)
    return tables


def store_inventory(fact: DataFrame, path: str, params: Params = DEFAULT, *, copy_fact: bool = True) -> None:
    """Write ``fact`` (unless it is stored already) and the whole lattice of its grains under ``path``.

    A manifest is written last: a folder without one is not a stored inventory.
    """
    spark, path = fact.sparkSession, path.rstrip("/")
    if copy_fact:
        kept = fact.select(*COLUMNS)
        fact_layout(kept).write.mode("overwrite").parquet(f"{path}/fact")
        stored = spark.read.schema(kept.schema).parquet(f"{path}/fact")
        fact = sized_session(spark, stored.count()).read.schema(kept.schema).parquet(f"{path}/fact")
    _store(lattice(spark, fact, path, params), path, params, copy_fact)


def store_grains(bases: dict[str, DataFrame], path: str, params: Params = DEFAULT, fact: bool = False) -> None:
    """Write the lattice under ``path`` from the grains that have no finer one (one row per key), then the manifest."""
    spark = next(iter(bases.values())).sparkSession
    _store(Lattice(spark, spark, path, {n: lambda df=df: df for n, df in bases.items()}), path, params, fact)


def _store(tables: Lattice, path: str, params: Params, fact: bool) -> None:
    """Write every table of the lattice, then its manifest."""
    from shelfwise.operators.metrics import Inventory

    tables.write(*tables)
    manifest = {
        "overstock_rop_multiple": params.overstock_rop_multiple,
        "fact": fact,
        # schemas are stored, so that opening infers none
        "tables": {name: tables[name].schema.json() for name in tables},
        "marks": dict(Marks(Inventory(None, tables, params))),
    }
    spark = tables["total"].sparkSession
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/manifest")


class Marks(Mapping):
    """What reports that rank all pairs or SKUs need of the whole ranking: a few boundary keys and one histogram,
    each found when it is first asked for."""

    NAMES = ("cover_tiles", "value_ranges")

    def __init__(self, data):
        self._data, self._found, self._lock = data, {}, threading.RLock()

    def __iter__(self) -> Iterator[str]:
        return iter(self.NAMES)

    def __len__(self) -> int:
        return len(self.NAMES)

    def __getitem__(self, name: str):
        if name not in self.NAMES:
            raise KeyError(name)
        with self._lock:
            if name not in self._found:
                self._found[name] = self._find(name)
            return self._found[name]

    def _find(self, name: str):
        from shelfwise.operators.inventory import value_ranges
        from shelfwise.operators.quartile_actions import cover_tiles

        if name == "cover_tiles":
            return {str(DEFAULT.cover_quantiles): cover_tiles(self._data, DEFAULT.cover_quantiles)}
        spark = self._data.grain("sku", counted=False).sparkSession
        return value_ranges(self._data, int(spark.conf.get("spark.sql.shuffle.partitions")))


def open_inventory(spark: SparkSession, path: str, fact: DataFrame | None = None):
    """The inventory stored under ``path``, by this or any earlier application."""
    from dataclasses import replace

    from shelfwise.operators.metrics import Inventory

    path = path.rstrip("/")
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if fact is None:
        fact = spark.read.parquet(f"{path}/fact")
    params = replace(DEFAULT, overstock_rop_multiple=manifest["overstock_rop_multiple"])
    tables = {
        name: spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{path}/{name}")
        for name, schema in manifest["tables"].items()
    }
    return Inventory(fact, tables, params, marks=manifest["marks"])


def inventory_data(spark: SparkSession, sf_dir: str):
    """Derived fact table with its lattice, of which each table is stored once per application, when a report first reads it."""
    from shelfwise.operators.metrics import Inventory

    _, name = _label(sf_dir)
    key = (app_id(spark), f"inventory|{name}")
    if key in _FRAMES:
        return _FRAMES[key]
    fact, rows = inventory_table(spark, sf_dir), sized_table(spark, sf_dir)
    with _LOCK:
        if key not in _FRAMES:
            data = Inventory(fact, lattice(spark, rows, scratch_path(spark, name, "aggregates"), DEFAULT))
            data.marks = Marks(data)
            _FRAMES[key] = data
        return _FRAMES[key]


def derived_path(spark: SparkSession, sf_dir: str, what: str, build, fmt: str = "parquet") -> str:
    """Folder of a table derived from the fact table of ``sf_dir``, written once per application."""
    _, name = _label(sf_dir)
    key = (app_id(spark), f"{what}|{name}")
    df = build() if key not in _PATHS else None
    with _LOCK:
        if key not in _PATHS:
            path = scratch_path(spark, name, what)
            writer = df.write.mode("overwrite")
            (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
            _PATHS[key] = path
        return _PATHS[key]
