"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

``repair(turns)`` reads rows (conv_id, turn, role, text), orders each
conversation's rows by turn (nulls first; ties by role, text) and finds edits
whose role initials read ``(s?(ua)+)?``: Keep (0), Rerole to user or assistant (1),
Delete (2; blank and duplicate rows must go), Insert an empty user or assistant row
(5); a truncated row that stays adds 5. Of the cheapest edit strings it takes the
one least in ASCII order.

Method, a persistent audit DP. A state is the last role initial that stays (none,
s, u, a); each state holds its cost and a node of a tree of edits, so that edit strings
share their prefixes. A node has its ancestors at powers of two (binary lifting) and a
rolling hash of its string. Equal costs are settled by a search for the longest common
prefix over the ancestors' hashes; equal hashes are verified edit by edit, up to a
shared node. Two equally cheap strings of one state are never prefixes of each other (a
longer one would hold more inserts), so a prefix that loses a tie can be dropped.

Spark: rows are range-partitioned by their whole order and sorted, so that a
conversation with a third of all rows lies in many tasks. A conversation that
lies inside one task, with at most ``SEGMENT_ROWS`` rows and SEGMENT_BYTES of text, is
repaired there. All others (at most the first and last of each task, and long ones) go
by segments of at most SEGMENT_ROWS rows: a segment yields its cheapest edits from each state to each
state (16 at most), segments are joined state by state in order, and only the
SHA-256 of the repaired text, which no scheme can split, is one pass over the
conversation's rows, holding one row at a time.

Defined results: null conv_id, turn, role and text are one space in strings; a null turn
sorts first and counts in no gap; rows of null conv_id are one conversation; a text without other
characters than white space is blank; repeated rows are duplicates; an empty table gives no rows;
further columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwise.llm.common import table, written

RULE_COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5
#: Rows and text bytes of a conversation that one task holds at a time.
SEGMENT_ROWS = 4096
SEGMENT_BYTES = 1 << 26
#: States: the initial that came last ("" at the start), and what may follow.
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
STATES = list(FOLLOWS)
ROLES = {"u": "user", "a": "assistant"}
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
WHITE = " \t\n\x0b\f\r"
FAULTS = ("", "blank", "duplicate", "truncated")


class Audits:
    """Edit strings as nodes that share their prefixes; node 0 is the empty string."""

    def __init__(self, base: int = _BASE, mask: int = _MASK):
        self.base, self.mask = base, mask
        self.op, self.depth, self.up, self.hash = [""], [0], [()], [0]

    def add(self, node: int, op: str) -> int:
        up, k = [node], 0
        while k < len(self.up[up[k]]):  # the ancestor at 2^(k+1) is the one at 2^k of the one at 2^k
            up.append(self.up[up[k]][k])
            k += 1
        self.op.append(op)
        self.depth.append(self.depth[node] + 1)
        self.up.append(tuple(up))
        self.hash.append((self.hash[node] * self.base + ord(op)) & self.mask)
        return len(self.op) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            k = (self.depth[node] - depth).bit_length() - 1
            node = self.up[node][k]
        return node

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth have one string: equal hashes are verified up to a shared node."""
        if self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.op[a] != self.op[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether a's string is before b's in ASCII order (neither being a prefix of the other, or a the prefix)."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        low, high = 0, depth - 1  # the longest common prefix is at least low and at most high long
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(self.ancestor(x, middle), self.ancestor(y, middle)):
                low = middle
            else:
                high = middle - 1
        return self.op[self.ancestor(x, low + 1)] < self.op[self.ancestor(y, low + 1)]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.op[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _better(audits: Audits, new: tuple[int, int], old: tuple[int, int] | None) -> bool:
    if old is None or new[0] != old[0]:
        return old is None or new[0] < old[0]
    return new[1] != old[1] and audits.less(new[1], old[1])


def _with_inserts(audits: Audits, held: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """``held`` (state -> cost, node) with inserted rows wherever they are cheaper."""
    held, open_ = dict(held), list(held)
    while open_:
        state = open_.pop()
        cost, node = held[state]
        for to in FOLLOWS[state]:
            if to in ROLES and (to not in held or cost + RULE_COST["I"] <= held[to][0]):
                new = (cost + RULE_COST["I"], audits.add(node, "I"))
                if _better(audits, new, held.get(to)):
                    held[to] = new
                    open_.append(to)
    return held


def _edited(rows: list[tuple[str, str]], start: str) -> dict[str, tuple[int, str]]:
    """state -> (cost, edits) after rows of (role initial, fault), entered in state ``start``; no inserts after the last row."""
    audits = Audits()
    held = {start: (0, 0)}
    for initial, fault in rows:
        after: dict[str, tuple[int, int]] = {}

        def offer(state: str, cost: int, node: int, op: str) -> None:
            cost += RULE_COST[op] + (TRUNCATED_COST if fault == "truncated" and op != "D" else 0)
            old = after.get(state)
            if old is None or cost <= old[0]:
                new = (cost, audits.add(node, op))
                if _better(audits, new, old):
                    after[state] = new

        for state, (cost, node) in _with_inserts(audits, held).items():
            offer(state, cost, node, "D")
            if fault not in ("blank", "duplicate"):
                for to in FOLLOWS[state]:
                    if to == initial:
                        offer(to, cost, node, "K")
                    if to in ROLES:
                        offer(to, cost, node, "R")
        held = after
    return {state: (cost, audits.text(node)) for state, (cost, node) in held.items()}


#: Rows to insert at the end of a conversation that may end in a state.
MISSING = {"": 0, "s": 2, "u": 1, "a": 0}


def _finished(held: dict[str, tuple[int, str]]) -> tuple[int, str]:
    """The cheapest whole edit string: inserts after the last row, then no row or an assistant's last."""
    return min((cost + RULE_COST["I"] * MISSING[state], audit + "I" * MISSING[state]) for state, (cost, audit) in held.items())


class Repaired:
    """SHA-256 of the repaired conversation, fed with its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, ""
        self.hash, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state = FOLLOWS[self.state][-1]
            self.line(ROLES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        op = self.audit[self.at]
        self.at += 1
        if op == "K":
            self.state = role[0]
            self.line(role, text)
        elif op == "R":
            self.state = FOLLOWS[self.state][-1]
            self.line(ROLES[self.state], text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


class Tally:
    """Counts of rows in order; tallies of adjacent segments add up."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None  # role initials
        self.low = self.high = None  # turns

    def add(self, initial: str, fault: str, turn: int | None) -> None:
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def join(self, r: dict) -> None:
        """Add the tally of the segment that follows, as a row."""
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, k, getattr(self, k) + r[k])
        if r["first"] is not None:
            if self.last is not None:
                self.illegal += self.last + r["first"] not in ("su", "ua", "au")
            self.first = r["first"] if self.first is None else self.first
            self.last = r["last"]
        if r["high"] is not None:
            self.turns -= self.high == r["low"]
            self.low = r["low"] if self.low is None else self.low
            self.high = r["high"]

    @property
    def gaps(self) -> int:
        return 0 if self.high is None else self.high - self.low + 1 - self.turns


RESULT = "conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT_NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _result(conv_id, tally: Tally, cost: int, audit: str, digest: str) -> dict:
    values = (conv_id, tally.gaps, tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit, digest)
    return dict(zip(_RESULT_NAMES, values))


def _batches(rows: Iterator[dict], schema: pa.Schema, n: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """(conv_id, its rows) of consecutive rows; each must be read to its end before the next."""
    rows = (r for b in batches for r in b.to_pylist())
    ahead = next(rows, None)
    while ahead is not None:
        key = ahead["conv_id"]

        def own():
            nonlocal ahead
            while ahead is not None and ahead["conv_id"] == key:
                now, ahead = ahead, next(rows, None)
                yield now

        mine = own()
        yield key, mine
        for _ in mine:
            pass


def _whole(schema: pa.Schema):
    """Repairs the conversations that lie inside a task; of the others, only conv_id (open)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results():
            held, first = None, True
            for key, rows in _conversations(batches):
                if held is not None:  # not the last of the task
                    yield held
                held, size, long = [], 0, False
                for r in rows:
                    size += len(r["text"])
                    long |= len(held) >= SEGMENT_ROWS or size > SEGMENT_BYTES
                    if not long and not r["dropped"]:
                        held.append(r)
                held = {"conv_id": key, "open": True} if first or long else _repaired(key, held) | {"open": False}
                first = False
            if held is not None:
                yield {"conv_id": held["conv_id"], "open": True}

        yield from _batches(results(), schema)

    return task


def _repaired(key, rows: list[dict]) -> dict:
    tally, seen, plan = Tally(), set(), []
    for r in rows:
        fault = "blank" if r["blank"] else "duplicate" if (r["role"], r["text"]) in seen else "truncated" if r["cut"] else ""
        seen.add((r["role"], r["text"]))
        tally.add(r["role"][:1], fault, r["turn"])
        plan.append((r["role"][:1], fault))
    cost, audit = _finished(_edited(plan, ""))
    out = Repaired(audit)
    for r in rows:
        out.row(r["role"], r["text"])
    return _result(key, tally, cost, audit, out.digest())


_SEGMENT = "conv_id {key}, part int, nth int, blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, low long, high long, edits array<struct<start: string, stop: string, cost: long, audit: string>>"


def _segmented(schema: pa.Schema):
    """Tallies and cheapest edits of segments of at most SEGMENT_ROWS rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segments():
            for key, rows in _conversations(batches):
                nth, held = 0, []
                for r in rows:
                    part = r["part"]
                    if not r["dropped"]:
                        held.append(r)
                    if len(held) == SEGMENT_ROWS:
                        yield _segment(key, part, nth, held)
                        nth, held = nth + 1, []
                if held or not nth:
                    yield _segment(key, part, nth, held)

        yield from _batches(segments(), schema, 64)

    return task


def _segment(key, part: int, nth: int, rows: list[dict]) -> dict:
    tally, plan = Tally(), []
    for r in rows:
        tally.add(r["initial"], r["fault"], r["turn"])
        plan.append((r["initial"], r["fault"]))
    edits = [{"start": a, "stop": b, "cost": cost, "audit": audit} for a in STATES for b, (cost, audit) in _edited(plan, a).items()]
    return {"conv_id": key, "part": part, "nth": nth, "edits": edits} | vars(tally)


def _joined(schema: pa.Schema):
    """The whole tally and the cheapest edits of each conversation from its segments in order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results():
            for key, segments in _conversations(batches):
                tally, held = Tally(), {"": (0, "")}
                for s in segments:
                    tally.join(s)
                    after: dict[str, tuple[int, str]] = {}
                    for e in s["edits"]:
                        if e["start"] in held:
                            cost, audit = held[e["start"]]
                            new = (cost + e["cost"], audit + e["audit"])
                            after[e["stop"]] = min(new, after.get(e["stop"], new))
                    held = after
                yield _result(key, tally, *_finished(held), "")

        yield from _batches(results(), schema, 16)

    return task


def _digested(schema: pa.Schema):
    """SHA-256 of each conversation: its audit comes first, then its rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results():
            for key, rows in _conversations(batches):
                out = None
                for r in rows:
                    if out is None:
                        out = Repaired(r["text"])
                    elif not r["dropped"]:
                        out.row(r["role"], r["text"])
                yield {"conv_id": key, "sha": out.digest()}

        yield from _batches(results(), schema)

    return task


def ordered_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped with the flags and the order's keys (at: place in the source)."""
    if "dropped" not in turns.columns:
        turns = turns.withColumn("dropped", F.lit(False))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    bare = F.rtrim(text, F.lit(WHITE))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), "dropped", F.substring(role, 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    return rows.withColumn("at", F.monotonically_increasing_id())


_ORDER = ["conv_id", "turn", "role", "text", "at"]


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost and edits, and the SHA-256 of the repaired ``role:text`` lines.

    Rows whose column ``dropped`` (if there is one) is true are left out; their
    conversation is not.
    """
    key = turns.schema["conv_id"].dataType.simpleString()
    rows = ordered_rows(turns)
    result = RESULT.format(key=key)
    whole = f"{result}, open boolean"
    dealt = rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    first = written(dealt.mapInArrow(_whole(_arrow(whole)), whole))
    done = first.filter("not open").drop("open")
    # conversations at the ends of tasks, and long ones: at most a few for each task, so that the planner can broadcast them
    open_ids = first.filter("open").select(F.col("conv_id").alias("_id")).distinct()
    lying = rows.join(open_ids, F.col("conv_id").eqNullSafe(F.col("_id")), "left_semi")
    said = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    lying = written(lying.withColumn("said", F.when(~F.col("dropped"), said)))
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"), F.col("at").alias("c"))
    earliest = lying.filter("not dropped").groupBy(F.col("conv_id").alias("_conv"), F.col("said").alias("_said")).agg(F.min(place).alias("_place"))
    flagged = lying.join(earliest, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    fault = F.when(F.col("blank"), "blank").when(place != F.col("_place"), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    flags = flagged.select(*_ORDER, "dropped", "initial", fault.alias("fault"))
    dealt = flags.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("part", F.spark_partition_id())
    segment = _SEGMENT.format(key=key)
    segments = dealt.drop("role", "text", "at").mapInArrow(_segmented(_arrow(segment)), segment)
    by_conv = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth")
    joined = written(by_conv.mapInArrow(_joined(_arrow(result)), result))
    kind, none = F.lit(0).alias("kind"), F.lit(None).cast("long")
    audits = joined.select("conv_id", kind, none.alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), none.alias("at"), F.lit(False).alias("dropped"))
    texts = lying.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "at", "dropped")
    stream = audits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER[1:])
    digest = f"conv_id {key}, sha string"
    shas = stream.select("conv_id", "role", "text", "dropped").mapInArrow(_digested(_arrow(digest)), digest).withColumnRenamed("conv_id", "_conv")
    closed = joined.drop("repaired_sha256").join(shas, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(*_RESULT_NAMES[:-1], F.col("sha").alias("repaired_sha256"))
    return done.unionByName(closed)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def damage(turns: DataFrame) -> DataFrame:
    """The rows damaged by crc32(``conv_id:turn``) mod 20: 0 dropped, 1 emptied, 2 without ``.!?``, 3 twice, 4 role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("how")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), how)
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("how") == 0).alias("dropped"), F.explode(copies).alias("_copy")).drop("_copy")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged and repaired."""
    return repair(damage(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
