import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from shelfwise.llm import conversation_repair as cr
from shelfwise.llm.oracle import OP12_SQL

TURNS = "conv_id long, turn long, role string, text string, score double, part int"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, how = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub(r"[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults, most=None):
    """By trying every edit string in order of cost, then of its letters."""
    best = (5 * 2 + 2 * len(rows), "D" * len(rows), [])  # at most: all go
    best = (2 * len(rows), "D" * len(rows), [])
    stack = [(0, 0, "", [], "")]
    while stack:
        i, cost, audit, lines, initials = stack.pop()
        if cost > best[0]:
            continue
        if i == len(rows) and GOOD.match(initials):
            best = min(best, (cost, audit, lines), key=lambda b: b[:2])
        if cost + 5 <= best[0] and audit[-3:] != "III":
            stack += [(i, cost + 5, audit + "I", [*lines, f"{r}:"], initials + r[0]) for r in ("user", "assistant") if possible(initials + r[0])]
        if i < len(rows):
            _, _, role, text = rows[i]
            stack.append((i + 1, cost + 2, audit + "D", lines, initials))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                stack += [(i + 1, cost + 1 + more, audit + "R", [*lines, f"{r}:{text}"], initials + r[0]) for r in ("user", "assistant") if possible(initials + r[0])]
                if possible(initials + role[:1]) and role:
                    stack.append((i + 1, cost + more, audit + "K", [*lines, f"{role}:{text}"], initials + role[0]))
    return best


def possible(initials):
    return bool(re.match(r"s?(ua)*u?\Z", initials))


def brute(conv, rows):
    rows = sorted(damaged(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults = faults_of(rows)
    cost, audit, lines = cheapest(rows, faults)
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    return {
        "conv_id": conv,
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": faults.count("blank"),
        "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def conversations(seed, n, longest=7):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", "assistant", "user", "unicorn", "", None, "tool"]
    texts = ["Yes.", "No!", "well", "", " \n", None, "ends here. \t", "é?", "user:x\ny."]
    for conv in range(n):
        for turn in range(r.randint(1, longest)):
            own = r.choice([turn, turn, turn, turn, turn + 2, 0, None])
            role = ["user", "assistant"][turn % 2] if r.random() < 0.6 else r.choice(roles)
            yield (None if conv == 5 else conv, own, role, r.choice(texts) if r.random() < 0.6 else f"Line {turn}.")


def result(spark, rows, parts):
    table = spark.createDataFrame([(*r, 0.1, 3) for r in rows], TURNS).repartition(parts)
    return {r.conv_id: r.asDict() for r in cr.repair(cr.damage(table)).collect()}


@pytest.mark.parametrize("parts", [1, 6])
def test_against_every_edit_string(spark, parts):
    rows = list(conversations(1, 60))
    by_conv = {k: [r for r in rows if r[0] == k] for k in {r[0] for r in rows}}
    assert result(spark, rows, parts) == {k: brute(k, v) for k, v in by_conv.items()}


def test_long_conversations_go_by_segments(spark, monkeypatch):
    rows = [(7, t, r, x) for _, t, r, x in conversations(2, 60, 9)] + list(conversations(3, 8))
    want = result(spark, rows, 3)
    monkeypatch.setattr(cr, "SEGMENT_ROWS", 5)
    assert result(spark, rows, 3) == want
    assert len(want[7]["audit"]) > 100


def test_segments_join_as_one(spark):
    r = random.Random(4)
    for _ in range(200):
        plan = [(r.choice("suauaux"), r.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(r.randint(0, 12))]
        whole = cr._edited(plan, "")
        held = {"": (0, "")}
        for at in range(0, len(plan), 3):
            after = {}
            for a, (cost, audit) in held.items():
                for b, (c, x) in cr._edited(plan[at : at + 3], a).items():
                    after[b] = min((cost + c, audit + x), after.get(b, (cost + c, audit + x)))
            held = after
        assert held == whole


@pytest.mark.parametrize("mask", [0, 1, (1 << 64) - 1])
def test_comparison_survives_hash_collisions(mask):
    """Two strings, neither a prefix of the other, under hashes that collide always, often, never."""
    audits, nodes = cr.Audits(mask=mask), {}
    for text in ("".join(x) for n in range(6) for x in itertools.product("DIK", repeat=n)):
        nodes[text] = audits.add(nodes[text[:-1]], text[-1]) if text else 0
    again = {t: n for t, n in nodes.items()}
    for text in ("DDKID", "KIDDK", "KKKKK"):  # equal strings as other nodes
        node = 0
        for c in text:
            node = audits.add(node, c)
        again[text + "'"] = node
    for a, b in itertools.product(again, again):
        x, y = a.strip("'"), b.strip("'")
        assert audits.less(again[a], again[b]) == (x < y)
        assert audits.text(again[a]) == x


def test_dropped_conversations_and_no_rows(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out = result(spark, [(dropped, 0, "user", "Hi.")], 1)
    assert out == {dropped: dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"conv_id": dropped, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}}
    assert result(spark, [], 1) == {}


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "word " * 200_000 + "?"), (1, 1, "assistant", "x" * 100_000), (2, 0, "user", "a.")]
    by_conv = {k: [r for r in rows if r[0] == k] for k in (1, 2)}
    assert result(spark, rows, 2) == {k: brute(k, v) for k, v in by_conv.items()}


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    out = cr.op12(spark, sf)
    names = sorted(out.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({OP12_SQL})").fetchall()
    assert sorted(tuple(r) for r in out.select(*names).collect()) == sorted(want)


def test_odd_rows_against_sql(spark):
    rows = list(conversations(8, 50))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = list(cr._RESULT_NAMES)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({OP12_SQL})").fetchall()
    got = [tuple(r[n] for n in names) for r in result(spark, rows, 4).values()]
    assert sorted(got, key=str) == sorted(want, key=str)
