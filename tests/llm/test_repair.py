"""Conversation repair against plain search and SQL, in pieces of every size."""

import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from rulewatch.llm import oracles, repair

INSERT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def damage(rows):
    """Rows of each conversation after the damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept = out.setdefault(conv, [])
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def brute(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))

    @functools.cache
    def best(at, state, inserted=0):
        """The least (cost, audit, texts) from here."""
        found = []
        if at == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        if inserted < 3:
            role, to = INSERT[state]
            cost, audit, texts = best(at, to, inserted + 1)
            found.append((cost + 2, "I" + audit, (f"{role}:", *texts)))
        if at < len(rows):
            _, role, text = rows[at]
            cost, audit, texts = best(at + 1, state)
            found.append((cost + 3, "D" + audit, texts))
            if faults[at] in (None, "truncated"):
                more = faults[at] is not None
                if (state, role[:1]) in KEEP:
                    cost, audit, texts = best(at + 1, KEEP[state, role[:1]])
                    found.append((cost + more, "K" + audit, (f"{role}:{text}", *texts)))
                name, to = INSERT[state]
                cost, audit, texts = best(at + 1, to)
                found.append((cost + 2 + more, "R" + audit, (f"{name}:{text}", *texts)))
        return min(found, default=(10**9, "", ()))

    cost, audit, texts = best(0, 0)
    turns = [t for t, *_ in rows if t is not None]
    pairs = zip(rows, rows[1:])
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs),
        cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest(),
    )


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, piece long, after long, conv string"


def rows(seed, n=60, length=14):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "uX"]
    texts = [None, "", " \t\n", "Fine.", "Cut", "Why? ", "Yes!\n", "long " * 3000 + ".", "é. à", "No."]
    out = [(rng.choice([None, c]) if c < 3 else c, rng.choice([None, *range(length)]), rng.choice(roles), rng.choice(texts)) for c in range(n) for _ in range(rng.randrange(1, length))]
    # Well-formed conversations, one of which is long and one of which holds one row again and again.
    out += [(1000, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(150)]
    out += [(1001, t // 9, "user", "Same.") for t in range(90)] + [(1002, None, "user", f"{t}.") for t in range(40)]
    return out + out[:15]


def result(df):
    found = df.collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found}


@pytest.mark.parametrize("most", [3, 1 << 14])
def test_like_plain_search(spark, most):
    data = rows(most)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in data], SCHEMA).repartition(3)
    got = result(repair.repaired_conversations(df, most))
    assert got == {c: brute(r) for c, r in damage(data).items()}


def test_like_sql(spark):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows(4, 25)], SCHEMA)
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    want = con.sql(oracles.CONVERSATION_REPAIR)
    want = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert result(repair.repaired_conversations(df)) == {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in want}


def test_one_vast_conversation_is_split(spark):
    """One conversation without turns: its pieces lie in several tasks and its costs need few passes."""
    df = spark.range(6_000).selectExpr("1L AS conv", "CAST(NULL AS long) AS turn", "if(id % 3 = 0, 'assistant', 'user') AS role", "concat(id, '.') AS text")
    found = repair.pieces(df, 100)
    assert found.selectExpr("max(size(rows))").first()[0] <= 100
    tasks = [r[0] for r in found.selectExpr("piece >> 24 AS task", "size(rows) AS n").groupBy("task").sum("n").select("sum(n)").collect()]
    assert max(tasks) < 2 * 6_000 / 4
    got = repair.repair(df, 100).first()
    plain = sorted((r["role"], r["text"]) for r in df.collect())
    # By role: every row of one of the roles is alone, so half of the pairs must be completed.
    assert got["illegal"] == 5_998 and got["cost"] == brute_cost(spark, plain)


def brute_cost(spark, rows_):
    costs = {0: 0}
    for role, _ in rows_:
        for _ in range(2):
            for s, c in list(costs.items()):
                costs[INSERT[s][1]] = min(costs.get(INSERT[s][1], 10**9), c + 2)
        new = {}
        for s, c in costs.items():
            for to, more in ((s, 3), (INSERT[s][1], 2), (KEEP.get((s, role[0])), 0)):
                if to is not None:
                    new[to] = min(new.get(to, 10**9), c + more)
        costs = new
    return min(c + {0: 0, 1: 4, 2: 2, 3: 0}[s] for s, c in costs.items())


def test_empty_table(spark):
    assert repair.repaired_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
