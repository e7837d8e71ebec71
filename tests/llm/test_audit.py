"""The filter audit: galloping merges against sets, whole reports against brute force and SQL."""

import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings, strategies as st

from rulewatch.llm import audit, oracles

rising = st.lists(st.integers(0, 400), max_size=300).map(lambda x: np.array(sorted(set(x)), np.int64))


@settings(max_examples=150, deadline=None)
@given(rising, rising, rising)
def test_merges_like_sets(a, b, c):
    assert (audit.gallop(a, b) == np.searchsorted(a, b)).all()
    assert audit.difference(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    assert audit.common(a, b) == len(set(a.tolist()) & set(b.tolist()))
    lists = [a, b, c]
    for bits, union in enumerate(audit.unions(lists)):
        assert union.tolist() == sorted(set().union(*(lists[i].tolist() for i in range(3) if bits >> i & 1)))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute(docs, labels):
    """Rows of the report, each step's filter tried on each document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    tests = {
        "A": lambda i, t: len(words(t)) < 200,
        "B": lambda i, t: 100 * len(set(words(t))) < 50 * len(words(t)),
        "C": lambda i, t: 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
        "D": lambda i, t: bool(re.search("[#$%&*|]", t)),
        "E": lambda i, t: i is not None and t in least and least[t] < i,
    }
    fails = [(s or "", i, "".join(f for f in "ABCDE" if tests[f](i, t or ""))) for i, t, s, *_ in docs]
    out = {}
    for part in {s for s, *_ in fails}:
        mine = [(i, f) for s, i, f in fails if s == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                failing = sum(f in x[1] for x in mine)
                out[part, order, step] = [
                    len(left), len(gone), failing - len(gone), sum(x[1] == f for x in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
DOCS = "doc_id long, text string, source string, fails int, part string, place string"


def rows(seed=3, n=160):
    rng = random.Random(seed)
    long = " ".join(f"w{i}" for i in range(210))
    texts = [None, "", " \t\n\x0b\x0c\r", long, long + " $", long.upper(), "a " * 300, "é" * 49 + "A", "é" * 50 + "AB", "#", "B c d", long + " É&", "word " * 4_000]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "web", "web", "web", "x y"]), 1, "p", "q") for _ in range(n)]
    return docs + docs[:20]


LABELS = [(i, [1, 0, None][i % 3], [0, 1, None, 1][i % 4]) for i in range(30)] + [(3, 1, 1), (None, 1, 1)]


def report(df):
    found = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in found}
    assert len(out) == len(found)
    return out


def frames(spark, docs):
    return spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_like_brute_force(spark):
    docs = rows()
    assert report(audit.filter_audit(*frames(spark, docs))) == brute(docs, LABELS)


def test_like_sql(spark):
    docs, labels = frames(spark, rows(8))
    got = audit.filter_audit(docs, labels)
    con = duckdb.connect()
    for name, df in (("documents", docs), ("labels", labels)):
        con.register(name, df.toArrow())
    want = con.sql(oracles.FILTER_AUDIT).to_arrow_table()
    key = [(c, "ascending") for c in ("part", "filter_order", "step")]
    assert got.toArrow().select(want.column_names).sort_by(key).to_pylist() == want.sort_by(key).to_pylist()


def test_blocks_add_up(spark):
    """Small blocks, and one id and part that holds nearly all rows, give the same sums."""
    rng = random.Random(5)
    posted = [("hot" if rng.random() < 0.9 else f"p{i % 3}", 7 if i % 2 else None, i, rng.randrange(32), rng.random() < 0.4, rng.random() < 0.2) for i in range(3_000)]
    df = spark.createDataFrame(posted, "part string, id long, place long, fails int, good boolean, toxic boolean").repartition(3)
    sums = [sorted(map(tuple, audit.interactions(df, 5, block).collect())) for block in (7, 1000, 1 << 16)]
    assert sums[0] == sums[1] == sums[2]
    hot = [p for p in posted if p[0] == "hot"]
    want = sum(p[3] & 3 == 2 and p[4] for p in hot)  # B after A, good
    assert [r[6] for r in sums[0] if r[:3] == ("hot", 1, 1)] == [want]


def test_hot_part_is_split(spark):
    df = spark.range(20_000).selectExpr("'one' AS part", "CAST(NULL AS long) AS id", "id AS place", "CAST(id % 31 + 1 AS int) AS fails", "false AS good", "false AS toxic")
    dealt = df.repartitionByRange(4, "part", "id", "place").rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert max(dealt) < 2 * 20_000 / 4


def test_empty_tables(spark):
    docs, labels = frames(spark, rows())
    assert audit.filter_audit(docs.limit(0), labels).collect() == []
    some = rows(2, 12)
    assert report(audit.filter_audit(frames(spark, some)[0], labels.limit(0))) == brute(some, [])
