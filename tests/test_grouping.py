"""Grouping operators with one hot key, against plain Python."""

import random

import pytest
from pyspark.sql import Window, functions as F

from rulewatch.operators import grouping
from rulewatch.operators.grouping import (
    count_values, first_per_key, latest_per_key, page, page_after, previous_values, recent_per_key, trend, values_of,
)
from rulewatch.operators.joins import in_any_list, lookup_join, without


def skewed(spark, n=900, seed=3):
    """A third of all rows belong to one key."""
    dice = random.Random(seed)
    rows = [("hot" if i % 3 == 0 else f"k{dice.randrange(40)}", i, dice.choice([None, dice.randrange(200)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, pos int, v int")


def test_values_are_counted_and_listed(spark):
    rows, df = skewed(spark)
    want = {k: {v for key, _, v in rows if key == k and v is not None} for k, _, _ in rows}
    assert {r.k: r.n for r in count_values(df, ["k"], "v", "n").collect()} == {k: len(v) for k, v in want.items()}
    many = count_values(df, ["k"], "v", "n", having=F.count("v") > 9)
    listed = [(r.k, r.v) for r in values_of(df, many, ["k"], "v").collect()]
    assert sorted(listed) == sorted((k, v) for k, vs in want.items() if len(vs) > 9 for v in vs)


def test_a_key_with_only_null_has_no_values(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    assert {r.k: r.n for r in count_values(df, ["k"], "v", "n").collect()} == {"a": 0, "b": 1}


def test_previous_values_equals_a_plain_window(spark):
    _, df = skewed(spark)
    plain = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("p", F.last("v", ignorenulls=True).over(plain)).withColumn("q", F.lag("pos").over(Window.partitionBy("k").orderBy("pos")))
    for segments in (1, 2, 7, 40):
        got = previous_values(df, ["k"], ["pos"], {"p": F.col("v"), "q": F.col("pos")}, segments)
        assert sorted(got.select("k", "pos", "p", "q").collect(), key=str) == sorted(want.select("k", "pos", "p", "q").collect(), key=str)


def test_previous_values_of_one_key_and_moment(spark):
    """Events of one rule at one moment, ids alike in their first characters, and NULL keys, times and ids."""
    rows = [("T1", 5, f"EVENT-{i:06d}", None if i % 11 else i) for i in range(3_000)]
    rows += [(None, None, f"E{i}", i) for i in range(50)] + [("T0", None, None, 1), ("T2", 1, "x", 2)]
    df = spark.createDataFrame(rows, "k string, at int, id string, v int").repartition(3)
    plain = Window.partitionBy("k").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("p", F.last("v", ignorenulls=True).over(plain))
    got = previous_values(df, ["k"], ["at", "id"], {"p": F.col("v")}, 8)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    borders = grouping._borders(df, ["k", "at", "id"], 8)
    segments = df.groupBy(grouping._segment_of(df.select("k", "at", "id"), borders).alias("s")).count().collect()
    assert len(segments) == 8 and max(r["count"] for r in segments) < 2.5 * len(rows) / 8


def test_previous_values_of_nothing(spark):
    df = spark.createDataFrame([], "k string, at int, v int")
    assert previous_values(df, ["k"], ["at"], {"p": F.col("v")}).collect() == []


def test_latest_and_first(spark):
    rows, df = skewed(spark)
    latest = {r.k: r.pos for r in latest_per_key(df, ["k"], ["pos"]).collect()}
    first = {r.k: r.pos for r in first_per_key(df, ["k"], ["pos"]).collect()}
    for key in latest:
        mine = [pos for k, pos, _ in rows if k == key]
        assert (first[key], latest[key]) == (min(mine), max(mine))


def test_recent_rows_and_trend(spark):
    rows, df = skewed(spark)
    for r in trend(df, "k", ["pos"], {"p": F.col("pos")}, 14).collect():
        assert [x.p for x in r.trend] == sorted(pos for k, pos, _ in rows if k == r.k)[-14:]
    assert recent_per_key(df, "k", ["pos"], 2).groupBy("k").count().agg(F.max("count")).first()[0] == 2


def test_pages_do_not_overlap_and_know_the_end(spark):
    df = spark.range(45).withColumnRenamed("id", "n")
    seen, offset = [], 0
    while True:
        rows = page(df, [F.desc("n")], 20, offset).orderBy("rn").collect()
        seen += [r.n for r in rows]
        if not rows[0].has_more:
            break
        offset += 20
    assert seen == list(range(44, -1, -1))
    second = page_after(df.withColumn("tie", F.lit(0)), "n", "tie", (25, 0), 20).orderBy("rn").collect()
    assert [r.n for r in second] == list(range(24, 4, -1)) and second[0].has_more
    assert page(df, [F.desc("n")], 1000).count() == 45
    for limit, offset in ((0, 0), (5, -1), (10_001, 0), (1, 10_000)):
        with pytest.raises(ValueError):
            page(df, [F.desc("n")], limit, offset)


def test_lookup_join_of_a_hot_key(spark):
    rows, df = skewed(spark)
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, x int")
    assert lookup_join(df, lookup, ["k"]).columns == ["k", "pos", "v", "x"]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    for threshold in ("10m", "-1"):
        for k, v in (conf | {"spark.sql.autoBroadcastJoinThreshold": threshold}).items():
            spark.conf.set(k, v)
        got = lookup_join(df, lookup, ["k"]).collect()
        assert sorted((r.k, r.pos, r.x) for r in got if r.x) == sorted((k, p, 1 if k == "hot" else 2) for k, p, _ in rows if k in ("hot", "k1"))
        assert len(got) == len(rows) and lookup_join(df, lookup, ["k"], "left_semi").columns == df.columns
    for k, v in before.items():
        spark.conf.set(k, v)


def test_any_list_never_multiplies(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, n int")
    lists = {
        "one": (spark.createDataFrame([("a", "z"), ("a", "y")], "k string, label string"), "label"),
        "two": (spark.createDataFrame([("a", "q"), (None, "q")], "k string, label string"), "label"),
    }
    assert sorted(in_any_list(df, "k", lists).select("k", "n", "one", "two").collect()) == [("a", 1, "y", "q"), ("a", 2, "y", "q")]


def test_without_keeps_null_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    other = spark.createDataFrame([("a",), ("a",)], "k string")
    assert sorted(without(df, other, "k").collect(), key=str) == [("b",), (None,)]
