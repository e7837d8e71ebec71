"""The log of runs: levels, repeats, races, and what a daily run reads."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rulewatch.operators.alerts import classify_history
from rulewatch.sources.archive import moment_of, publish, publish_replaced, published, read_published
from rulewatch.sources.levels import RUN, Levels
from rulewatch.sources.logs import RUNS, RunLog, previous_of
from rulewatch.sources.schemas import to_schema
from rulewatch.sources.versions import Versions

SCHEMA = "k string, v int"


def put(levels, k, v, at, table="t"):
    rows = levels.stamped(levels.spark.createDataFrame([(k, v)], SCHEMA), F.timestamp_micros(F.lit(at)), levels.versions.current()[0] + 1)
    part = levels.write(table, rows)
    levels.versions.update(lambda d, n: d | {table: [*d.get(table, []), part]})


def rows_of(levels, **how):
    return sorted((r.k, int(r._run.timestamp() * 1_000_000), r.v) for r in levels.read("t", to_schema(SCHEMA), ["k"], **how).collect())


def test_levels_keep_the_last_writing(spark, tmp_path):
    levels, rng, want = Levels(spark, str(tmp_path), fanout=3), random.Random(4), {}
    for i in range(24):
        key = ("ab"[i % 2], rng.randrange(1, 12))
        want[key] = i
        put(levels, key[0], i, key[1])
        if i % 5 == 4:
            levels.merge("t", to_schema(SCHEMA), ["k"])
            assert rows_of(levels) == sorted((*k, v) for k, v in want.items())
    counts = [p["level"] for p in levels.parts("t")]
    assert max(counts) >= 2 and all(counts.count(c) < 3 for c in counts)
    assert rows_of(levels, before=6) == sorted((*k, v) for k, v in want.items() if k[1] < 6)
    # Merged parts are sorted.
    big = max(levels.parts("t"), key=lambda p: p["level"])
    stored = [(r.k, r[RUN]) for r in spark.read.parquet(f"{tmp_path}/{big['path']}").collect()]
    assert stored == sorted(stored)


def test_a_merge_is_safe_to_repeat_and_to_lose(spark, tmp_path, monkeypatch):
    levels = Levels(spark, str(tmp_path), fanout=3)
    for i in range(3):
        put(levels, "a", i, i)
    other = Levels(spark, str(tmp_path), fanout=3)
    write = levels.write

    def slow(table, rows, *rest):
        part = write(table, rows, *rest)
        assert other.merge("t", to_schema(SCHEMA), ["k"]) == 1  # another one merges the same parts first
        put(other, "b", 9, 9)
        return part

    monkeypatch.setattr(levels, "write", slow)
    levels.merge("t", to_schema(SCHEMA), ["k"])
    assert rows_of(levels) == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("b", 9, 9)]
    assert levels.merge("t", to_schema(SCHEMA), ["k"]) == 0
    assert levels.unnamed(["t"]).count() == 4  # three merged parts and the lost one


def test_versions_are_taken_by_one_writer(spark, tmp_path):
    a, b = (Versions(spark, str(tmp_path)) for _ in range(2))
    assert a.commit(0, {"x": 1}) and not b.commit(0, {"x": 2}) and b.current() == (1, {"x": 1})
    assert b.update(lambda d, n: {"x": d["x"] + 10}) == {"x": 11}
    for i in range(25):
        a.update(lambda d, n: {"x": n})
    assert a.current() == (27, {"x": 27}) and len(a.numbers()) == 20
    assert a.update(lambda d, n: None) is None and a.current()[0] == 27


def test_a_lost_race_starts_from_the_winner(spark, tmp_path):
    folder = str(tmp_path)
    publish(spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string"), folder, "one")
    versions = Versions(spark, folder)
    tried = []

    def change(document, number):
        if not tried:
            publish_replaced(spark.createDataFrame([(2, "b")], "k int, v string"), folder, "k", "two")
        tried.append(number)
        return document

    versions.update(change)
    assert tried == [2, 3]
    assert sorted(map(tuple, read_published(spark, folder).collect())) == [(1, "a"), (2, "b")]


def test_readers_see_whole_versions(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(ValueError):
        read_published(spark, folder)
    publish(spark.range(3), folder, "a")
    # A writer that dies half-way leaves files that no version names.
    spark.range(100).write.parquet(f"{folder}/version=b/half")
    assert read_published(spark, folder).count() == 3
    old = read_published(spark, folder)
    publish(spark.range(5), folder, "b")
    publish(spark.range(7), folder, "b")
    assert old.count() == 3 and read_published(spark, folder).count() == 7
    assert read_published(spark, folder, "a").count() == 3 and [v["version"] for v in published(spark, folder)] == ["a", "b", "b"]


def state_rows(spark, rows):
    base = spark.createDataFrame(rows, "test_name string, execution_date timestamp, result string, is_suppressed boolean, incident_hash string")
    missing = {f.name: F.lit(None).cast(f.dataType) for f in to_schema(RUNS) if f.name not in base.columns}
    return base.withColumns(missing).withColumn("should_notify", F.lit(False))


def test_latest_state_follows_every_order_of_runs(spark, tmp_path):
    """Runs in order, repeated, repeated after later ones, and failing on a repeat, against the whole history."""
    log, rng, history = RunLog(spark, str(tmp_path), fanout=4), random.Random(9), {}
    times = [dt.datetime(2024, 1, 1, h) for h in range(8)]
    for i in range(14):
        at = times[min(i // 3, 7)] if rng.random() < 0.6 else rng.choice(times)
        names = rng.sample(["a", "b", "c"], rng.randint(1, 3))
        moment = moment_of(spark, at)
        asked = spark.createDataFrame([(n,) for n in names], "test_name string")
        before = log.before(moment, asked)
        got = {r.test_name: r for r in previous_of(before).collect()}
        for n in names:
            past = [(t, *history[m, t]) for m, t in sorted(history) if m == n and t < at]
            run = (past[-1][1], past[-1][2]) if past else None
            hashes = [h for _, r, _, h in past if r != "ERROR"]
            mine = got.get(n)
            assert (tuple(mine._prev_run) if mine and mine._prev_run else None) == run
            assert ([mine._prev_hash.incident_hash] if mine and mine._prev_hash else []) == hashes[-1:]
        rows = []
        for n in names:
            result = rng.choice(["ERROR", "FAILED", "PASSED"])
            history[n, at] = (result, rng.random() < 0.3, None if result == "ERROR" else rng.choice([None, "h1", "h2"]))
            rows.append((n, at, *history[n, at]))
        log.add(state_rows(spark, rows), before, moment)
    found = {(r.TestName, r.ExecutionDate): r.TestResult for r in log.read("tb_tests_executions").collect()}
    assert found == {k: v[0] for k, v in history.items()}
    hashes = {(r.test_name, r.execution_date): r.incident_hash for r in log.read("tb_incident_hashes").collect()}
    assert hashes == {k: v[2] for k, v in history.items() if v[0] != "ERROR"}


def test_a_daily_run_reads_as_much_of_an_old_log_as_of_a_new_one(spark, tmp_path):
    log = RunLog(spark, str(tmp_path))
    # A thousand runs in one taken-over part and some single ones; the live parts stay few.
    old = spark.range(1000).selectExpr("'a' AS TestName", "timestamp_micros(id * 1000000) AS ExecutionDate", "'FAILED' AS TestResult")
    log.adopt(old, "tb_tests_executions")
    names = spark.createDataFrame([("a",), ("b",)], "test_name string")
    read = []
    for i in range(10):
        moment = moment_of(spark, dt.datetime(2024, 1, 1 + i))
        before = log.before(moment, names)
        read.append(len(before.inputFiles()))
        log.add(state_rows(spark, [("a", dt.datetime(2024, 1, 1 + i), "FAILED", False, "h")]), before, moment)
    assert read[0] > 0 and set(read[1:]) == {1}
    assert len(log.levels.parts("runs")) == 3 and log.read("tb_tests_executions").count() == 1010


def test_logged_states_are_those_of_a_replay(spark, tmp_path):
    """Run by run from the latest state gives what one window over all history gives."""
    from rulewatch.operators.alerts import classify_after

    rng = random.Random(1)
    runs = [(n, d, rng.choice(["FAILED", "FAILED", "PASSED", "ERROR"]), rng.choice(["x", "y", None]), rng.random() < 0.2, True) for n in "ab" for d in range(6)]
    df = spark.createDataFrame(runs, "test_name string, d int, result string, incident_hash string, suppressed boolean, channel boolean")
    want = {(r.test_name, r.d): r.alert_state for r in classify_history(df, ["d"]).collect()}
    log = RunLog(spark, str(tmp_path))
    for d in range(6):
        moment = moment_of(spark, dt.datetime(2024, 1, 1 + d))
        today = df.where(F.col("d") == d)
        before = log.before(moment, today)
        missing = {f.name: F.lit(None).cast(f.dataType) for f in to_schema(RUNS) if f.name not in ("test_name", "result", "incident_hash", "channel", "is_suppressed", "is_recurrent", "is_continued", "should_notify", "alert_state")}
        stored = log.add(classify_after(today, previous_of(before)).withColumns(missing), before, moment)
        assert {r.test_name: r.alert_state for r in stored.collect()} == {n: s for (n, k), s in want.items() if k == d}
