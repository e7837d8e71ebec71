"""Alert states against a step-by-step replay, and the cases that surprise."""

import datetime as dt
import random


from rulewatch.operators.alerts import classify_history, classify_run, open_suppressions, rule_status

RUNS = "test_name string, day int, result string, incident_hash string, suppressed boolean, channel boolean"


def replay(runs):
    """The daily loop, one run after another: run log and hash log grow as it goes."""
    log, hashes, out = {}, {}, {}
    for name, day, result, this_hash, suppressed, channel in sorted(runs, key=lambda r: r[1]):
        state = {"sup": False, "rec": False, "con": False, "notify": channel and result == "FAILED"}
        if result == "FAILED":
            if suppressed:
                state.update(sup=True, notify=False)
            elif hashes.get(name) and hashes[name][-1] == this_hash:
                last_result, last_suppressed = log[name][-1]
                if last_result == "FAILED" and not last_suppressed:
                    state.update(con=True, notify=False)
                else:
                    state.update(rec=True)
        log.setdefault(name, []).append((result, state["sup"]))
        if result != "ERROR":
            hashes.setdefault(name, []).append(this_hash)
        out[name, day] = (state["sup"], state["rec"], state["con"], state["notify"])
    return out


def random_runs(seed, rules=60, days=30):
    dice = random.Random(seed)
    return [
        (
            f"r{r}", day, dice.choice(["PASSED", "FAILED", "FAILED", "ERROR"]),
            dice.choice([None, "a", "b"]), dice.random() < 0.2, dice.random() < 0.8,
        )
        for r in range(rules)
        for day in range(days)
    ]


def test_window_pass_equals_replay(spark):
    runs = random_runs(7)
    # An ERROR run has no hash of its own.
    runs = [(*r[:3], None if r[2] == "ERROR" else r[3], *r[4:]) for r in runs]
    states = classify_history(spark.createDataFrame(runs, RUNS), ["day"]).collect()
    got = {
        (s.test_name, s.day): (s.is_suppressed, s.is_recurrent, s.is_continued, s.should_notify)
        for s in states
    }
    assert got == replay(runs)
    assert {s.alert_state for s in states} == {"clean", "error", "suppressed", "continued", "recurrent", "new"}


def test_one_run_from_logs_equals_history(spark):
    runs = [(*r[:3], None if r[2] == "ERROR" else r[3], *r[4:]) for r in random_runs(11, rules=40, days=6)]
    history = classify_history(spark.createDataFrame(runs, RUNS), ["day"])
    past = history.where("day < 5")
    run_log = past.selectExpr(
        "test_name TestName", "day ExecutionDate", "result TestResult", "is_suppressed IsSupressed"
    )
    hash_log = past.where("result <> 'ERROR'").selectExpr("test_name", "day execution_date", "incident_hash")
    today = spark.createDataFrame([r for r in runs if r[1] == 5], RUNS)
    columns = ["test_name", "is_suppressed", "is_recurrent", "is_continued", "should_notify", "alert_state"]
    got = classify_run(today, run_log, hash_log).select(columns).orderBy("test_name").collect()
    assert got == history.where("day = 5").select(columns).orderBy("test_name").collect()


def states(spark, *runs):
    rows = [("r", i, result, h, sup, True) for i, (result, h, sup) in enumerate(runs)]
    out = classify_history(spark.createDataFrame(rows, RUNS), ["day"]).orderBy("day").collect()
    return [r.alert_state for r in out]


def test_same_findings_after_an_empty_run_are_new(spark):
    assert states(spark, ("FAILED", "a", False), ("PASSED", None, False), ("FAILED", "a", False)) == ["new", "clean", "new"]


def test_same_findings_after_an_error_are_recurrent(spark):
    assert states(spark, ("FAILED", "a", False), ("ERROR", None, False), ("FAILED", "a", False)) == ["new", "error", "recurrent"]


def test_same_findings_after_suppression_are_recurrent(spark):
    assert states(spark, ("FAILED", "a", True), ("FAILED", "a", False), ("FAILED", "a", False)) == ["suppressed", "recurrent", "continued"]


def test_same_rows_that_passed_before_are_recurrent(spark):
    assert states(spark, ("PASSED", "a", False), ("FAILED", "a", False)) == ["clean", "recurrent"]


def test_no_rows_twice_count_as_the_same(spark):
    # Only a negative threshold lets an empty run fail.
    assert states(spark, ("FAILED", None, False), ("FAILED", None, False)) == ["new", "continued"]


def test_a_missing_or_blank_entry_counts_as_open(spark):
    day = dt.date(2024, 1, 1)
    suppressions = spark.createDataFrame(
        [("T1", "E1", True, day), ("T2", "E2", True, day), ("T3", "gone", True, day), ("T4", "E1", False, day),
         ("T5", "E3", True, day), ("T6", None, True, day), (None, "E1", True, day)],
        "test_id string, linked_entry_id string, active boolean, created_at date",
    )
    entries = spark.createDataFrame(
        [("E1", None), ("E2", "2024-01-05"), ("E3", " ")], "RiskEntryId string, ClosingDate string"
    )
    got = {r.test_id for r in open_suppressions(suppressions, entries).collect()}
    assert got == {"T1", "T3", "T5", "T6"}


def test_all_seven_labels(spark):
    configs = spark.createDataFrame([(f"T{i}", f"r{i}") for i in range(8)], "test_id string, test_name string")
    log = spark.createDataFrame(
        [("r1", 1, "PASSED", False, False, False), ("r2", 1, "ERROR", False, False, False),
         ("r3", 1, "FAILED", False, True, False), ("r4", 1, "FAILED", False, True, False),
         ("r5", 1, "FAILED", False, False, True), ("r6", 1, "FAILED", True, False, False),
         ("r7", 1, "FAILED", False, False, True), ("r7", 2, "PASSED", False, False, False)],
        "TestName string, ExecutionDate int, TestResult string, IsSupressed boolean, IsRecurrent boolean, IsContinued boolean",
    )
    sup = spark.createDataFrame([("S1", "T3", True), ("S2", "T1", True)], "suppression_id string, test_id string, active boolean")
    got = {r.test_name: r.alert_status for r in rule_status(configs, log, sup).collect()}
    assert got == {
        "r0": "nunca_rodou", "r1": "sem_achados", "r2": "erro", "r3": "em_tratamento", "r4": "reincidente",
        "r5": "persistente", "r6": "novo_achado", "r7": "sem_achados",
    }
    stored = {r.test_name: r.alert_status for r in rule_status(configs, log).collect()}
    assert stored["r3"] == "reincidente" and stored["r6"] == "em_tratamento"
