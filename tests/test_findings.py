"""Hashes and false positives, against plain Python on small rows."""

import hashlib
import itertools
import json
import random

from rulewatch.functions.hashing import fp_row_hash, row_hash
from rulewatch.operators.findings import flag_false_positives, run_counts, run_result, set_hash

FINDINGS = "test_name string, day int, b string, a int"
FPS = "fp_id string, test_name string, row_hash string, match_criteria string, marked_by string, marked_at int, note string, active boolean"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_set_hash_skips_null_and_fp_hash_does_not(spark):
    df = spark.createDataFrame([("x", None, "y", 1), ("x", "y", None, 1)], "a string, b string, c string, ArchiveDate int")
    rows = df.select(row_hash(df.columns).alias("r"), fp_row_hash(df.columns).alias("f")).collect()
    assert rows[0].r == rows[1].r == sha("x|y")
    assert [r.f for r in rows] == [sha("x||y"), sha("x|y|")]


def test_fingerprint_tells_multisets_apart(spark):
    sets = {
        1: [("a", 1), ("b", 2)], 2: [("b", 2), ("a", 1)], 3: [("a", 1), ("b", 2), ("b", 2)],
        4: [("a", 1), ("a", 1), ("b", 2)], 5: [("a", 2), ("b", 1)],
    }
    rows = [("r", day, b, a) for day, items in sets.items() for b, a in items]
    got = {r.day: r.incident_hash for r in set_hash(spark.createDataFrame(rows, FINDINGS), ["test_name", "day"]).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 4


def brute_force(finding, fps):
    """First active false positive that the finding matches, by (marked_at, id)."""
    name, _, b, a = finding
    cells = {"a": "" if a is None else str(a), "b": "" if b is None else b}
    whole = sha(f"{cells['a']}|{cells['b']}")
    hits = []
    for fp_id, test, stored, criteria, _, at, _, active in fps:
        if test != name or not active:
            continue
        try:
            parsed = json.loads(criteria) if criteria else None
        except ValueError:
            parsed = None
        if parsed:
            match = all(c["column"] in cells and cells[c["column"]] == ("" if c["value"] is None else str(c["value"])) for c in parsed)
        else:
            match = bool(stored) and stored == whole
        if match:
            hits.append((at, fp_id))
    return min(hits)[1] if hits else None


def random_case(seed):
    dice = random.Random(seed)
    values, numbers = [None, "", "x", "y"], [None, 0, 1]
    findings = [(f"r{dice.randrange(4)}", dice.randrange(3), dice.choice(values), dice.choice(numbers)) for _ in range(120)]
    # One rule holds a third of all rows, and most of those are copies.
    findings += [("hot", 1, "x", 1)] * 60
    fps = []
    for i in range(40):
        kind = dice.randrange(7)
        one = {"column": "a", "value": dice.choice(["0", "1", None, 1])}
        two = {"column": "b", "value": dice.choice(["x", "", None])}
        criteria = [
            json.dumps([one]), json.dumps([two]), json.dumps([one, two]), json.dumps([{"column": "ghost", "value": "1"}, one]),
            "[{broken", None, "[]",
        ][kind]
        stored = dice.choice([None, "", sha("1|x"), sha("|y"), sha("0|")])
        fps.append((f"F{i}", dice.choice(["r0", "r1", "r2", "hot"]), stored, criteria, "u", dice.randrange(5), "n", dice.random() < 0.8))
    return findings, fps


def test_false_positives_equal_brute_force(spark):
    for seed in range(3):
        findings, fps = random_case(seed)
        df, fp_df = spark.createDataFrame(findings, FINDINGS), spark.createDataFrame(fps, FPS)
        keys = ["test_name", "day"]
        got = sorted(
            (r.test_name, r.day, r.b or "", str(r.a), r._fp_id or "", r._is_false_positive)
            for r in flag_false_positives(df, fp_df, keys, attribute=True).collect()
        )
        want = []
        for f in findings:
            fp = brute_force(f, fps)
            want.append((f[0], f[1], f[2] or "", str(f[3]), fp or "", fp is not None))
        assert got == sorted(want)

        counts = {(r.test_name, r.day): (r.row_count, r.clean_count) for r in run_counts(df, fp_df, keys).collect()}
        for key, group in itertools.groupby(sorted(findings, key=lambda f: f[:2]), key=lambda f: f[:2]):
            group = list(group)
            assert counts[key] == (len(group), sum(brute_force(f, fps) is None for f in group))
        # Merging copies first leaves the fingerprint as it is over all rows.
        whole = {(r.test_name, r.day): r.incident_hash for r in set_hash(df, keys).collect()}
        assert whole == {(r.test_name, r.day): r.incident_hash for r in run_counts(df, fp_df, keys).collect()}


def test_no_false_positives_flags_nothing(spark):
    df = spark.createDataFrame([("r", 1, "x", 1)], FINDINGS)
    row = flag_false_positives(df, spark.createDataFrame([], FPS), ["test_name", "day"]).first()
    assert row._is_false_positive is False


def test_at_the_threshold_a_run_passes(spark):
    df = spark.createDataFrame([(5, 5), (6, 5), (0, -1)], "n int, t int")
    assert [r[0] for r in df.select(run_result(df.n, df.t)).collect()] == ["PASSED", "FAILED", "FAILED"]


def test_findings_may_hold_maps_structs_and_lists(spark):
    found = spark.sql("""SELECT 'r' AS test_name, id % 2 AS day, map('k', concat('v', id % 3)) AS m, named_struct('x', id % 3) AS s,
                         array(id % 3) AS l FROM range(12)""")
    fps = spark.createDataFrame([("F", "r", None, '[{"column":"m","value":"{k -> v1}"}]', "u", 1, "n", True),
                                 ("G", "r", None, '{"column":"s","value":"{2}"}', "u", 1, "n", True)], FPS)
    flagged = flag_false_positives(found, fps, ["test_name", "day"]).collect()
    assert len(flagged) == 12 and all(r._is_false_positive == (r.m["k"] == "v1") for r in flagged)
    one = flag_false_positives(found.drop("test_name"), fps, ["day"], attribute=True, rule="r").collect()
    assert sorted(r._fp_id for r in one if r._is_false_positive) == ["F"] * 4 and len(one) == 12
    assert {r.clean_count for r in run_counts(found, fps, ["test_name", "day"]).collect()} == {4}
