"""Near duplicates by shingle similarity against brute force, with planted copies."""

import random
import re

import pytest

import corpus_pipeline
from rulewatch.llm import similar

SCHEMA = "doc_id long, text string, lang string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, least, most):
    """A copy whose similarity lies in the range: one word after another is changed."""
    while True:
        out = list(words)
        while (now := similarity(shingles(" ".join(words)), shingles(" ".join(out)))) >= most:
            out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
        if now >= least:
            return " ".join(out)


def planted(seed, copies):
    rng = random.Random(seed)
    rows = [(None, None, "en"), (900, "", "en"), (901, "Only three words", "en"), (902, "only three words", "en"), (903, "only three others", "en")]
    for base in range(24):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice((60, 150, 400)))]
        rows.append((1000 * (base + 1), " ".join(words), "en"))
        for i in range(copies):
            least = rng.choice((0.6, 0.7, 0.8, 0.85, 0.9))
            rows.append((1000 * (base + 1) + i + 1, edited(rng, words, least, least + 0.05 if least < 0.8 else 0.96), "en"))
    rng.shuffle(rows)
    return rows


def kept_by_brute_force(rows):
    sets, root = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    groups: dict = {}
    for i, (key, *_) in enumerate(rows):
        groups.setdefault(find(i), []).append((key is None, key or 0))
    return sorted("None" if none else str(key) for none, key in map(min, groups.values()))


@pytest.mark.parametrize("tile", [similar.TILE, 1500])
def test_planted_copies_go(spark, monkeypatch, tile):
    monkeypatch.setattr(similar, "TILE", tile)
    rows = planted(5, 6)
    kept = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == kept_by_brute_force(rows)


def test_no_rows(spark):
    assert similar.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def exchanged(df):
    """The columns that exchanges of a plan move, as texts."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\) Exchange\nInput[^:]*: \[(.*?)\]", plan)


def test_texts_do_not_move(spark):
    """Only keys, groups and the rows to keep go through exchanges, however large the tables are."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = exchanged(similar.keep_one(spark.createDataFrame(planted(6, 2), SCHEMA)))
        assert moved and not any("text" in columns for columns in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_small_shares(spark, monkeypatch):
    """Chunks that are asked for few groups at a time, and texts that send their shingles one by one."""
    for name, value in (("TILE", 700), ("SHARE", 1), ("SENT", 1)):
        monkeypatch.setattr(similar, name, value, raising=False)
    words = [f"w{i}" for i in range(300)]
    rng = random.Random(7)
    rows = planted(8, 1) + [(50000 + i, edited(rng, words, 0.8, 0.97), "en") for i in range(12)]
    rows += [(60001, "same id, one text " * 9, "en"), (60001, "another text of that id " * 9, "de"), (60002, None, None)]
    assert sorted(str(r["doc_id"]) for r in similar.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()) == kept_by_brute_force(rows)


def test_rows_come_back_whole(spark):
    """Null and empty texts stay apart, and ids may be of any type."""
    rows = [("b", "", 1), ("a", None, 2), ("c", "one text of a few words", 3), (None, "one text of a few words", 4), ("d", "", 5), ("é", "two", 6)]
    kept = similar.keep_one(spark.createDataFrame(rows, "doc_id string, text string, n int"))
    assert sorted(map(tuple, kept.collect())) == [("a", None, 2), ("c", "one text of a few words", 3), ("é", "two", 6)]
    assert [tuple(r) for r in similar.keep_one(spark.createDataFrame(rows[:1], "doc_id string, text string, n int")).collect()] == [("b", "", 1)]
