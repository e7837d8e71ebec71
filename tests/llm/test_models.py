"""Nearest neighbours, shards and language-model scores against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from rulewatch.llm import ann, brown, shards

FOLDER = "/root/testdata/sf0.01"


def neighbours(ids, vectors, every=20, k=20):
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            scores = vectors @ vectors[i]
            scores[i] = -np.inf
            out.setdefault(int(q), []).append([(int(ids[j]), scores[j]) for j in np.lexsort((ids, -scores))[: min(k, len(ids) - 1)]])
    return out


def recall(got, want, k):
    ranks: dict = {}
    for r in got:
        ranks.setdefault(r["query_id"], []).append(r)
    assert set(ranks) == set(want)
    hit = total = 0
    for q, rows in ranks.items():
        rows.sort(key=lambda r: r["rank"])
        scores = [r["score"] for r in rows]
        assert scores == sorted(scores, reverse=True)
        true = [v for v, _ in want[q][0]]
        assert len(rows) == len(true) * len(want[q])
        hit += len({r["vec_id"] for r in rows} & set(true))
        total += len(true)
    return hit / total


@pytest.mark.parametrize("kind", ["random", "clustered", "lengths"])
def test_recall(spark, kind):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((1500, 24)).astype(np.float32)
    if kind == "clustered":
        vectors = (5 * vectors[rng.integers(0, 40, 1500)] + vectors).astype(np.float32)
    if kind == "lengths":
        vectors *= rng.uniform(0.2, 3, (1500, 1)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    assert recall(ann.search(df).collect(), neighbours(np.arange(1500), vectors.astype(float)), 20) >= 0.9


def test_both_ways_find_the_same_codes():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, (4000, 4), dtype=np.uint64)
    codes[1000:] = codes[rng.integers(0, 1000, 3000)] ^ (np.uint64(1) << rng.integers(0, 64, (3000, 4)).astype(np.uint64))
    for radius in (0, 7, 15, 31, 40, 64):
        probing, scanning = ann.Index(codes, radius), ann.Index(codes, radius)
        assert (probing.masks is not None) == (radius < 48)
        scanning.masks = None
        for q in codes[:40]:
            for least in (0, 30):
                assert set(probing.within(q, least)) == set(scanning.within(q, least))


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (20, [None, 1.0]), (40, [float("nan"), 1.0]), (60, [float("inf"), 0.0])]
    rows += [(80, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (5, []), (100, [-1.0, 0.5]), (100, [-1.0, 0.5])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["query_id"] for r in got} == {0, 100}
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [(1, 1, 2.0), (2, 2, 2.0), (3, 100, -1.0), (4, 100, -1.0)]
    assert sum(r["query_id"] == 100 and r["vec_id"] == 100 for r in got) == 2
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def check_shards(rows, got, count, slack):
    assert len(got) == len(rows)
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(count))
    assert max(sizes.values()) - min(sizes[i] for i in range(count)) <= slack
    want = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_shards_of_near_equal_bytes(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    check_shards(rows, shards.document_shards(docs).collect(), 16, 2 * max(len(r[1].encode()) for r in rows))


def test_shards_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_ROWS", 7)
    rng = random.Random(0)
    rows = [(i, "x" * rng.randrange(50), None if i % 3 else "en", "hot", 0) for i in range(900)] + [(i, "copy", "en", "hot", 0) for i in range(700)]
    rows += [(None, None, None, None, None)] * 40 + [(7, "é" * 3000, "de", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int")
    check_shards(rows, shards.document_shards(df, 8).collect(), 8, 2 * 6001)
    assert shards.document_shards(df.limit(0)).collect() == []


def test_leaves_reach_the_target(spark):
    rows = spark.range(5000).selectExpr("id row", "cast(id % 7 as double) a", "cast(id as double) b", "id % 50 + 1 w")
    got = shards.partition(rows, ["a", "b"], "w", "row", target=9_000).groupBy("leaf").sum("w").collect()
    assert len(got) == 16 and max(r[1] for r in got) <= 9_000


def information(bigrams, label, classes):
    member = np.eye(classes)[label]
    table = member.T @ bigrams @ member
    logs = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return logs(table) - logs(table.sum(axis=0)) - logs(table.sum(axis=1))


def test_exchange_reaches_a_local_best():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 30)
    bigrams = rng.poisson(0.3 + 6.0 * (truth[:, None] == (truth[None] + 1) % 3)).astype(float)
    label = brown.exchange(bigrams, 3, rounds=50)
    best = information(bigrams, label, 3)
    assert best >= information(bigrams, np.arange(30) % 3, 3)
    for w in range(30):
        for k in range(3):
            other = label.copy()
            other[w] = k
            assert information(bigrams, other, 3) <= best + 1e-6


def texts():
    rng = random.Random(3)
    pool = [["the", "a", "of", "Ünd"], ["cat", "dog", "x" * 40, "é"], ["runs", "sleeps.", "9"]]
    out = [" ".join(rng.choice(p) for _ in range(rng.randrange(9)) for p in pool) for _ in range(200)]
    out += [None, "", " \n", "THE Cat runs", "never seen words", "the " * 5000, out[0], out[0]]
    return [(i, t, -1) for i, t in enumerate(out)] + [(None, "the cat", 0), (3, "dog", 0)]


def test_language_model(spark):
    rows = texts()
    got = brown.document_scores(spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3), classes=4, seeds=6).collect()
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    tokens = [[w.decode() for w in (t or "").encode().lower().split()] + ["\n"] for _, t, _ in rows]
    counts = Counter(w for (k, *_), t in zip(rows, tokens) if k is not None and not held(k) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(k), held(k), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for (k, *_), t in zip(rows, tokens))
    columns = ("held_out", "n_tokens", "n_known", "train_tokens")
    assert sorted((str(r["doc_id"]), *(r[c] for c in columns), round(r["base_score"], 6)) for r in got) == want
    assert sum(r["score"] - r["base_score"] for r in got if r["held_out"]) > 0
    assert all(r["score"] <= 0 for r in got)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([r for r in texts() if r[1] is None or len(r[1]) < 2000], "doc_id long, text string, x int")
    chunks = brown.coded(docs, 7, 2)
    words = brown.vocabulary(chunks, *brown.seed_classes(chunks, 5, 3))
    model = brown.fit(chunks, brown.looked_up(chunks, words), words, 3)
    known = words.collect()
    for before in range(4):
        total = 10 ** model.unseen[before]
        for r in known:
            emission = 1.0 if r["class"] == 3 else (r["n"] - model.discount) / 10 ** model.emission[r["class"]]
            total += 10 ** model.transitions[before, r["class"]] * emission
        assert abs(total - 1) < 1e-6
