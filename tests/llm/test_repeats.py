"""SimHash components, repeated strings and windows against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rulewatch.llm import brown, graph, simhash, sketch, suffixes, windows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def passages(seed, words=40):
    """Texts that share passages of many lengths, at many places; odd texts; repeated rows."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdéß") for _ in range(rng.randrange(1, 9))) for _ in range(words)]
    some = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    shared = [some(n) for n in (12, 30, 49, 50, 51, 80, 200)]
    texts = [" ".join(rng.choice([some(rng.randrange(40)), rng.choice(shared)]) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    texts += [None, "", " \n\t", "x", shared[-1], shared[-1].upper(), "same " * 400, "same  " * 90, "a" * 700, "ab" * 300, some(4000), texts[0], texts[0] + " end", "é" * 150, "\0" * 250]
    rows = [(i * 3 % 101, t, "en", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[1], None, 0), (5, texts[2], "fr", 1), (5, texts[2], "fr", 1)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, n_chars int").repartition(3)


def brute_bytes(rows, width):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    for (key, *_), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        yield str(key), len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("hot", [suffixes.HOT, 2, 6])
def test_repeated_strings_like_brute_force(spark, hot):
    rows = passages(1)
    got = suffixes.remove_repeats(frame(spark, rows), hot=hot).withColumn("kept", F.sha2("kept", 256))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(brute_bytes(rows, 200))


@pytest.mark.parametrize("width,head", [(40, 8), (33, 16)])
def test_other_widths(spark, width, head):
    rows = passages(2, words=6)
    got = suffixes.remove_repeats(frame(spark, rows), width=width, head=head).withColumn("kept", F.sha2("kept", 256))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(brute_bytes(rows, width))


def test_rows_kept_without_repeats(spark):
    rows = passages(3)
    got = suffixes.keep_unrepeated(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "n_bytes", "n_chars"]
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    want = []
    for (key, text, lang, n), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if not gone.any():
            want.append((str(key), kept, str(lang), n))
        elif kept:
            want.append((str(key), kept, str(lang), len(kept)))
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got.collect()) == sorted(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=7).map(sorted), max_size=7))
def test_merge_of_runs(runs):
    shared = [[0, *map(suffixes.common_prefix, r, r[1:])][: len(r)] for r in runs]
    order, prefixes = suffixes.merge(list(zip(runs, shared)))
    merged = [runs[a][b] for a, b in order]
    assert merged == sorted(x for r in runs for x in r) and len(set(order)) == len(order)
    assert prefixes[1:] == [suffixes.common_prefix(x, y) for x, y in zip(merged, merged[1:])]


def test_runs_survive_coding():
    rights, lefts = sorted([b"", b"abc", b"abd" * 60, b"abd" * 66 + b"z"]), [b"x", b"", b"y" * 168, b"q"]
    context = np.arange(8, dtype=np.uint64).reshape(4, 2)
    got = suffixes.read_run(suffixes.write_run(rights, lefts, np.array([1, 2, 900, 1]), context))
    assert got[0] == rights and got[2] == lefts and got[3].tolist() == [1, 2, 2, 1] and (got[4] == context).all()


def brute_windows(rows, width):
    words = [WORD.findall((t or "").encode()) for _, t, *_ in rows]
    ids = [float("inf") if k is None else k for k, *_ in rows]
    first: dict = {}
    for key, w in zip(ids, words):
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(first.get(x, key), key)
    for (key, *_), own, w in zip(rows, ids, words):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < own:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        yield str(key), len(w), sum(gone), kept.decode()


@pytest.mark.parametrize("width", [50, 9, 5])
def test_windows_like_brute_force(spark, width):
    rows = passages(4, words=12)
    got = windows.remove_repeats(frame(spark, rows), width=width).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(brute_windows(rows, width))


def test_sketch_never_loses(spark):
    rng = np.random.default_rng(0)
    bits = 16
    chunks = [np.unique(rng.integers(0, 5000, 900).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) for _ in range(5)]
    counts = [rng.integers(1, 4, len(c)) for c in chunks]
    parts = [r for i, (c, n) in enumerate(zip(chunks, counts)) for r in sketch.parts(i, c, n, bits).to_pylist()]
    rows = spark.createDataFrame([tuple(r.values()) for r in parts], sketch.PART)
    flags = {r["chunk"]: [x.asDict() for x in r["flags"]] for r in sketch.levels(rows, hot=7).collect()}
    total = Counter()
    for c, n in zip(chunks, counts):
        total.update(dict(zip(c.tolist(), n.tolist())))
    wrong = 0
    for i, c in enumerate(chunks):
        for key, level in zip(c.tolist(), sketch.estimate(c, flags[i], bits)):
            true = (total[key] >= 2) + (total[key] >= 7)
            assert level >= true
            wrong += level != true
    assert wrong < 0.02 * sum(map(len, chunks))


def brute_links(values, groups, radius):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i + 1, len(values)):
            if groups[i] == groups[j] and (int(values[i]) ^ int(values[j])).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(values))]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 1 << 32), st.sampled_from([1, 3, 4, 6]), st.sampled_from([3, 40, 170]))
def test_bit_sliced_links(seed, radius, most):
    rng = np.random.default_rng(seed)
    groups = np.repeat(np.arange(6), rng.integers(0, most, 6))
    values = rng.integers(0, 1 << 63, 3, dtype=np.uint64)[rng.integers(0, 3, len(groups))]
    for _ in range(rng.integers(0, 8)):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, len(groups)).astype(np.uint64))
    assert simhash.linked(groups, values, radius).tolist() == brute_links(values, groups, radius)


def brute_print(text, width=3):
    words = WORD.findall((text or "").encode().lower())
    runs = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_rows(seed):
    rng = random.Random(seed)
    rows = passages(seed)
    for i in range(25):
        words = rows[i % 9][1].split(" ") if rows[i % 9][1] else ["a"]
        if len(words) > 60:
            words[rng.randrange(len(words))] = "new"
        rows.append((200 + i, " ".join(words), "en", 0))
    return rows


@pytest.mark.parametrize("tile", [simhash.TILE, 2])
def test_components_like_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = near_rows(6)
    prints = [brute_print(t) for _, t, *_ in rows]
    root = brute_links(prints, [0] * len(rows), 3)
    ids: dict = {}
    for (key, *_), r in zip(rows, root):
        ids.setdefault(r, []).extend([] if key is None else [key])
    want = [(str(k), format(p, "016x"), min(ids[r], default=None)) for (k, *_), p, r in zip(rows, prints, root)]
    got = simhash.document_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == sorted(want)
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "n_bytes", "n_chars"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(min(v, default=None)) for v in ids.values())


def test_spark_hashes_alike(spark):
    rows = spark.createDataFrame([("a b c",), ("é x",), ("w" * 99,)], "s string").select("s", F.xxhash64("s").alias("h")).collect()
    assert all(r["h"] % (1 << 64) == xxhash.xxh64_intdigest(r["s"].encode(), 42) for r in rows)


def test_long_chains_are_one_component(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (-5, 100), (7, 7), (1, 0)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | dict.fromkeys((100, 90, 95, -5), -5)


def test_empty_tables(spark):
    none = frame(spark, passages(1)).limit(0)
    for f in (suffixes.digests, windows.digests, simhash.document_duplicates, suffixes.keep_unrepeated, simhash.keep_one, brown.document_scores):
        assert f(none).collect() == []
