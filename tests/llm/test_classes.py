"""Language-model classes: sweeps over all neighbours."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from rulewatch.llm import brown


def test_sweeps_count_every_neighbour(spark):
    """Words that never stand next to one of the exchanged words are placed by all their neighbours."""
    docs = [(i, "the of the of the") for i in range(40)] + [(100 + i, f"s p{i % 4} q{i % 5} p{i % 3} q{i % 4} s") for i in range(30)]
    chunks = brown.coded(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 7, 2)
    listed = brown.chunk_words(chunks)
    words = brown.vocabulary(chunks, *brown.seed_classes(chunks, listed, 2, 3))
    of = {r["word"]: r["class"] for r in words.collect()}
    found = brown.looked_up(listed, words)
    table = brown.class_bigrams(chunks, found, 3)
    learned = [["\n", *t.split(), "\n"] for k, t in docs if brown.fold(k, 7) != 2]
    want = np.zeros((4, 4))
    for t in learned:
        for a, b in zip(t, t[1:]):
            want[of[a], of[b]] += 1
    assert (table == want).all()
    smooth = table + 0.5
    gain = defaultdict(lambda: np.zeros(3))
    for t in learned:
        for a, w, b in zip(t, t[1:], t[2:]):
            gain[w] += np.log(smooth[of[a], :3] / smooth[of[a]].sum()) - np.log(smooth.sum(axis=0)[:3])
            gain[w] += np.log(smooth[:3, of[b]] / smooth[:3].sum(axis=1))
    got = {r["word"]: r["class"] for r in brown.swept(chunks, found, table).collect()}
    assert got.pop("\n") == 3 and set(got) == set(gain)
    assert all(gain[w][k] >= gain[w].max() - 1e-9 for w, k in got.items())
    assert len({of[w] for w in of if w[0] in "pq"}) > 1


def test_seeds_from_whole_vocabularies(spark):
    docs = [(i, " ".join([f"w{i}x{k}" for k in range(9)] * 3 + ["everywhere"] * 2)) for i in range(24)]
    chunks = brown.coded(spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(24, "doc_id"), 7, 2)
    assert "everywhere" in brown.seed_classes(chunks, brown.chunk_words(chunks), 1, 1)[0]


def test_counts_of_any_size_in_lists():
    key, n = np.array([1, 5, 6, 8, 17]), np.array([1, 65535, 65536, 3, (7 << 40) + 5])
    lists = brown.written(key, n, 6, 4)
    words = pa.array(["a", "b", "c", "d"])
    entries = pa.ListArray.from_arrays(pa.array([0, 2, 3, 4, 6], pa.int32()), pa.concat_arrays([lists.take([0, 0]), lists.slice(1), lists.take([2])]))
    batch = pa.RecordBatch.from_arrays([words, entries], ["word", "entries"])
    want = np.zeros((4, 6))
    want[0, [1, 5]] = 2, 2 * 65535
    want[1, [0, 2]] = 65536, 3
    want[2, 5] = (7 << 40) + 5
    want[3, 5] = (7 << 40) + 5
    for step in (1, 3, 4096):
        assert (np.concatenate([seen for _, _, seen in brown.totals(batch, 6, step)]) == want).all()


def test_counts_meet_in_steps(spark, monkeypatch):
    """Many chunks and a small fan: the same classes as when all lists of a word meet at once."""
    docs = [(i, f"a b{i % 7} a c{i % 5} b{i % 3} x{i}") for i in range(90)]
    chunks = brown.coded(spark.createDataFrame(docs, "doc_id long, text string").repartition(18), 7, 2)
    seeds = brown.seed_classes(chunks, brown.chunk_words(chunks), 6, 3)
    rows = lambda: sorted(map(tuple, brown.vocabulary(chunks, *seeds).select("word", "n", "class").collect()))
    want = rows()
    monkeypatch.setattr(brown, "FAN", 2)
    assert rows() == want and len(want) > 80


def test_chunks_and_parts_meet_in_single_rows(spark):
    """What a chunk gets back is a row from each part, not one for each of its words."""
    docs = [(i, " ".join(f"w{(i * 7 + k * k) % 900}" for k in range(60))) for i in range(90)]
    chunks = brown.coded(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 7, 2)
    listed = brown.chunk_words(chunks)
    words = brown.vocabulary(chunks, *brown.seed_classes(chunks, listed, 20, 3))
    found = brown.looked_up(listed, words)
    assert words.count() > 300
    assert 1 <= found.selectExpr("max(size(found)) x").first()["x"] <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert chunks.selectExpr("min(types) x").first()["x"] > 100


def test_words_learned_from_in_other_chunks_alone(spark, monkeypatch):
    """Each document is a chunk, so those held out hold words that their chunk does not learn from."""
    docs = [(i, f"A b{i % 7} a c{i % 5} Ünd{i % 3} x{i} {'long' * 300}{i % 4}") for i in range(40)] + [(None, "a b1 nowhere"), (50, None)]
    learned = lambda k: k is not None and brown.fold(k, 7) != 2
    tokens = [[w.decode() for w in (t or "").encode().lower().split()] + ["\n"] for _, t in docs]
    known = Counter(w for (k, _), t in zip(docs, tokens) if learned(k) for w in t)
    want = sorted((str(k), len(t), sum(known[w] > 0 for w in t), sum(known.values())) for (k, _), t in zip(docs, tokens))
    assert any(not learned(k) and k is not None for k, _ in docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(12, "doc_id")
    scores = []
    for fan, size in ((1 << 17, 16 << 20), (3, 16 << 20), (1 << 17, 2000)):
        monkeypatch.setattr(brown, "FAN", fan)
        monkeypatch.setattr(brown, "PART_BYTES", size, raising=False)
        got = brown.document_scores(df, classes=3, seeds=6).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == want
        scores.append(sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got))
    assert scores[0] == scores[1] == scores[2]
