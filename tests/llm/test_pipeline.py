"""The pipeline against its stages done by brute force, and its registration."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as spark_entry
import corpus_pipeline
from rulewatch.llm import decontaminate, quality, queries, simhash, similar, suffixes
from test_encoding import brute_hits
from test_repeats import near_rows
from test_similar import shingles, similarity


def test_registered():
    found = spark_entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(found)
    assert sorted({k.split("_")[0] for k in queries.QUERIES}) == sorted(f"op{n}" for n in range(1, 14))


def test_stages_like_brute_force(spark, tmp_path):
    rows = near_rows(8)
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 40]
    items = [(1, " ".join(texts[3].split()[5:30])), (2, "not here at all"), (None, None), (3, "")]
    docs = spark.createDataFrame([(k, t, lang, "src", n) for k, t, lang, n in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    read = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [(r["doc_id"], r["text"]) for r in quality.keep_good(read, labels).collect()]
    assert 0 < len(kept) <= len(rows)
    # Near duplicates: chains of texts whose five-word shingles are alike by 0.8 or more.
    sets, root = [shingles(t) for _, t in kept], list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    groups: dict = {}
    for (key, t), r in zip(kept, root):
        groups.setdefault(r, []).append((key is None, key or 0, t))
    first = [(None if min(g)[0] else min(g)[1], [t for none, k, t in g if (none, k) == min(g)[:2]]) for g in ([(a, b, c or "") for a, b, c in g] for g in groups.values())]
    # Rows that share an id and a group may stand for one another: take those with one text only.
    chosen = [(key, options[0]) for key, options in first if len(set(options)) == 1]
    assert len(chosen) == len(first)
    data = [t.encode() for _, t in chosen]
    seen = Counter(t[k : k + 200] for t in data for k in range(len(t) - 199))
    want = []
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for (key, _), t in zip(chosen, data):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if gone.any() and not left or brute_hits(left, items)[-1]:
            continue
        ids = library.encode(left, add_special_tokens=False).ids
        want.append((str(key), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in got) == sorted(want)


def test_stages_on_empty_tables(spark, tmp_path):
    tables = {"documents": "doc_id long, text string, lang string, source string, n_chars int", "labels": "doc_id long, quality int", "benchmark": "item_id long, text string"}
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_keep_columns_of_any_name(spark):
    """Names that need quotes, and names that the operators use themselves."""
    names = ["my col", "a.b", "__id", "__row", "__row_", "doc", "row", "order", "Key"]
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (2, words + " more"), (3, "something else. " * 30), (4, None), (5, "a passage of a benchmark item that is long enough to be found here today")]
    quoted = [f"'{n} ' || doc_id AS `{n}`" for n in names]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS int) AS n_chars", *quoted)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([(1, rows[4][1])], "item_id long, text string")
    stages = {
        "quality": (quality.keep_good(docs, labels), {1, 2, 3, 4, 5}),
        "similar": (similar.keep_one(docs), {1, 3, 4, 5}),
        "simhash": (simhash.keep_one(docs), None),
        "suffixes": (suffixes.keep_unrepeated(docs), None),
        "decontaminate": (decontaminate.keep_clean(docs, items), {1, 2, 3, 4}),
    }
    for stage, (df, ids) in stages.items():
        assert df.columns == docs.columns, stage
        found = df.collect()
        assert found and (ids is None or {r["doc_id"] for r in found} == ids), stage
        assert all(r[n] == f"{n} {r['doc_id']}" for r in found for n in names), stage
