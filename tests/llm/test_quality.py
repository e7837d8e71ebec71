"""Held-out accuracy, calibration, and documents kept."""

import zlib

import numpy as np
import pytest

from rulewatch.llm import quality

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.quality_scores(docs, labels).toPandas()
    assert len(scored) == docs.count() and scored.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(scored.doc_id, scored.held_out))
    both = scored[scored.held_out].merge(labels.toPandas(), on="doc_id")
    good, bad = both[both.quality == 1].score.to_numpy(), both[both.quality == 0].score.to_numpy()
    assert np.mean(good[:, None] > bad[None, :]) + np.mean(good[:, None] == bad[None, :]) / 2 > 0.97
    assert (both.predicted == both.quality).mean() > 0.95


def test_isotonic_shares_rise():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 9, quality.BINS).astype(float)
    knots, shares = quality.isotonic(counts, np.minimum(counts, rng.integers(0, 9, quality.BINS)))
    assert (np.diff(knots) > 0).all() and (np.diff(shares) >= 0).all() and 0 <= shares.min() <= shares.max() <= 1


TEXTS = [None, "", " ", "\n", "word " * 50_000, "é", "JUNK!! " * 40, "fine text, of many words."]


def frames(spark):
    docs = [(i, t, -1) for i, t in enumerate(TEXTS * 8)] + [(None, "no id", -1), (1, "", -1), (1, "", -1)]
    labels = [(i, i % 2) for i in range(60)] + [(3, None), (None, 1), (4, 7), (5, 1), (5, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_odd_rows_are_scored_and_kept_whole(spark):
    docs, labels = frames(spark)
    got = quality.quality_scores(docs, labels)
    assert got.count() == docs.count() and got.where("score is null or held_out is null or predicted is null").count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema and kept.count() == got.where("predicted = 1").count()


@pytest.mark.parametrize("none", ["labels", "documents"])
def test_empty_tables(spark, none):
    docs, labels = frames(spark)
    docs, labels = (docs.limit(0), labels) if none == "documents" else (docs, labels.limit(0))
    scores = {r["score"] for r in quality.quality_scores(docs, labels).collect()}
    assert scores <= {0.5}
