"""Quality scores from labelled documents.

Method: random Fourier features approximate a Gaussian kernel over statistics of the text; the
normal equations of a ridge regression are summed over partitions and solved on the driver;
isotonic calibration then turns raw scores into shares of good documents.

Statistics are computed once, in one pass over the texts, and stored.  What reaches the driver
has a fixed size: moments of the statistics, one matrix of ``features`` squared (summed as a
tree, so no task holds more than a few), and a histogram of raw scores.

Cases: a null or empty text has statistics of zero and is scored like any other; labels that are
null, without document or not 0 or 1 are not used; repeated labels count repeatedly; a document
without id is scored and never learned from; without any usable label every score is 0.5.
"""

from __future__ import annotations

import dataclasses
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rulewatch.llm.common import as_bytes, slices, stored

FEATURES = 256  # random features
RIDGE = 1e-4  # per training row
BINS = 2048  # of the calibration histogram
LOW, HIGH = -0.5, 1.5  # raw scores beyond count as these
THRESHOLD = 0.3
STATISTICS = 22

_KINDS = np.zeros((10, 256))
for _row, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b"!", b".,;:?'\"-()", b"#$%&*@^~|<>{}[]=+_/\\`", b"aeiouAEIOU", bytes(range(128, 256)), bytes(range(32)))):
    _KINDS[_row, list(_bytes)] = 1


def statistics(text: bytes) -> list[float]:
    """Numbers that describe a text; all zero if it is empty."""
    if not text:
        return [0.0] * STATISTICS
    size = len(text)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (_KINDS @ seen / size).tolist()
    some = seen[seen > 0] / size
    words = text.lower().split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = text.split(b"\n")
    pairs = len(set(zip(words, islice(words, 1, None))))
    long_lines = sum(map(len, map(bytes.strip, set(lines))))
    return [
        np.log1p(size), np.log1p(n), (size - seen[32]) / n, len(counts) / n,
        max(counts.values(), default=0) / n, sum(map(eq, words, islice(words, 1, None))) / n, pairs / n,
        np.log1p(len(lines)), len(set(lines)) / len(lines), long_lines / size, float(-(some * np.log(some)).sum()),
        max(map(len, words), default=0) / 32.0, *shares,
    ]


def document_statistics(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, stats``: the statistics of each whole text."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for part in slices(batches, "text"):
            flat = np.array([statistics(x) for x in as_bytes(part.column("text"))], np.float64).ravel()
            offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * STATISTICS)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["key", "stats"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, stats array<double>").withColumnRenamed("key", key)


@dataclasses.dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores
    shares: np.ndarray  # calibrated scores at the knots

    def expand(self, stats: np.ndarray) -> np.ndarray:
        """Standardized statistics, random Fourier features and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases)
        return np.hstack((waves, z / np.sqrt(z.shape[1]), np.ones((len(z), 1))))

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.expand(stats) @ self.weights, LOW, HIGH)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.shares)


def isotonic(counts: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool neighbours that fall: rising shares of good rows, at the centres of the pools."""
    width = (HIGH - LOW) / len(counts)
    pools: list[list[float]] = []  # rows, good rows, sum of centres by rows
    for i in np.flatnonzero(counts):
        pools.append([counts[i], good[i], counts[i] * (LOW + (i + 0.5) * width)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    if not pools:
        return np.array([0.0]), np.array([0.5])
    n, g, at = np.array(pools).T
    # A share next to, not at, 0 and 1, and a slight slope within pools, keeps the order of scores.
    knots, shares = np.concatenate(([LOW], at / n, [HIGH])), (g + 0.5) / (n + 1)
    shares = np.concatenate(([shares[0] / 2], shares, [(shares[-1] + 1) / 2]))
    return knots, np.maximum.accumulate(shares)


def _matrix(stats: pa.Array) -> np.ndarray:
    return stats.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def fit(training: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = 7) -> Model:
    """Learn from rows of ``stats`` (array) and ``good`` (0 or 1)."""
    moments = training.select(F.posexplode("stats").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale"))
    found = {r["at"]: (r["mean"], r["scale"]) for r in moments.collect()}  # one row a statistic
    mean, scale = (np.array([found.get(i, (0.0, 1.0))[k] for i in range(STATISTICS)]) for k in (0, 1))
    random = np.random.default_rng(seed)
    waves = random.standard_normal((STATISTICS, features)) / np.sqrt(STATISTICS)
    phases = random.uniform(0, 2 * np.pi, features)
    start = Model(mean, np.where(scale > 1e-9, scale, 1.0), waves, phases, np.zeros(0), np.zeros(1), np.full(1, 0.5))
    size = features + STATISTICS + 1

    def equations(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            x = start.expand(_matrix(batch.column("stats")))
            total += x.T @ np.column_stack((x, batch.column("good").to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = training.mapInArrow(equations, "part binary").rdd.map(lambda r: np.frombuffer(r["part"]).reshape(size, size + 1))
    total = parts.treeReduce(np.add, depth=3)
    rows = total[-1, -2]
    if not rows:
        return dataclasses.replace(start, weights=np.zeros(size))
    weights = np.linalg.solve(total[:, :-1] + (ridge * rows + 1e-9) * np.eye(size), total[:, -1])
    model = dataclasses.replace(start, weights=weights)

    def raw(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column("stats")))), batch.column("good")], ["raw", "good"])

    at = F.least(F.lit(BINS - 1), F.floor((F.col("raw") - LOW) / (HIGH - LOW) * BINS)).cast("int")
    bins = training.mapInArrow(raw, "raw double, good double").groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.sum("good").alias("good")).collect()
    counts, good = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        counts[r["at"]], good[r["at"]] = r["n"], r["good"]
    knots, shares = isotonic(counts, good)
    return dataclasses.replace(model, knots=knots, shares=shares)


def score(stats: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    rows = stats.select(F.col(key).alias("key"), "stats")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(model.score(_matrix(batch.column("stats"))))], ["key", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def fold(key: str, parts: int) -> Column:
    """crc32 of the id as text, modulo a number; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def learn(stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """A model from the labelled documents outside the held-out fifth of the ids."""
    good = labels.where(F.col("quality").isin(0, 1)).select(key, F.col("quality").cast("double").alias("good"))
    return fit(stored(stats.join(good, key).where(fold(key, 5) != 0).select("stats", "good"), "quality"))


def quality_scores(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``; a fifth of the ids is never learned from."""
    stats = stored(document_statistics(documents), "quality")
    return score(stats, learn(stats, labels)).select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, of documents that score the threshold or more."""
    model = learn(stored(document_statistics(documents), "quality"), labels)
    names = documents.columns
    places = [f"c{i}" for i in range(len(names))]  # names with dots cannot be handed to tasks
    text = places[names.index("text")]

    def run(batches):
        for part in slices(batches, text):
            scores = model.score(np.array([statistics(x) for x in as_bytes(part.column(text))]))
            yield part.rename_columns(names).filter(pa.array(scores >= threshold))

    return documents.toDF(*places).mapInArrow(run, documents.schema)
