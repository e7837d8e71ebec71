"""The language of a text, learned from documents with a known one.

Method: sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader (per-coordinate rates, elastic-net penalties), then one temperature
that makes the probabilities of rows kept from the training likeliest.

A text is lower-cased, runs of what is no letter become one space, and its n-grams of one to four
characters, words' borders included, are hashed to ``1 << BITS`` features.  The weight of a feature is
(1 + log count) times its inverse document frequency; a text's weights have length 1.

Document frequencies and counts of languages are taken over all training documents.  The regression
learns from a sample of them: about ``SAMPLE`` documents, shared evenly among the languages (a
language with fewer gives all it has).  The sample is dealt to ``SHARDS`` tasks; each goes through its
rows once a round, starting from the state (sums z and n) that all had agreed on, and the states are
averaged by rows.  What reaches the driver has a fixed size: counts and states, as trees of sums, a number of
languages times a number of features.  More than ``MOST_LANGUAGES`` languages are refused.

Cases: a null text, an empty one and one without letters is ``und`` with score 0; without training
documents every text is; with one language every text with letters is of that one, score 1; equal
probabilities go to the smaller name; a very long text is counted in pieces; rows without id are
predicted, and never learned from where the held-out fold is by id; repeated rows count each.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rulewatch.llm.common import Kept, slices, stored
from rulewatch.llm.quality import fold

BITS = 15
LONGEST = 4  # characters of an n-gram
PIECE = 1 << 18  # characters of a text that are counted at a time
SAMPLE, SHARDS, ROUNDS = 16_000, 8, 3
RATE, STEADY, LASSO, RIDGE = 2.0, 1.0, 0.05, 0.001
KEPT = 5  # every fifth row of the sample is kept for the temperature
TEMPERATURES = np.exp(np.linspace(np.log(0.02), np.log(20), 139))
MOST_LANGUAGES = 128
UNKNOWN = "und"


_LETTERS = Kept()
PLANES = 0x20000  # code points in the table; those beyond are asked one by one


def is_letter(points: np.ndarray) -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS["table"] = np.fromiter((chr(c).isalpha() for c in range(PLANES)), bool, PLANES)
    known = _LETTERS["table"][np.minimum(points, PLANES - 1)]
    for at in np.flatnonzero(points >= PLANES):
        known[at] = chr(points[at]).isalpha()
    return known


def characters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, one space for a run of anything but letters, a space at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.concatenate(([0], points, [0])).astype(np.uint32)
    known = is_letter(points)
    points[~known] = 32
    keep = known.copy()
    keep[0] = True
    keep[1:] |= known[:-1]  # the first after a letter stays, be it one or not
    return points[keep]


BASE, SPREAD = 0x9E3779B1, 0x85EBCA6B  # odd numbers: n-grams are polynomials of their code points modulo 2**32


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Features of a text and their counts; none if it has no letter."""
    total = 0
    for start in range(0, len(text), PIECE):
        points = characters(text[start : start + PIECE])
        if len(points) < 3:
            continue
        grams, found = points, [points[points != 32]]
        for length in range(2, LONGEST + 1):
            grams = grams[:-1] * np.uint32(BASE) + points[length - 1 :]
            found.append(grams)
        hashed = np.concatenate(found) * np.uint32(SPREAD) >> np.uint32(32 - BITS)
        total = total + np.bincount(hashed, minlength=1 << BITS)
    if not np.ndim(total):
        return None
    at = np.flatnonzero(total)
    return at, total[at]


def weights_of(at: np.ndarray, frequency: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of the features found, of length 1."""
    x = frequency * idf[at]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


class Leader:
    """Follow-the-regularised-leader: sums ``z`` and ``n`` for each language and feature (one is constant)."""

    def __init__(self, z: np.ndarray, n: np.ndarray, lasso: float = LASSO, ridge: float = RIDGE):
        self.z, self.n, self.lasso, self.ridge = z, n, lasso, ridge

    def at(self, features) -> np.ndarray:
        """Weights of some features: zero wherever the sums do not outweigh the lasso penalty."""
        z, n = self.z[:, features], self.n[:, features]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.lasso, 0)
        return -shrunk / ((STEADY + np.sqrt(n)) / RATE + self.ridge)

    def learn(self, features: np.ndarray, x: np.ndarray, label: int) -> None:
        weights = self.at(features)
        gradient = np.outer(_softmax(weights @ x) - (np.arange(len(self.z)) == label), x)
        n = self.n[:, features]
        squares = n + gradient**2
        self.z[:, features] += gradient - (np.sqrt(squares) - np.sqrt(n)) / RATE * weights
        self.n[:, features] = squares


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclasses.dataclass(frozen=True)
class Model:
    names: tuple[str, ...]  # languages, sorted
    idf: np.ndarray
    features: np.ndarray  # those with a weight for any language
    weights: np.ndarray  # languages by these features
    constant: np.ndarray  # of each language
    temperature: float = 1.0

    def table(self) -> np.ndarray:
        dense = np.zeros((1 << BITS, len(self.names)))
        dense[self.features] = self.weights.T
        return dense

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        table, names, scores = self.table(), [], []
        for text in texts:
            found = counts_of(text) if text else None
            if found is None:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            shares = _softmax((weights_of(found[0], 1 + np.log(found[1]), self.idf) @ table[found[0]] + self.constant) / self.temperature)
            best = int(shares.argmax())
            names.append(self.names[best])
            scores.append(float(shares[best]))
        return names, scores


def _sum_arrays(parts: DataFrame, size: int, dtype) -> np.ndarray:
    """The sum of arrays of one size, one a task, as a tree."""
    arrays = parts.rdd.map(lambda r: np.frombuffer(r["part"], dtype))
    return arrays.treeAggregate(np.zeros(size, dtype), np.add, np.add, depth=3)


def _one(array: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([array.tobytes()], pa.binary())], ["part"])


def inverse_frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """IDF of every feature over all training documents, and how many there are that have letters."""

    def run(batches):
        total = np.zeros((1 << BITS) + 1, np.int64)
        for part in slices(batches, "text"):
            for text in part.column("text").to_pylist():
                found = counts_of(text) if text else None
                if found is not None:
                    total[found[0]] += 1
                    total[-1] += 1
        yield _one(total)

    total = _sum_arrays(training.select("text").mapInArrow(run, "part binary"), (1 << BITS) + 1, np.int64)
    documents = int(total[-1])
    return np.log((1 + documents) / (1 + total[:-1])) + 1, documents


def learning_rows(training: DataFrame, counts: dict[str, int], sample: int) -> DataFrame:
    """Stored ``label, draw, features, frequency, kept, shard`` of the sampled documents, by shard and draw."""
    names = sorted(counts)
    each = sample / max(1, len(names))
    shares = [min(1.0, each / counts[n]) for n in names]
    label = F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int") - 1
    share = F.array(*map(F.lit, shares))[label]
    chosen = training.withColumn("draw", F.rand(7)).withColumn("label", label).where(F.col("draw") < share)
    chosen = chosen.select("label", "draw", "text")

    def run(batches):
        for part in slices(batches, "text"):
            keep, at, frequency = [], [], []
            for k, text in enumerate(part.column("text").to_pylist()):
                found = counts_of(text) if text else None
                if found is not None:
                    keep.append(k)
                    at.append(found[0].astype(np.uint16).tobytes())
                    frequency.append((1 + np.log(found[1])).astype(np.float16).tobytes())
            mine = part.select(["label", "draw"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*mine.columns, pa.array(at, pa.binary()), pa.array(frequency, pa.binary())], ["label", "draw", "features", "frequency"])

    rows = chosen.mapInArrow(run, "label int, draw double, features binary, frequency binary")
    part = F.xxhash64("draw", "features")
    rows = rows.withColumns({"kept": F.pmod(part, F.lit(KEPT)) == 0, "shard": F.pmod(F.shiftright(part, 16), F.lit(SHARDS))})
    return stored(rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", "draw", "features"), "language")


def _examples(batches, idf: np.ndarray):
    """Features with the constant's last, their weights, and the label of each row."""
    for batch in batches:
        for at, frequency, label in zip(*[batch.column(c).to_pylist() for c in ("features", "frequency", "label")]):
            at = np.frombuffer(at, np.uint16).astype(np.int64)
            x = weights_of(at, np.frombuffer(frequency, np.float16).astype(np.float64), idf)
            yield np.append(at, 1 << BITS), np.append(x, 1.0), label


def _state(leader: Leader | None, seen: int) -> np.ndarray | float:
    """A learner's sums times the rows it saw, and these."""
    return np.concatenate((seen * leader.z.ravel(), seen * leader.n.ravel(), [float(seen)])) if leader else 0.0


def train(rows: DataFrame, idf: np.ndarray, languages: int, rounds: int = ROUNDS, lasso: float = LASSO, ridge: float = RIDGE) -> np.ndarray:
    """Weights of languages by features, the constant's last, averaged over shards after each round."""
    shape = (languages, (1 << BITS) + 1)
    size = languages * shape[1]
    z, n = np.zeros(shape), np.zeros(shape)
    learned = rows.where(~F.col("kept")).select("features", "frequency", "label", "shard")
    for _ in range(rounds):
        start = (z, n)

        def one_shard(batches):
            """A learner for each run of rows of one shard, whatever files a task reads."""
            leader, seen, shard = None, 0, None
            total = np.zeros(2 * size + 1)
            for batch in batches:
                shards = batch.column("shard").to_numpy()
                ends = [*(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
                for first, end in zip([0, *ends], ends):
                    if leader is None or shards[first] != shard:
                        total += _state(leader, seen)
                        leader, seen, shard = Leader(*(a.copy() for a in start), lasso, ridge), 0, shards[first]
                    for features, x, label in _examples([batch.slice(first, end - first)], idf):
                        leader.learn(features, x, label)
                        seen += 1
            if leader is not None:
                yield _one(total + _state(leader, seen))

        total = _sum_arrays(learned.mapInArrow(one_shard, "part binary"), 2 * size + 1, np.float64)
        if not total[-1]:
            break
        z, n = (total[k * size : (k + 1) * size].reshape(shape) / total[-1] for k in (0, 1))
    return Leader(z, n, lasso, ridge).at(slice(None))


def temperature(rows: DataFrame, idf: np.ndarray, weights: np.ndarray) -> float:
    """The temperature under which the kept rows' languages are likeliest; 1 without such rows.

    Of m rows, 1 in m + 2 counts as of any language alike: rows that are all told right do not
    make the probabilities certain.
    """
    size = len(TEMPERATURES)

    def run(batches):
        sums = np.zeros(3 * size + 1)
        for features, x, label in _examples(batches, idf):
            scaled = (weights[:, features] @ x)[None, :] / TEMPERATURES[:, None]
            top = scaled.max(axis=1)
            sums[:-1] += np.concatenate((top + np.log(np.exp(scaled - top[:, None]).sum(axis=1)), scaled[:, label], scaled.mean(axis=1)))
            sums[-1] += 1
        yield _one(sums)

    kept = rows.where("kept").select("features", "frequency", "label")
    sums = _sum_arrays(kept.mapInArrow(run, "part binary"), 3 * size + 1, np.float64)
    if not sums[-1]:
        return 1.0
    whole, own, any_ = sums[:-1].reshape(3, size)
    doubt = 1 / (sums[-1] + 2)
    return float(TEMPERATURES[(whole - (1 - doubt) * own - doubt * any_).argmin()])


def fit(training: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, lasso: float = LASSO, ridge: float = RIDGE) -> Model:
    """A model from rows ``text, lang``; those without a language are not used."""
    training = training.where(F.col("lang").isNotNull()).select("text", "lang")
    found = training.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    counts = {r["lang"]: r["count"] for r in found}
    names = tuple(sorted(counts))
    idf, _ = inverse_frequencies(training)
    if not names:
        return Model((), idf, np.empty(0, np.int64), np.empty((0, 0)), np.empty(0))
    rows = learning_rows(training, counts, sample)
    weights = train(rows, idf, len(names), rounds, lasso, ridge)
    used = np.flatnonzero(weights[:, :-1].any(axis=0))
    return Model(names, idf, used, weights[:, used], weights[:, -1], temperature(rows, idf, weights))


def predictions(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` of every whole text."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for part in slices(batches, "text"):
            names, scores = model.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(fold(key, 4) == 2, F.lit(False))


def document_languages(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; documents held out by their id are never learned from."""
    known = documents.where(fold("doc_id", 4) != 2)
    model = fit(known, sample)
    return predictions(documents, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
