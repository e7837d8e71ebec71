"""Word windows that an earlier document already has.

Method: a count-min prefilter.  A first pass over the chunks sums sketches; a second groups, by
128-bit hashes of all 50 words, only the windows estimated to be repeated, and finds the smallest
document id of each.  A third marks the windows that start in a document with a smaller id.

What the sketch counts is a stand-in for each window: the least hash of its runs of eight words.
Equal windows have equal stand-ins, so a window's count is at most its stand-in's and none is
lost; neighbouring windows mostly share one, so there are about twenty times fewer keys.

Windows go through the shuffle once for each chunk that has them, not for each document: a window
of every document costs one row a chunk.

Cases: a null or empty text has no words; a document of fewer than 50 words has no windows; rows
with one id are one document as to smaller ids; a null id is larger than any other.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rulewatch.llm import sketch
from rulewatch.llm.common import NO_ID, chunk_rows, chunk_texts, chunked, sliding, span_hashes, word_hashes

WIDTH, RUN = 50, 8


class Windows:
    """The windows of a chunk's texts: their documents and stand-ins."""

    def __init__(self, texts: list[bytes], width: int):
        hashes, self.counts = word_hashes(texts, (0, 1))
        self.hashes, self.width = hashes, width
        total = len(hashes[0])
        document = np.repeat(np.arange(len(texts)), self.counts)
        if total < width:
            self.starts = np.empty(0, np.int64)
        else:
            self.starts = np.flatnonzero(document[: total - width + 1] == document[width - 1 :])
        self.document = document[self.starts]

    def stand_ins(self) -> np.ndarray:
        run = min(RUN, self.width)
        if not len(self.starts):
            return np.empty(0, np.uint64)
        at = np.arange(len(self.hashes[0]) - run + 1)
        return sliding(np.minimum, span_hashes(self.hashes[0], at, at + run), self.width - run + 1)[self.starts]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct stand-ins, in how many documents each is, and which one each window has."""
        values = self.stand_ins()
        keys, which = np.unique(values, return_inverse=True)
        order = np.lexsort((self.document, which))
        k, d = which[order], self.document[order]
        first = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])) if len(k) else np.empty(0, bool)
        return keys, np.bincount(k[first], minlength=len(keys)), which

    def full(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of the windows chosen."""
        at = self.starts[which]
        return tuple(span_hashes(h, at, at + self.width, seed) for seed, h in enumerate(self.hashes))


def earliest_windows(chunks: DataFrame, width: int) -> DataFrame:
    """``chunk, found``: hashes of the chunk's windows that a smaller id than some of its own has."""
    words = chunks.agg(F.sum("words")).first()[0] or 0
    bits = sketch.width_bits(2 * words // (width - min(RUN, width) + 2))

    def first_pass(batches):
        for row in chunk_rows(batches):
            keys, counts, _ = Windows(chunk_texts(row)[1], width).keys()
            yield sketch.parts(row["chunk"], keys, counts, bits)

    flags = sketch.levels(chunks.select("chunk", "size", "ids", "lengths", "texts").mapInArrow(first_pass, sketch.PART))

    def second_pass(batches):
        for row in chunk_rows(batches):
            ids, texts = chunk_texts(row)
            windows = Windows(texts, width)
            keys, _, which = windows.keys()
            chosen = np.flatnonzero(sketch.estimate(keys, row["flags"], bits)[which] > 0) if len(keys) else np.empty(0, np.int64)
            a, b = (h.view(np.int64) for h in windows.full(chosen))
            own = ids[windows.document[chosen]]
            order = np.lexsort((own, b, a))
            a, b, own = a[order], b[order], own[order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else order
            last = np.append(first[1:], len(a)) - 1 if len(a) else order
            columns = (a[first], b[first], np.full(len(first), row["chunk"]), own[first], own[last])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "chunk", "low", "high"])

    candidates = chunks.select("chunk", "size", "ids", "lengths", "texts").join(flags, "chunk").mapInArrow(second_pass, "a long, b long, chunk long, low long, high long")
    least = F.min("low").over(Window.partitionBy("a", "b"))
    found = candidates.withColumn("least", least).where("least < high")
    return found.groupBy("chunk").agg(F.collect_list(F.struct("a", "b", "least")).alias("found"))


def _covered(windows: Windows, removed: np.ndarray) -> np.ndarray:
    """Which words lie in the removed windows."""
    change = np.zeros(len(windows.hashes[0]) + 1, np.int64)
    at = windows.starts[removed]
    np.add.at(change, at, 1)
    np.add.at(change, at + windows.width, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """``key, n_words, n_removed, kept``: the words left, joined by one space; a row for each row."""
    chunks = chunked(df, text, key)
    found = earliest_windows(chunks, width)

    def third_pass(batches):
        for row in chunk_rows(batches):
            ids, texts = chunk_texts(row)
            windows = Windows(texts, width)
            mask = np.zeros(len(windows.hashes[0]), bool)
            if row["found"] is not None:
                a, b, least = (row["found"][name] for name in ("a", "b", "least"))
                order = np.lexsort((b, a))
                a, b, least = a[order], b[order], least[order]
                mask = _covered(windows, _earlier(windows, ids, a, b, least))
            ends = np.cumsum(windows.counts)
            for first in range(0, len(texts), 512):
                rows = range(first, min(first + 512, len(texts)))
                removed, kept = [], []
                for i in rows:
                    gone = mask[ends[i] - windows.counts[i] : ends[i]]
                    words = texts[i].split()
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join(compress(words, ~gone) if removed[-1] else words).decode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if ids[i] == NO_ID else int(ids[i]) for i in rows], pa.int64()), pa.array(windows.counts[first : first + 512]), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    ["id", "n_words", "n_removed", "kept"],
                )

    out = chunks.select("chunk", "size", "ids", "lengths", "texts").join(found, "chunk", "left").mapInArrow(third_pass, "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", key)


def _earlier(windows: Windows, ids: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Windows that start in a document with a smaller id; a, b sorted."""
    x, y = (h.view(np.int64) for h in windows.full(np.arange(len(windows.starts))))
    at, end = np.searchsorted(a, x), np.searchsorted(a, x, side="right")
    place = np.minimum(at, len(a) - 1)
    hit = (at < end) & (b[place] == y)
    for k in np.flatnonzero(~hit & (end - at > 1)):  # windows that share 64 bits with another
        for j in range(at[k] + 1, end[k]):
            if b[j] == y[k]:
                place[k], hit[k] = j, True
    return np.flatnonzero(hit & (least[place] < ids[windows.document]))


def digests(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``."""
    kept = remove_repeats(documents)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
