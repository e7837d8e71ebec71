"""Benchmark passages in documents.

Method: Wu-Manber multi-pattern search over words.  All patterns of one length share a table
that says how far the search may jump, given the two words at the end of the window; where the
jump is zero, a bucket keyed by those two words lists the patterns that end so, and a direct
comparison of all words confirms an occurrence.

A window is ``width`` consecutive words of an item; a shorter item is one window.  A document
word inside any occurrence of a window is hit.

Documents stay where they are.  The patterns travel to the tasks, at most ``block_bytes`` of
item text at a time: a larger benchmark is searched in several such blocks (its items dealt by
hash), and the hit spans of the blocks are then joined by document row.

Cases: null and empty texts have no words; an item without words has no windows; repeated items
count by their distinct ids; an item without id is searched but not listed.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rulewatch.llm.common import as_bytes, slices, stored

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WIDTH = 13
BLOCK_BYTES = 2 << 20


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes.lower changes A-Z alone


class Matcher:
    """The tables for one block of items: (item_id as text or None, text in bytes)."""

    def __init__(self, items, width: int = WIDTH):
        patterns: dict[tuple, set] = defaultdict(set)
        ids: dict[bytes, int] = {}
        for item, text in items:
            words = [ids.setdefault(w, len(ids) + 1) for w in words_of(text)]
            for i in range(max(1, len(words) - width + 1) if words else 0):
                patterns[tuple(words[i : i + width])].add(item)
        self.ids = ids
        by_length: dict[int, list] = defaultdict(list)
        for pattern, names in patterns.items():
            by_length[len(pattern)].append((pattern, frozenset(names)))
        self.tables = [self._table(n, found) for n, found in sorted(by_length.items())]

    @staticmethod
    def _table(length: int, found):
        block = min(2, length)
        shift: dict = {}
        buckets: dict = defaultdict(list)
        for pattern, names in found:
            for at in range(length - block + 1):
                key, jump = pattern[at : at + block], length - block - at
                if jump < shift.get(key, length):
                    shift[key] = jump
            buckets[pattern[-block:]].append((list(pattern), names))
        return length, block, length - block + 1, shift, buckets

    def __call__(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of hit words, sorted and apart, and the items with occurrences."""
        get = self.ids.get
        codes = [get(w, 0) for w in words]
        spans, items = [], set()
        for length, block, most, shift, buckets in self.tables:
            end, size, jump_of = length, len(codes), shift.get
            while end <= size:
                last = codes[end - 1]
                if not last:  # a word of no pattern: no window can hold it
                    end += length
                    continue
                key = (codes[end - 2], last) if block == 2 else (last,)
                jump = jump_of(key, most)
                if jump:
                    end += jump
                    continue
                here = codes[end - length : end]
                for pattern, names in buckets[key]:
                    if pattern == here:
                        spans.append((end - length, end))
                        items |= names
                end += 1
        return joined(spans), items


def joined(spans) -> list[tuple[int, int]]:
    """Spans that touch or overlap made one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def hits(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id",
    item: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``key, n_words, spans, items``: hit word spans and the ids of items found, for each row."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text"))
    items = stored(items.distinct(), "decontaminate")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    if count == 1:
        rows, parts = rows.withColumn("row", F.lit(0).cast("long")), []
    else:  # the same row is seen by several blocks and needs a number to meet by
        rows, parts = stored(rows.withColumn("row", F.monotonically_increasing_id()), "decontaminate"), []
    for k in range(count):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).collect()
        part = _searched(rows, [(r["item"], bytes(r["text"] or b"")) for r in mine], width)
        if count == 1:
            return part.select(F.col("key").alias(key), "n_words", "spans", "items")
        # A block's items leave the driver with it; later blocks add only rows that they hit.
        parts.append(stored(part if k == 0 else part.where(F.size("spans") > 0), "decontaminate"))
    every = functools.reduce(DataFrame.unionByName, parts)
    both = every.groupBy("row").agg(
        F.first("key").alias("key"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return both.select(F.col("key").alias(key), "n_words", merged_spans("spans").alias("spans"), "items")


def merged_spans(column: str):
    """Spans of several blocks, sorted, those that touch made one."""
    return F.aggregate(
        F.array_sort(column),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda out, x: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(out, F.array(x))),
    )


def _searched(rows: DataFrame, block, width: int) -> DataFrame:
    found = T.StructType.fromDDL("row long, n_words long, spans array<struct<start:int,end:int>>, items array<string>")
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *found])  # names in a key need no quotes
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches):
        matcher = Matcher(block, width)
        for part in slices(batches, "text"):
            counts, spans, items = [], [], []
            for text in as_bytes(part.column("text")):
                words = words_of(text)
                where, which = matcher(words) if words else ([], ())
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in where])
                items.append(sorted(x for x in which if x is not None))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("row"), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))],
                ["key", "row", "n_words", "spans", "items"],
            )

    return rows.mapInArrow(run, schema)


def contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", **named) -> DataFrame:
    """``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` (hit in a twentieth of the words)."""
    return hits(documents, benchmark, key=key, **named).select(
        key,
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, of documents that are not contaminated."""
    rows = documents.select(F.struct("*").alias("doc"), "text")
    return contamination(rows, benchmark, key="doc").where(~F.col("contaminated")).select("doc.*")
