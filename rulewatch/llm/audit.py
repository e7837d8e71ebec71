"""How quality filters interact: what each removes, alone and after the others, in every order.

Method: sorted posting lists.  A *block* is a run of places of one part in id order; for each filter
it keeps the sorted places of the rows that fail.  Unions of filters, what a filter removes beyond
a union, and how much of that is good or toxic come from galloping k-way merges of these lists.
Blocks are apart, so sizes add up: a block sends 80 small rows (a filter after a set of others).
The 120 orders of five filters need no more than those.

Parts with very many rows are many blocks: rows are dealt by ranges of (part, id, place), so a
part, an id or a null id that holds a third of all rows is split.  Equal texts meet by hash: the
smallest id of each SHA-256 is a partial aggregate, and rows join those of repeated texts only.

Cases: a null text is empty; a null part is the empty string; rows without id are never copies of
another and no other row is a copy of them; repeated rows count each; labels are merged by id (good
or toxic if any row says so), those without id are not used; an empty table has no rows.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulewatch.llm.common import as_bytes, partitions, slices, stored

FILTERS = "ABCDE"
LEAST_WORDS = 200
BLOCK = 1 << 16  # places of a block
LEAD = 64  # places found one by one in galloping, those between all at once

_MARKS = re.compile(rb"[#$%&*|]")


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    size = len(words)
    codes = np.frombuffer(text, np.uint8)
    capitals = int(np.count_nonzero((codes >= 65) & (codes <= 90)))
    points = len(text) - int(np.count_nonzero((codes & 0xC0) == 0x80))
    return (
        (size < LEAST_WORDS)
        | (100 * len(set(words)) < 50 * size) << 1
        | (100 * capitals > 2 * points) << 2
        | (_MARKS.search(text) is not None) << 3
    )


def gallop(values: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Place of the first value not below each target; both rise.

    Every 64th target doubles its steps from the place before it; those between two of them
    halve the range that these leave, all together.
    """
    low = np.zeros(len(targets), np.int64)
    if not len(targets) or not len(values):
        return low
    lead, at, places = targets[::LEAD].tolist(), 0, []
    for target in lead:
        step, before = 1, at
        while at < len(values) and values[at] < target:
            before, at = at + 1, at + step
            step *= 2
        at = before + int(np.searchsorted(values[before : at + 1], target))
        places.append(at)
    places.append(len(values))
    low = np.repeat(np.array(places[:-1]), LEAD)[: len(targets)]
    high = np.repeat(np.array(places[1:]), LEAD)[: len(targets)]
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        below = open_ & (values[np.minimum(middle, len(values) - 1)] < targets)
        low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
    return low


def _within(values: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Which targets are among the values."""
    if not len(values):
        return np.zeros(len(targets), bool)
    at = gallop(values, targets)
    return (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == targets)


def difference(list_: np.ndarray, others: np.ndarray) -> np.ndarray:
    return list_[~_within(others, list_)]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two lists share; the shorter one gallops through the longer."""
    short, long = sorted((a, b), key=len)
    return int(np.count_nonzero(_within(long, short)))


def unions(lists: list[np.ndarray]) -> list[np.ndarray]:
    """The sorted union of each set of lists, by the set's bits: one more list merged into a smaller set's union."""
    found = [np.empty(0, np.int64)]
    for chosen in range(1, 1 << len(lists)):
        last = chosen.bit_length() - 1
        rest = found[chosen ^ (1 << last)]
        new = difference(lists[last], rest)
        found.append(np.insert(rest, gallop(rest, new), new))
    return found


def block_sizes(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray):
    """(set before, filter, lost before, removed, redundant, good lost, toxic lost) for each set and filter outside it."""
    every = unions(lists)
    for before, lost in enumerate(every):
        for filter_, list_ in enumerate(lists):
            if not before >> filter_ & 1:
                gone = difference(list_, lost)
                yield before, filter_, len(lost), len(gone), len(list_) - len(gone), common(gone, good), common(gone, toxic)


SIZES = ["before", "filter", "lost", "removed", "redundant", "good_lost", "toxic_lost"]


def interactions(postings: DataFrame, filters: int, block: int = BLOCK) -> DataFrame:
    """``part`` and the sums of :func:`block_sizes`, from rows ``part, id, place, fails (bits), good, toxic``.

    ``place`` tells rows of one id apart.  Rows that fail nothing need not be there.
    """
    rows = postings.repartitionByRange(partitions(postings), "part", "id", "place").sortWithinPartitions("part", "id", "place")
    rows = rows.select("part", "fails", "good", "toxic")

    def lists_of(fails, good, toxic):
        places = [np.flatnonzero(fails >> f & 1) for f in range(filters)]
        return places, np.flatnonzero(good), np.flatnonzero(toxic)

    def run(batches):
        part, parts = None, []  # arrays of the block that is being filled

        def flush():
            sizes = np.array(list(block_sizes(*lists_of(*map(np.concatenate, zip(*parts))))))
            columns = [pa.array([part] * len(sizes), pa.string()), *[pa.array(c, pa.int64()) for c in sizes.T]]
            return pa.RecordBatch.from_arrays(columns, ["part", *SIZES])

        for batch in batches:
            names = batch.column("part").to_pylist()
            arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("fails", "good", "toxic")]
            start = 0
            for name, run_ in itertools.groupby(names):
                end = start + sum(1 for _ in run_)
                if parts and name != part:
                    yield flush()
                    parts = []
                part = name
                for a in range(start, end, block):
                    held = sum(len(p[0]) for p in parts)
                    if held + min(block, end - a) > block:
                        yield flush()
                        parts = []
                    parts.append([x[a : min(a + block, end)] for x in arrays])
                start = end
        if parts:
            yield flush()

    sizes = rows.mapInArrow(run, "part string, " + ", ".join(f"`{c}` long" for c in SIZES))
    return sizes.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in SIZES[2:]])


def orders_of(filters: int) -> list[tuple[str, int, int, int]]:
    """(order, step, set before, filter) of every order of the filters."""
    return [
        ("".join(FILTERS[f] for f in order), step + 1, sum(1 << f for f in order[:step]), order[step])
        for order in itertools.permutations(range(filters))
        for step in range(filters)
    ]


def order_report(parts: DataFrame, sums: DataFrame, filters: int) -> DataFrame:
    """Every order and step of every part of ``parts`` (``part, documents``), zeros included."""
    every = (1 << filters) - 1
    shares = F.lit(0).cast("long")  # in how many orders exactly the filters of a set come before
    for size in range(filters):
        shares = F.when(F.bit_count("before") == size, math.factorial(size) * math.factorial(filters - 1 - size)).otherwise(shares)
    alone = F.when(F.col("before") == F.lit(every) - F.expr("shiftleft(1, cast(filter as int))"), F.col("removed"))
    totals = sums.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * shares).alias("shapley"), F.max(alone).alias("unique_fails")
    )
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).cast("long").alias("before"), F.lit(f).cast("long").alias("filter")) for o, s, b, f in orders_of(filters)])
    rows = parts.select("part", "documents", F.inline(steps))
    rows = rows.join(sums, ["part", "before", "filter"], "left").join(totals, ["part", "filter"], "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in (*SIZES[2:], "shapley", "unique_fails")}
    return rows.withColumns(zero).select(
        "part", "filter_order", "step",
        (F.col("documents") - F.col("lost") - F.col("removed")).alias("kept"),
        "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def document_facts(documents: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``id, part, place, fails, hash``: the failures of A to D and the text's hash, stored."""
    rows = documents.select(
        F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).select("*", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for piece in slices(batches, "text"):
            fails = pa.array([failures(x) for x in as_bytes(piece.column("text"))], pa.int32())
            yield pa.RecordBatch.from_arrays([*map(piece.column, ("id", "part", "hash")), fails], ["id", "part", "hash", "fails"])

    facts = rows.mapInArrow(run, f"id {kind}, part string, hash binary, fails int")
    return stored(facts.withColumn("place", F.monotonically_increasing_id()), "audit")


def with_copies(facts: DataFrame, bit: int) -> DataFrame:
    """``facts`` with the bit set where a row of a smaller id has the same text."""
    firsts = facts.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    firsts = stored(firsts.select("hash", "first"), "audit")  # a join of two stored tables can split a hot text
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    joined = facts.join(firsts, "hash", "left")
    return joined.withColumn("fails", F.col("fails").bitwiseOR(F.when(copy, 1 << bit).otherwise(0))).drop("first", "hash")


def filter_audit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The five filters over whole texts, in all 120 orders, for every part."""
    facts = document_facts(documents, key, text, part)
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    failing = with_copies(facts, 4).where("fails > 0")
    marked = failing.join(stored(marks, "audit"), "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    parts = facts.groupBy("part").agg(F.count("*").alias("documents"))
    sums = stored(interactions(stored(marked, "audit"), len(FILTERS)), "audit")
    return order_report(parts, sums, len(FILTERS))
