"""Near duplicates by SimHash.

Method: fingerprints that may be close meet in blocks, where they are compared bit-sliced.  Bit
planes are stored vertically: one word holds one bit of 64 fingerprints, so a few operations
update 64 distances in carry-save counters.  Fingerprints are compared with the next, the one
after and so on of their block; words in which every distance is beyond the radius are abandoned.

Blocks: the 64 bits are cut into ``radius + 2`` parts.  Fingerprints within the radius agree in
two parts at least, so all pairs of parts serve as keys and no link is lost.  Equal fingerprints
are one node.  A block that many fingerprints share is cut into tiles by hash, and each pair of
tiles is compared, in whichever task.  A block returns a spanning forest of its links, not all
pairs; components are found in Spark.

Cases: a null or empty text has fingerprint zero, which links like any other; repeated rows and
repeated ids belong to one component; a null id is never the smallest of its component unless
all are null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rulewatch.llm.common import as_bytes, free_name, partitions, slices, stored
from rulewatch.llm.graph import components

SHINGLE, RADIUS, SEED = 3, 3, 42
TILE = 2048
BATCH = 1 << 16


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``width`` words, or of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return []
    hashed = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= width:
        return [hashed(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -width] + 1).tolist()]
    return [hashed(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]


def fingerprints_of(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """A bit is set if it is set in over half of the text's hashes."""
    hashes = [shingle_hashes(t, width) for t in texts]
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    return majority(np.array([h for x in hashes for h in x], np.uint64), counts)


def majority(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of ``counts`` hashes; that of none is zero."""
    out, some = np.zeros(len(counts), np.uint64), np.flatnonzero(counts)
    if not len(some):
        return out
    starts = (np.cumsum(counts) - counts)[some]
    bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_bits = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * set_bits > counts[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(df: DataFrame, width: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, fingerprint`` (as a signed long) of each whole text."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for part in slices(batches, "text"):
            found = fingerprints_of(as_bytes(part.column("text")), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(found)], ["key", "fingerprint"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, fingerprint long").withColumnRenamed("key", key)


def block_keys(column: str, radius: int = RADIUS):
    """All (pair of parts, their bits) of a fingerprint, each as one long."""
    parts = radius + 2
    cuts = [64 * i // parts for i in range(parts + 1)]
    piece = [F.shiftrightunsigned(column, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    pairs = list(combinations(range(parts), 2))
    return F.array(*[
        F.shiftleft(piece[i], cuts[j + 1] - cuts[j]).bitwiseOR(piece[j]) * F.lit(len(pairs)) + F.lit(n) for n, (i, j) in enumerate(pairs)
    ])


def close_pairs(planes: np.ndarray, step: int, alive: np.ndarray, radius: int) -> np.ndarray:
    """Which rows differ from the row ``step`` places on in at most ``radius`` bits.

    ``planes`` is 64 x words, ``alive`` one bit a row that is to be compared.
    """
    at = np.flatnonzero(alive)
    words, rest = divmod(step, 64)
    counters = [np.zeros(len(at), np.uint64) for _ in range(radius.bit_length())]
    beyond = np.zeros(len(at), np.uint64)
    live = alive[at]
    for first in range(0, 64, 8):
        for plane in planes[first : first + 8]:
            other = plane[at + words] >> np.uint64(rest)
            if rest:
                other |= plane[at + words + 1] << np.uint64(64 - rest)
            carry = plane[at] ^ other
            for k, counter in enumerate(counters):
                counters[k] = counter ^ carry
                carry = counter & carry
            beyond |= carry
        left = live & ~beyond
        keep = left != 0
        if not keep.all():  # abandon the words in which all are beyond the radius
            at, live, beyond = at[keep], live[keep], beyond[keep]
            counters = [c[keep] for c in counters]
            if not len(at):
                return np.empty(0, np.int64)
    rows = np.unpackbits((live & ~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(rows)
    return at[word] * 64 + bit


def _bits(flags: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def linked(groups: np.ndarray, values: np.ndarray, radius: int = RADIUS, alike=None) -> np.ndarray:
    """For each row the first row that it reaches by links within its group; groups are contiguous.

    ``alike`` says which of the pairs within the radius are links, given their rows; all if None.
    """
    count = len(values)
    label = np.arange(count)
    if count < 2:
        return label
    first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    sizes = np.diff(np.append(first, count))
    order = np.argsort(np.repeat(sizes, sizes), kind="stable")  # so that large groups come last
    sizes = sizes[np.argsort(sizes, kind="stable")]
    left = np.repeat(sizes, sizes) - flat_places(sizes) - 1  # rows that follow in the group
    ordered = values[order]
    words = -(-count // 64)
    bits = np.unpackbits(ordered.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    step, size = 1, int(sizes[-1])
    planes = np.zeros((64, words + 2 + size // 64 + 1), np.uint64)
    for k in range(64):
        planes[k, :words] = _bits(bits[:, k], words)
    starts = np.cumsum(sizes) - sizes
    open_groups = np.ones(len(sizes), bool)
    while step < size:
        if step & (step - 1) == 0 and step > 1:  # groups that are one component already need no more
            least, most = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
            open_groups = least != most
            if not open_groups.any():
                break
        rows = close_pairs(planes, step, _bits((left >= step) & np.repeat(open_groups, sizes), words), radius)
        # Where the word sums allow more than the radius, look at the distance itself.
        rows = rows[np.bitwise_count(ordered[rows] ^ ordered[rows + step]) <= radius]
        if alike is not None:
            rows = rows[label[rows] != label[rows + step]]
            rows = rows[alike(order[rows], order[rows + step])]
        join(label, rows, rows + step)
        step += 1
    out = np.empty(count, np.int64)
    least_original = np.full(count, count)
    np.minimum.at(least_original, label, order)
    out[order] = least_original[label]
    return out


def flat_places(sizes: np.ndarray) -> np.ndarray:
    """0, 1 .. size - 1 for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked rows the least label of both, until nothing changes; labels stay flat."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        differ = low != high
        if not differ.any():
            return
        a, b, low, high = a[differ], b[differ], low[differ], high[differ]
        np.minimum.at(label, high, low)
        while True:
            flat = label[label]
            if (flat == label).all():
                break
            label[:] = flat


def fingerprint_links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that connect all distinct ``fingerprint`` values within the radius."""
    keyed = values.select("fingerprint", F.explode(block_keys("fingerprint", radius)).alias("block"))
    shared = keyed.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(shared, "block").withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int"))
    keyed = keyed.withColumn("tile", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int"))
    # Only a block over a tile's size has more than one partner here.
    other = F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("tiles") - 1), F.col("tile"))))
    tiled = keyed.select("block", "tile", "fingerprint", other.alias("other"))
    tiled = tiled.select("block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "fingerprint")
    dealt = tiled.repartition(partitions(values), "block", "low", "high").sortWithinPartitions("block", "low", "high")
    numbered = dealt.select(F.xxhash64("block", "low", "high").alias("group"), "fingerprint")

    def run(batches):
        held_groups, held = np.empty(0, np.int64), np.empty(0, np.int64)

        def forest(groups, found):
            root = linked(groups, found.view(np.uint64), radius)
            tied = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(found[tied]), pa.array(found[root[tied]])], ["a", "b"])

        for batch in batches:
            held_groups = np.concatenate((held_groups, batch.column("group").to_numpy()))
            held = np.concatenate((held, batch.column("fingerprint").to_numpy()))
            if len(held) >= BATCH:  # the last group may go on
                end = int(np.flatnonzero(held_groups != held_groups[-1])[-1]) + 1 if held_groups[0] != held_groups[-1] else 0
                if end:
                    yield forest(held_groups[:end], held[:end])
                    held_groups, held = held_groups[end:], held[end:]
        yield forest(held_groups, held)

    return numbered.mapInArrow(run, "a long, b long")


def near_duplicates(prints: DataFrame, radius: int = RADIUS, key: str = "doc_id") -> DataFrame:
    """``key, fingerprint`` (hex) and ``component_id``, the smallest key reachable by links."""
    firsts = stored(prints.groupBy("fingerprint").agg(F.min(key).alias("first")), "simhash")
    roots = components(fingerprint_links(firsts.select("fingerprint"), radius))
    placed = firsts.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = placed.select("fingerprint", "root").join(least, "root").select("fingerprint", "component_id")
    return prints.join(of_print, "fingerprint").select(key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def document_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of all documents."""
    return near_duplicates(stored(fingerprints(documents), "simhash"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One row, with all its columns, of each component: the one with the smallest id."""
    number = free_name(documents, "__row")
    rows = stored(documents.withColumn(number, F.monotonically_increasing_id()), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(number).alias("row"))
    prints = stored(fingerprints(rows.select(order.alias("order"), "text"), key="order"), "simhash")
    kept = near_duplicates(prints, key="order").where("order = component_id").select(F.col("order.row").alias(number))
    return rows.join(kept, number, "left_semi").drop(number)
