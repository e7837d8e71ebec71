"""A count-min sketch of keys over all partitions, cut into shards so that none is large.

Every chunk of the input adds its own counts to two rows of cells.  A shard of cells is summed in
one task, which sends each chunk a level for each key that it brought: whether the cell counts two or
more, and whether it counts ``hot`` or more.  A key's level is the least of its cells' levels, an
overestimate, so no key that repeats is missed.
The number of cells follows the number of keys; no task holds more than a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulewatch.llm.common import ODD, mix, pack, unpack

DEPTH = 2
SHARD_BITS = 20
MOST = 255  # a chunk says no more of one key
PART = "depth int, shard long, chunk long, cells binary, counts binary"


def width_bits(keys: int) -> int:
    """Bits of a cell number: eight cells a key and row."""
    return max(16, int(8 * max(1, keys)).bit_length())


def _cells(keys: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells in rising order, the order of their keys, and where shards start."""
    cell = mix(keys ^ np.uint64(ODD[depth])) >> np.uint64(64 - bits)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    shard = cell >> np.uint64(SHARD_BITS)
    return cell, order, np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(cell))


def parts(chunk: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of ``PART`` for the distinct keys of a chunk."""
    columns: list[list] = [[], [], [], [], []]
    for depth in range(DEPTH if len(keys) else 0):
        cell, order, starts = _cells(keys, depth, bits)
        for a, b in zip(starts[:-1], starts[1:]):
            low = (cell[a:b] & np.uint64((1 << SHARD_BITS) - 1)).astype(np.uint32)
            row = (depth, int(cell[a]) >> SHARD_BITS, chunk, pack(np.diff(low, prepend=np.uint32(0))), pack(np.minimum(counts[order[a:b]], MOST).astype(np.uint8)))
            for column, x in zip(columns, row):
                column.append(x)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["depth", "shard", "chunk", "cells", "counts"])


def levels(rows: DataFrame, hot: int = 1 << 30) -> DataFrame:
    """``chunk, flags``: for each chunk the (depth, shard, bits) of its keys, two bits a key."""

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << SHARD_BITS, np.int64)
        cells = [np.cumsum(unpack(x, np.uint32), dtype=np.int64) for x in table.column("cells").to_pylist()]
        for at, counts in zip(cells, table.column("counts").to_pylist()):
            np.add.at(total, at, unpack(counts, np.uint8))
        flags = [np.packbits([total[at] >= 2, total[at] >= hot], axis=1).tobytes() for at in cells]
        return pa.table({"chunk": table.column("chunk"), "depth": table.column("depth"), "shard": table.column("shard"), "bits": pa.array(flags, pa.binary())})

    merged = rows.groupBy("depth", "shard").applyInArrow(run, "chunk long, depth int, shard long, bits binary")
    return merged.groupBy("chunk").agg(F.collect_list(F.struct("depth", "shard", "bits")).alias("flags"))


def estimate(keys: np.ndarray, flags: list[dict] | None, bits: int) -> np.ndarray:
    """The level of each of the chunk's keys, given as to ``parts``: 0 once, 1 repeated, 2 hot."""
    out = np.full(len(keys), 2, np.int8)
    found = {(x["depth"], x["shard"]): x["bits"] for x in flags or ()}
    for depth in range(DEPTH if len(keys) else 0):
        cell, order, starts = _cells(keys, depth, bits)
        for a, b in zip(starts[:-1], starts[1:]):
            mine = np.frombuffer(found[depth, int(cell[a]) >> SHARD_BITS], np.uint8).reshape(2, -1)
            out[order[a:b]] = np.minimum(out[order[a:b]], np.unpackbits(mine, axis=1, count=b - a).sum(axis=0))
    return out
