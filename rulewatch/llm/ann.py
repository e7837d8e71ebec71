"""Approximate nearest neighbours by largest inner product.

Method: multi-index hashing.  Learned rotations (iterative quantization on a bounded sample) turn
a vector into a binary code, the signs of its rotated parts.  A code is split into 16-bit
substrings, each with an index of its own.  Codes within Hamming radius r of a query agree with it
in some substring up to r // substrings bits (pigeonhole), so probing all such substrings finds
every code within r; the floats of those are then compared exactly.  Where the probes would
outnumber the codes of a block, comparing with all its codes finds the same set for less.

The radius is learned too: it covers 98 of 100 true neighbours within the sample.  Inner products
become angles by a further component that gives all stored vectors one length.

Rows are cut into blocks of bounded size, queries too; each pair of blocks is a task of its own and
returns k rows a query at most.  A block with fewer than k codes within the radius adds its nearest
codes.  Sample: at most ``SAMPLE`` rows by hash of the row, whatever the size of the table.

Cases: vectors that are null, zero, of a length other than the table's most common one, or that
hold null or non-finite parts, and rows without id take no part; repeated rows are candidates of
one another; ties go to the smaller id.
"""

from __future__ import annotations

import dataclasses
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rulewatch.llm.common import stored

SAMPLE, BITS, STEPS = 4096, 256, 25
SUBSTRING = 16
BLOCK_ROWS = QUERY_ROWS = 4096
COVER = 0.98


@dataclasses.dataclass(frozen=True)
class Coder:
    longest: float  # length that all stored vectors are brought to
    rotations: np.ndarray  # (dimension + 1) x bits
    radius: int

    def codes(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as rows of 64-bit words."""
        lengths = np.linalg.norm(vectors, axis=1)
        if query:
            whole = np.column_stack((vectors / lengths[:, None], np.zeros(len(vectors))))
        else:
            whole = np.column_stack((vectors / self.longest, np.sqrt(np.maximum(0, 1 - (lengths / self.longest) ** 2))))
        return np.packbits(whole @ self.rotations > 0, axis=1).view(np.uint64)


def distances(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ query).sum(axis=-1, dtype=np.int64)


def learn(sample: np.ndarray, longest: float, k: int, seed: int = 3) -> Coder:
    """Rotations by iterative quantization, and the radius that covers the sample's neighbours."""
    random, lengths = np.random.default_rng(seed), np.linalg.norm(sample, axis=1)
    whole = np.column_stack((sample / longest, np.sqrt(np.maximum(0, 1 - (lengths / longest) ** 2))))
    size, parts = whole.shape[1], []
    for _ in range(-(-BITS // size)):
        rotation = np.linalg.qr(random.standard_normal((size, size)))[0]
        for _ in range(STEPS):
            left, _, right = np.linalg.svd(np.where(whole @ rotation > 0, 1.0, -1.0).T @ whole)
            rotation = (left @ right).T
        parts.append(rotation)
    rotations = np.hstack(parts)
    rotations = rotations[:, : rotations.shape[1] // 64 * 64]
    coder = Coder(longest, rotations, 0)
    stored_codes, query_codes = coder.codes(sample), coder.codes(sample, query=True)
    seen = []
    for i in range(min(512, len(sample))):
        products = sample @ sample[i]
        products[i] = -np.inf
        near = np.argsort(-products)[: min(k, len(sample) - 1)]
        seen.append(distances(stored_codes[near], query_codes[i]))
    seen = np.concatenate(seen) if seen else np.zeros(1)
    return dataclasses.replace(coder, radius=int(np.quantile(seen, COVER)) if len(seen) else 0)


class Index:
    """The codes of one block, with an index for each substring."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.codes, self.radius = codes, radius
        parts = np.ascontiguousarray(codes).view(np.uint16)
        self.count = parts.shape[1]
        most = radius // self.count
        self.masks, masks = None, [0]
        for flips in range(1, most + 1):  # stop as soon as the probes outnumber the codes
            masks += [sum(1 << b for b in bits) for bits in combinations(range(SUBSTRING), flips)]
            if len(masks) * self.count > len(codes):
                return
        if len(masks) * self.count <= len(codes):
            self.masks = np.array(masks, np.uint16)
            self.order = np.argsort(parts, axis=0, kind="stable")
            self.starts = [np.searchsorted(np.sort(parts[:, j]), np.arange((1 << SUBSTRING) + 1)) for j in range(self.count)]

    def within(self, query: np.ndarray, least: int) -> np.ndarray:
        """Rows with codes within the radius; if they are fewer than ``least``, the nearest codes."""
        if self.masks is None:
            away = distances(self.codes, query)
            found = np.flatnonzero(away <= self.radius)
        else:
            marked = np.zeros(len(self.codes), bool)
            for j, part in enumerate(np.ascontiguousarray(query).view(np.uint16)):
                probes = part ^ self.masks
                for a, b in zip(self.starts[j][probes], self.starts[j][probes.astype(np.int64) + 1]):
                    if a < b:
                        marked[self.order[a:b, j]] = True
            found = np.flatnonzero(marked)
            found = found[distances(self.codes[found], query) <= self.radius]
            if len(found) < least:
                away = distances(self.codes, query)
        if len(found) >= least:
            return found
        return np.argsort(away, kind="stable")[:least]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _blocks(rows: DataFrame, size: int, most: int, name: str) -> DataFrame:
    """Rows of at most ``most`` vectors each, stored: ``number, rows, ids, vectors``."""
    count = max(1, -(-rows.count() // most))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                parts = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("row", "id")]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (*parts, _matrix(part.column("vector"), size).tobytes())], ["rows", "ids", "vectors"])

    dealt = rows.repartition(count).mapInArrow(run, "rows binary, ids binary, vectors binary")
    return stored(dealt.withColumn("number", F.monotonically_increasing_id()), name)


def _numbered(blocks: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Blocks numbered from 0, and how many there are; only their numbers reach the driver."""
    numbers = [r["number"] for r in blocks.select("number").collect()]
    table = blocks.sparkSession.createDataFrame(list(enumerate(numbers)), f"{name} long, number long")
    return blocks.join(table, "number").drop("number"), len(numbers)


def search(df: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of each row whose id ``every`` divides."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall("vector", fine) & F.exists("vector", lambda x: x != 0))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "ann")
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    out = "query_row long, query_id long, vec_id long, score double"
    if sizes is None:
        return df.sparkSession.createDataFrame([], out).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    size = sizes["size"]
    rows = rows.where(F.size("vector") == size)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    longest = float(np.sqrt(rows.agg(F.max(square)).first()[0]))
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vector").collect()
    coder = learn(np.array([r["vector"] for r in sample]), longest, k)
    index = _blocks(rows, size, BLOCK_ROWS, "ann")
    queries = _blocks(rows.where(F.col("id") % every == 0), size, QUERY_ROWS, "ann")
    queries = queries.toDF("q_rows", "q_ids", "q_vectors", "number")
    (index, blocks), (queries, q_blocks) = _numbered(index, "block"), _numbered(queries, "q_block")
    if not q_blocks:
        return df.sparkSession.createDataFrame([], out).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    # The stated query set meets all rows, block by block.
    every_block = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    pairs = index.withColumn("q_block", every_block(q_blocks)).join(queries.withColumn("block", every_block(blocks)), ["block", "q_block"])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[at].as_py(), kind)  # noqa: B023, E731
                ids, own, vectors = get("ids", np.int64), get("rows", np.int64), get("vectors", np.float64).reshape(-1, size)
                q_ids, q_rows, q_vectors = get("q_ids", np.int64), get("q_rows", np.int64), get("q_vectors", np.float64).reshape(-1, size)
                found = Index(coder.codes(vectors), coder.radius)
                q_codes = coder.codes(q_vectors, query=True)
                columns = [[], [], [], []]
                for i in range(len(q_ids)):
                    near = found.within(q_codes[i], k + 1)
                    near = near[own[near] != q_rows[i]]
                    scores = np.einsum("ij,j->i", vectors[near], q_vectors[i])
                    best = np.lexsort((ids[near], -scores))[:k]
                    for column, x in zip(columns, (np.full(len(best), q_rows[i]), np.full(len(best), q_ids[i]), ids[near][best], scores[best])):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["query_row", "query_id", "vec_id", "score"])

    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    columns = ["rows", "ids", "vectors", "q_rows", "q_ids", "q_vectors"]
    return pairs.select(columns).mapInArrow(run, out).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
