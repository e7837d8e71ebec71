"""What the text operators share: stored intermediates, batches bounded by bytes, word hashes.

A *chunk* is a run of documents of one input partition with a bounded number of text bytes.
Operators that need a second look at the texts store chunks once in the shared work folder
and afterwards exchange only small rows keyed by chunk.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from rulewatch.session import work_dir

SLICE_BYTES = 4 << 20
CHUNK_BYTES = 4 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own for one call, in the work folder that all executors share."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write and read again: later plans start from the files, whichever executor is lost."""
    folder = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """As ``stored``, bucketed: joins on the column then move the other side only.

    The name is needed to write the buckets alone; the files stay when it is dropped.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(partitions(df), column).option("compression", "zstd")
    writer.option("path", scratch(spark, name)).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def free_name(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches, column: str, limit: int = SLICE_BYTES):
    """Record batches cut where the bytes of ``column`` pass a limit (one row at least)."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column).cast(pa.binary())).fill_null(0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def chunk_ids():
    """Numbers for the chunks of a task: the same again if the task is repeated."""
    at = TaskContext.get().partitionId() << 24
    while True:
        yield at
        at += 1


def pack(array: np.ndarray) -> bytes:
    """Compressed bytes of an array, its bytes taken plane by plane."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0] .. starts[0]+lengths[0]-1, starts[1] .. and so on."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


ODD = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


class Kept(dict):
    """Kept in a process; a task that carries this module starts with an empty one."""

    def __reduce__(self):
        return Kept, ()


_POWERS = Kept()


def _powers(seed: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64, for the longest array yet."""
    size = 1 << max(16, int(size - 1).bit_length())
    if (seed, size) not in _POWERS:
        _POWERS.clear()
    for s in range(len(ODD)):
        if (s, size) not in _POWERS:
            _POWERS[s, size] = tuple(
                np.cumprod(np.full(size, x, np.uint64)) for x in (ODD[s], pow(ODD[s], -1, 1 << 64))
            )
    return _POWERS[seed, size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class RunningSums:
    """Hashes of spans of one array, each from the difference of two running sums."""

    def __init__(self, values: np.ndarray, seed: int = 0):
        powers, self.inverse = _powers(seed, len(values) + 1)
        self.sums, self.seed = np.zeros(len(values) + 1, np.uint64), seed
        np.cumsum(values * powers[: len(values)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        spans = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(spans + (ends - starts).astype(np.uint64) * np.uint64(ODD[1 - self.seed]))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of values[starts:ends]."""
    return RunningSums(values, seed)(starts, ends)


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte buffer that ends with a space."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], IS_SPACE[buffer])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def sliding(op, values: np.ndarray, width: int) -> np.ndarray:
    """op (minimum or maximum) over every ``width`` neighbouring values, by doubling."""
    reach = 1
    while reach * 2 <= width:
        values = op(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return op(values[:-rest], values[rest:]) if rest else values


NO_ID = (1 << 63) - 1  # stands for a null id: larger than any other


def chunked(df: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None, limit: int = CHUNK_BYTES) -> DataFrame:
    """Documents as stored chunks: ``chunk, words, size, ids, lengths, texts, rest``.

    The files are bucketed by chunk, so joins with small rows for each chunk move only those.
    ``rest`` has the columns to carry.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in carry or ()]) if carry else F.struct(F.lit(True).alias("none"))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), rest.alias("rest"))

    def run(batches):
        numbers, ids, texts, others, size = chunk_ids(), [], [], [], 0

        def flush():
            sink = pa.BufferOutputStream()
            if carry:
                table = pa.Table.from_batches([pa.RecordBatch.from_struct_array(x) for x in others])
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table)
            others_data = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes()) if carry else b""
            joined = b" ".join(texts)
            words = sum(len(t.split()) for t in texts)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            data = zstandard.ZstdCompressor(level=3).compress(joined)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], kind) for x, kind in ((next(numbers), pa.int64()), (words, pa.int64()), (len(joined), pa.int64()), (np.array(ids, np.int64).tobytes(), pa.binary()), (lengths.tobytes(), pa.binary()), (data, pa.binary()), (others_data, pa.binary()))],
                ["chunk", "words", "size", "ids", "lengths", "texts", "rest"],
            )

        for part in slices(batches, "text", limit // 4):
            ids += part.column("id").fill_null(NO_ID).to_pylist()
            others.append(part.column("rest"))
            new = as_bytes(part.column("text"))
            texts += new
            size += sum(map(len, new))
            if size >= limit * 3 // 4:
                yield flush()
                ids, texts, others, size = [], [], [], 0
        if ids:
            yield flush()

    out = rows.mapInArrow(run, "chunk long, words long, size long, ids binary, lengths binary, texts binary, rest binary")
    return bucketed(out, "chunk", "chunks")


def chunk_rows(batches):
    """The rows of chunk batches as dicts; texts still compressed, lists of numbers as arrays by field."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: _value(batch.column(name)[at]) for name in batch.schema.names}
            pa.default_memory_pool().release_unused()


def _value(scalar: pa.Scalar):
    kind = scalar.type
    if scalar.is_valid and pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        if all(pa.types.is_integer(f.type) for f in kind.value_type):
            return {f.name: scalar.values.field(f.name).to_numpy() for f in kind.value_type}
    return scalar.as_py()


def chunk_texts(row: dict) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a chunk."""
    lengths = np.frombuffer(row["lengths"], np.int64)
    data = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, row["size"]))
    ends = np.cumsum(lengths + 1) - 1
    return np.frombuffer(row["ids"], np.int64), [data[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]


def chunk_rest(row: dict) -> pa.Table:
    """The carried columns of a chunk."""
    with zstandard.ZstdDecompressor().stream_reader(row["rest"]) as data:
        return pa.ipc.open_stream(pa.py_buffer(data.read())).read_all()


def text_groups(texts: list[bytes], limit: int = 1 << 19):
    """(first, last + 1) of runs of texts of bounded bytes, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes], seeds=(0,)) -> tuple[list[np.ndarray], np.ndarray]:
    """64-bit hashes of all words, an array for each seed, and the number of words of each text."""
    out, counts = [[] for _ in seeds], np.zeros(len(texts), np.int64)
    for a, b in text_groups(texts):
        buffer = np.frombuffer(b" ".join(texts[a:b]) + b" ", np.uint8)
        starts, ends = word_spans(buffer)
        text_starts = np.cumsum([0, *[len(t) + 1 for t in texts[a : b - 1]]])
        counts[a:b] = np.bincount(np.searchsorted(text_starts, starts, side="right") - 1, minlength=b - a)
        values = buffer.astype(np.uint64) + np.uint64(1)
        for k, seed in enumerate(seeds):
            out[k].append(span_hashes(values, starts, ends, seed))
    return [np.concatenate(x) if x else np.empty(0, np.uint64) for x in out], counts
