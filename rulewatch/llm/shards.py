"""Shards of near equal bytes.

Method: a k-d tree over document metadata.  Every node is cut along its widest dimension at the
weighted median, that is, where the bytes on both sides are nearest to their shares.  The median
is found by counting bytes per bin of a 48-bit key, four times 12 bits; the driver sees one row a
node and pass.  The upper 20 bits of the key are the position along the dimension, the lower 28 a
hash of the row, so that a value shared by a third of all rows can be cut too.

Metadata (no text) is stored once; all cuts work on that table.  Places within a shard are dealt
by a prefix sum over small buckets, so no task numbers a whole shard.

Cases: a null text has no bytes and counts 1; null metadata lies at the low end; repeated rows
are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulewatch.llm.common import stored

PLACE_BITS, TIE_BITS, PASS_BITS = 20, 28, 12
BUCKET_ROWS = 2_000


def partition(rows: DataFrame, dimensions: list[str], weight: str, row: str, leaves: int | None = None, target: int | None = None) -> DataFrame:
    """Rows with ``leaf``: give the number of leaves, or the weight that a leaf shall reach at most.

    ``row`` is a unique number of the row; ``dimensions`` are doubles.  Leaves are a power of two
    when a target is given.
    """
    if leaves is None:
        total = rows.agg(F.sum(weight)).first()[0] or 0
        leaves = 1
        while leaves * target < total:
            leaves *= 2
    ends = rows.agg(*[f(d).alias(f"{n}{i}") for i, d in enumerate(dimensions) for n, f in (("low", F.min), ("high", F.max))]).first()
    names = [f"__place{i}" for i in range(len(dimensions))]
    top = float((1 << PLACE_BITS) - 1)

    def place(i: int, d: str) -> Column:
        low, high = ends[f"low{i}"], ends[f"high{i}"]
        if low is None or high <= low:
            return F.lit(0).cast("long")
        return F.coalesce(F.floor((F.col(d) - low) / (high - low) * top), F.lit(0)).cast("long")

    tie = F.pmod(F.xxhash64(row), F.lit(1 << TIE_BITS))
    work = rows.select("*", *[place(i, d).alias(n) for (i, d), n in zip(enumerate(dimensions), names)], tie.alias("__tie"), F.lit(0).alias("leaf"))
    nodes = {0: leaves}  # first leaf of a node: its number of leaves
    while any(n > 1 for n in nodes.values()):
        cuts = _cuts(work, nodes, names, weight)
        nodes = {first + at: size for first, n in nodes.items() for at, size in (((0, n // 2), (n // 2, n - n // 2)) if n > 1 else ((0, n),))}
        if cuts:
            table = _table(work, [(leaf, d, key, half) for leaf, (d, key, half) in cuts.items()], "leaf int, __widest int, __cut long, __half int")
            moved = F.when(_key(names) > F.col("__cut"), F.col("leaf") + F.col("__half")).otherwise(F.col("leaf"))
            work = work.join(table, "leaf", "left").withColumn("leaf", moved).drop("__widest", "__cut", "__half")
    return work.drop("__tie", *names)


def _table(like: DataFrame, rows: list, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def _key(names: list[str]) -> Column:
    place = F.element_at(F.array(*names), F.col("__widest") + 1)
    return place * F.lit(1 << TIE_BITS) + F.col("__tie")


def _cuts(work: DataFrame, nodes: dict[int, int], names: list[str], weight: str) -> dict[int, tuple[int, int, int]]:
    """For each node to cut: its widest dimension, the last key of the left side, the left leaves."""
    extent = work.groupBy("leaf").agg(F.sum(weight).alias("all"), *[(F.max(n) - F.min(n)).alias(n) for n in names]).collect()
    state = {
        r["leaf"]: [max(range(len(names)), key=lambda i: (r[names[i]], -i)), 0, 0, r["all"] * (nodes[r["leaf"]] // 2) / nodes[r["leaf"]]]
        for r in extent
        if nodes[r["leaf"]] > 1
    }  # dimension, key so far, weight before that key, weight wanted on the left
    if not state:
        return {}
    bits = PLACE_BITS + TIE_BITS
    out: dict[int, tuple[int, int, int]] = {}
    while bits:
        bits -= PASS_BITS
        table = _table(work, [(leaf, d, prefix, float(before), float(want)) for leaf, (d, prefix, before, want) in state.items()], "leaf int, __widest int, __prefix long, __before double, __want double")
        keyed = work.join(table, "leaf").withColumn("__at", F.shiftright(_key(names), bits))
        bins = keyed.where(F.shiftright("__at", PASS_BITS) == F.col("__prefix")).groupBy("leaf", "__at").agg(F.sum(weight).alias("w"), F.first("__before").alias("b"), F.first("__want").alias("want"))
        upto = F.sum("w").over(Window.partitionBy("leaf").orderBy("__at"))
        crossing = bins.withColumn("upto", upto + F.col("b")).where("upto >= want and upto - w < want").collect()
        for r in crossing:
            d, _, _, want = state[r["leaf"]]
            state[r["leaf"]] = [d, r["__at"], r["upto"] - r["w"], want]
            nearer = 0 if r["upto"] - want <= want - (r["upto"] - r["w"]) else 1
            out[r["leaf"]] = (d, r["__at"] - nearer, nodes[r["leaf"]] // 2)
    return out


def slots(rows: DataFrame, shard: str, row: str) -> DataFrame:
    """Rows with ``slot``: 0, 1, 2 .. within each shard, by small buckets and their prefix sums."""
    count = rows.groupBy(shard).count().agg(F.max("count")).first()[0] or 0
    bucketed = rows.withColumn("__bucket", F.pmod(F.xxhash64(row, F.lit(1)), F.lit(1 + count // BUCKET_ROWS)))
    sizes = bucketed.groupBy(shard, "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(shard).orderBy("__bucket")) - F.col("__n")
    offsets = sizes.select(shard, "__bucket", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy(row)) - 1
    return bucketed.withColumn("__place", place).join(offsets, [shard, "__bucket"]).withColumn("slot", F.col("__before") + F.col("__place")).drop("__bucket", "__before", "__place")


def document_shards(documents: DataFrame, count: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of all documents, by equal bytes."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    code = lambda c: (F.crc32(F.col(c).cast("binary")) / float(1 << 32)).alias(c)  # noqa: E731  near values mean nothing for names
    meta = documents.select(
        "doc_id", (F.length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        code("lang"), code("source"), F.monotonically_increasing_id().alias("row"),
    )
    meta = stored(meta.withColumn("log_size", F.log2("size")), "shards")
    cut = stored(partition(meta, ["log_size", "source", "lang"], "size", "row", leaves=count), "shards")
    return slots(cut, "leaf", "row").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("leaf").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
