"""Near duplicates by similarity of shingles.

Method: two texts are linked if the sets of their five-word shingles have a Jaccard similarity of
0.8 or more.  Texts with equal sets are one node.  Nodes that share any of 32 keys, each made of
six min-hashes, fall in one group; within a group SimHash fingerprints of the sets are compared
bit-sliced at a wide radius, and pairs within it by the shingles themselves.  Pairs that one link
chain joins already are not compared.

What may be missed: a pair of similarity 0.8 shares no key once in 17,000 times, and its
fingerprints (about 10 bits apart) lie beyond the radius of 20 in a few of 10,000; both fall steeply
above 0.8.  Nothing below 0.8 is linked, but for equal 64-bit hashes.

Large groups: a group of more shingles than a tile is dealt to tiles by hash, some members (leaders)
to all of them.  That joins most copies of one text.  The members outside the largest part are
then compared with every tile, so all pairs of different parts meet.

Texts are stored once, as chunks, and never move: keys, groups and the rows to keep go to the
chunks, which send the shingles of the members of groups alone.

Cases: texts without words are one node; a text of fewer than five words is one shingle; of each
component the smallest id stays, a null id only if all are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rulewatch.llm.common import SLICE_BYTES, chunk_rest, chunk_rows, chunk_texts, chunked, free_name, mix, partitions, slices, stored, text_groups
from rulewatch.llm.graph import components
from rulewatch.llm.simhash import SEED, linked, majority, shingle_hashes

SHINGLE, RADIUS = 5, 20
LEAST = (4, 5)  # the least similarity, as a fraction
BANDS, ROWS = 32, 6
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
TILE, MEMBER, LEADERS = 1 << 19, 256, 16  # a tile's shingles; a member counts as so many more
BATCH_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20  # small, so that no value is a large object in an executor's heap
SHARE = 16  # groups of one row that a chunk is asked for at a time
SENT = 1 << 18  # shingles that leave a chunk at a time, or those of one text


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    return [np.unique(np.array(shingle_hashes(t, SHINGLE), np.uint64)) for t in texts]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of keys for each set, of which none is empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band, factors in enumerate(FACTORS):
        key = np.full(len(sets), band, np.uint64)
        for factor in factors:
            key = mix(key ^ np.minimum.reduceat(flat * factor, starts))
        keys[:, band] = key
    return keys


def signatures(chunks: DataFrame, kind: str) -> DataFrame:
    """``doc_id, chunk, place, node, size, keys`` of every row; a node stands for a set of shingles."""

    def run(batches):
        for row in chunk_rows(batches):
            _, texts = chunk_texts(row)
            ids = chunk_rest(row).column("doc_id").combine_chunks()
            for a, b in text_groups(texts, SLICE_BYTES):
                sets = shingle_sets(texts[a:b])
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64)
                some = [x for x in sets if len(x)]
                keys = band_keys(some).view(np.int64).ravel() if some else np.empty(0, np.int64)
                ends = np.concatenate(([0], np.cumsum(BANDS * (sizes > 0)))).astype(np.int32)
                columns = [ids.slice(a, b - a), pa.array(np.full(b - a, row["chunk"])), pa.array(np.arange(a, b)), pa.array(nodes.view(np.int64)), pa.array(sizes)]
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "chunk", "place", "node", "size", "keys"])

    rows = chunks.select("chunk", "size", "ids", "lengths", "texts", "rest")
    return rows.mapInArrow(run, f"doc_id {kind}, chunk long, place long, node long, size long, keys array<long>")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """``node, root``: the groups that nodes form by keys they share."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return components(keyed.withColumnRenamed("node", "a").join(least, "key").select("a", "b"))


def links_within(chunks: DataFrame, dealt: DataFrame) -> DataFrame:
    """``a, b``: links that connect all similar nodes of each group of ``group, share, node, chunk, place``.

    A chunk is asked once for each ``share``: a bounded number of the groups that a row is dealt to.
    """
    names = ["group", "node", "fingerprint", "shingles"]

    def shingled(batches):
        for row in chunk_rows(batches):
            _, texts = chunk_texts(row)
            members = row["members"]
            order = np.argsort(members["place"], kind="stable")
            places, first = np.unique(members["place"][order], return_index=True)
            last = np.append(first[1:], len(order))
            for a, b in text_groups([texts[i] for i in places.tolist()], SLICE_BYTES // 4):
                sets = shingle_sets([texts[i] for i in places[a:b].tolist()])
                prints = majority(np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))).view(np.int64)
                data = pa.array([x.tobytes() for x in sets], pa.binary())
                of = np.repeat(np.arange(b - a), last[a:b] - first[a:b])
                at = order[first[a] : last[b - 1]]
                sent = np.cumsum(np.fromiter(map(len, sets), np.int64, len(sets))[of]) // SENT
                cuts = np.flatnonzero(np.diff(sent)) + 1
                for part, who in zip(np.split(at, cuts), np.split(of, cuts)):
                    columns = [pa.array(members["group"][part]), pa.array(members["node"][part]), pa.array(prints[who]), data.take(pa.array(who))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    def forest(groups, nodes, prints, shingles):
        sets = [np.frombuffer(x, np.uint64) for x in shingles]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))

        def alike(a, b):
            out = LEAST[1] * np.minimum(sizes[a], sizes[b]) >= LEAST[0] * np.maximum(sizes[a], sizes[b])
            for k in np.flatnonzero(out).tolist():
                both = np.concatenate((sets[a[k]], sets[b[k]]))
                both.sort()
                common = np.count_nonzero(both[1:] == both[:-1])
                out[k] = LEAST[1] * common >= LEAST[0] * (len(both) - common)
            return out

        root = linked(np.array(groups, np.int64), np.array(prints, np.int64).view(np.uint64), RADIUS, alike)
        nodes = np.array(nodes, np.int64)
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], ["a", "b"])

    def run(batches):
        held: list[list] = [[], [], [], []]
        size = 0
        for part in slices(batches, "shingles"):
            for values, name in zip(held, names):
                values += part.column(name).to_pylist()
            size = sum(map(len, held[-1]))
            if size >= BATCH_BYTES and (end := held[0].index(held[0][-1])):  # the last group may go on
                yield forest(*[x[:end] for x in held])
                held = [x[end:] for x in held]
        if held[0]:
            yield forest(*held)

    asked = dealt.groupBy("chunk", "share").agg(F.collect_list(F.struct("place", "group", "node")).alias("members")).drop("share")
    met = chunks.select("chunk", "size", "ids", "lengths", "texts").join(asked, "chunk")
    sets = met.mapInArrow(shingled, "group long, node long, fingerprint long, shingles binary")
    return sets.repartition(partitions(chunks), "group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")


def tile_of(salt: int, tiles):
    return F.pmod(F.xxhash64("node", F.lit(salt)), tiles).cast("int")


def similar(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, root`` of nodes that are linked to others."""
    grouped = nodes.select("node", "first.chunk", "first.place", (F.col("size") + MEMBER).alias("weight")).join(shared_keys(nodes), "node")
    sums = grouped.groupBy("root").agg(F.ceil(F.sum("weight") / TILE).cast("int").alias("tiles"), F.count("*").alias("members"))
    tiled = stored(grouped.join(sums, "root").withColumn("tile", tile_of(0, F.col("tiles"))), "similar")
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    leads = (F.col("tiles") > 1) & (tile_of(1, F.greatest(F.lit(1), F.floor(F.col("members") / LEADERS))) == 0)
    first = tiled.withColumn("tile", F.explode(F.when(leads, every).otherwise(F.array("tile"))))
    share = lambda number: F.floor(F.col(number) / SHARE).alias("share")
    links = stored(links_within(chunks, first.select(F.xxhash64("root", "tile").alias("group"), share("tile"), "node", "chunk", "place")), "similar")
    found, wide = components(links), tiled.where("tiles > 1")
    if wide.isEmpty():
        return found
    parts = wide.join(found.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    most = parts.groupBy("root", "part").agg(F.sum("weight").alias("weight")).groupBy("root").agg(F.max_by("part", "weight").alias("most"))
    others = stored(parts.join(most, "root").where("part <> most").drop("part", "most"), "similar")
    if others.isEmpty():
        return found
    cuts = others.groupBy("root").agg(F.ceil(F.sum("weight") / TILE).cast("int").alias("cuts"))
    all_tiles = wide.join(cuts, "root").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    all_cuts = others.join(cuts, "root").withColumn("cut", tile_of(2, F.col("cuts"))).withColumn("tile", F.explode(every))
    met = [x.select(F.xxhash64("root", "cut", "tile").alias("group"), share(n), "node", "chunk", "place") for x, n in ((all_tiles, "cut"), (all_cuts, "tile"))]
    second = met[0].unionByName(met[1]).dropDuplicates(["group", "node"])
    return components(links.unionByName(links_within(chunks, second)))


def keep_one(documents: DataFrame) -> DataFrame:
    """One row, with all its columns, of each component: the one with the smallest id."""
    names = documents.columns
    zero = free_name(documents, "__zero")
    lost = free_name(documents, "__lost")
    carry = [c for c in names if c != "text"] + [lost]
    chunks = chunked(documents.withColumns({zero: F.lit(0), lost: F.col("text").isNull()}), "text", zero, carry, CHUNK_BYTES)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "chunk", "place")
    signed = signatures(chunks, documents.schema["doc_id"].dataType.simpleString())
    nodes = stored(signed.groupBy("node").agg(F.min(order).alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys")), "similar")
    placed = nodes.select("node", "first").join(similar(chunks, nodes), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = placed.groupBy("root").agg(F.min("first").alias("first")).groupBy("first.chunk").agg(F.collect_list("first.place").alias("places"))

    def keep(batches):
        for row in chunk_rows(batches):
            _, texts = chunk_texts(row)
            rest = chunk_rest(row).combine_chunks()
            places = np.sort(np.array(row["places"], np.int64))
            for a, b in text_groups([texts[i] for i in places.tolist()], SLICE_BYTES):
                part = rest.take(pa.array(places[a:b])).combine_chunks()
                found = pa.array([texts[i] for i in places[a:b].tolist()], pa.binary()).cast(pa.string())
                columns = {c: part.column(c).combine_chunks() for c in carry} | {"text": found}
                columns["text"] = pa.compute.if_else(columns[lost], pa.scalar(None, pa.string()), found)
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return chunks.select("chunk", "size", "ids", "lengths", "texts", "rest").join(kept, "chunk").mapInArrow(keep, documents.schema)
