"""Bytes that lie in a string of 200 bytes which also starts anywhere else.

Method: a suffix array over anchors, sorted by a distributed merge sort that knows common
prefixes.  Anchors are the places whose hash of 32 bytes is least among their neighbours, chosen
by content alone, so two equal strings of 200 bytes have an anchor at the same place.  A first
pass counts the 32 bytes at each anchor in a sketch; only anchors estimated to be repeated go on.
Their suffixes, 200 bytes at most, leave each chunk as sorted runs, front-coded (each says how
much it shares with the one before).  Runs that may share a prefix meet in one task, where a
loser tree merges them; every comparison starts behind the prefix that both are known to share.

Neighbours in the merged order with 32 bytes in common form a class.  In a class, a string of 200
bytes around the anchor is repeated if two members agree in all of it, to the left of the anchor
too.  Of each member only the first and last repeated offset matter: the strings between them
all hold the anchor.  Equal surroundings within a chunk travel once.

A class with very many members (a passage of a third of all documents) is not gathered: its
strings are counted by 128-bit hashes, like any grouping.

Cases: a null or empty text has no bytes; a text of fewer than 200 bytes has no such string; a
row repeated is another start of its strings, so both rows lose them; strings overlap freely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from rulewatch.llm import sketch
from rulewatch.llm.common import NO_ID, ODD, RunningSums, chunk_rest, chunk_rows, chunk_texts, chunked, flat_ranges, free_name, mix, sliding, span_hashes, stored, text_groups

WIDTH, HEAD = 200, 32
HOT = 20_000
STRINGS, HEADS = -1, -2  # buckets of what is exchanged for hot classes
BUCKET_BYTES = 32 << 20
_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)


class Anchors:
    """The anchors of a chunk's texts, with the bytes around them that can matter."""

    def __init__(self, texts: list[bytes], width: int = WIDTH, head: int = HEAD):
        self.width, self.head = width, head
        at, heads, hashes = [], [], []
        self.data = b"".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        for a, b in text_groups(texts):
            start = int(ends[a - 1]) if a else 0
            buffer = np.frombuffer(self.data, np.uint8)[start : int(ends[b - 1])]
            found, values = self._places(buffer)
            found = found + start
            text = np.searchsorted(ends, found, side="right")
            first, last = np.where(text > 0, ends[text - 1], 0), ends[text]
            whole = (found + head <= last) & (last - first >= width)
            found, values, first, last = found[whole], values[whole], first[whole], last[whole]
            left, right = np.maximum(first, found - (width - head)), np.minimum(last, found + width)
            fits = right - left >= width
            found, values, left, right = found[fits], values[fits], left[fits], right[fits]
            at.append(np.column_stack((found, left, right)))
            heads.append(values)
            small = buffer.astype(np.uint64) + np.uint64(1)
            own = [span_hashes(small, left - start, right - start, seed) for seed in (0, 1)]
            hashes.append(np.column_stack([mix(h ^ (found - left).astype(np.uint64) * np.uint64(ODD[0])) for h in own]))
        self.at, self.left, self.right = (np.concatenate(at) if at else np.empty((0, 3), np.int64)).T
        self.heads = np.concatenate(heads) if heads else np.empty(0, np.uint64)
        self.context = np.concatenate(hashes) if hashes else np.empty((0, 2), np.uint64)

    def _places(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose hash is the least of some ``width - head + 1`` neighbours, and the hashes."""
        reach = self.width - self.head + 1
        if len(buffer) < self.width:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h, size = _BYTE[buffer], 1
        while size < self.head:  # a hash of twice the bytes from two
            h = h[:-size] * np.uint64(ODD[0] ^ size << 1) + h[size:]
            size *= 2
        short = (mix(h) >> np.uint64(32)).astype(np.uint32)
        least = np.zeros(len(short) + reach - 1, np.uint32)
        least[reach - 1 : len(short)] = sliding(np.minimum, short, reach)
        found = np.flatnonzero(sliding(np.maximum, least, reach) == short)
        return found, mix(h[found])

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, which, counts = np.unique(self.heads, return_inverse=True, return_counts=True)
        return keys, counts, which

    def distinct(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the anchors chosen, one for each different context, and how many have it."""
        a, b = self.context[which].T
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else order
        return which[order[first]], np.diff(np.append(first, len(a)))

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All whole strings around the anchors: which anchor, where they start, 128-bit hashes."""
        low = np.maximum(self.left[which], self.at[which] - (self.width - self.head))
        high = np.minimum(self.at[which], self.right[which] - self.width)
        starts = flat_ranges(low, high - low + 1)
        owner = np.repeat(which, high - low + 1)
        out = np.empty((len(starts), 2), np.uint64)
        step = 1 << 19
        order = np.argsort(starts, kind="stable")
        while len(order):  # windows of the buffer, so that the running sums stay small
            base = starts[order[0]]
            mine = order[: np.searchsorted(starts[order], base + step)]
            values = np.frombuffer(self.data, np.uint8)[base : base + step + self.width].astype(np.uint64) + np.uint64(1)
            for seed in (0, 1):
                out[mine, seed] = span_hashes(values, starts[mine] - base, starts[mine] - base + self.width, seed)
            order = order[len(mine) :]
        return owner, starts, out


def common_prefix(x: bytes, y: bytes, start: int = 0) -> int:
    """Length of the common prefix; ``start`` bytes are known to be equal."""
    most = min(len(x), len(y))
    step = 16
    while start < most and x[start : start + step] == y[start : start + step]:
        start += step
    if start >= most:
        return most
    while start < most and x[start] == y[start]:
        start += 1
    return start


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs of (strings, prefix shared with the one before) by a loser tree.

    Returns (run, place) in order, and the prefix that each shares with the one before it.  A
    player knows how much its string shares with the last winner: of two players the one that
    shares more is smaller, and only if they share the same are their bytes compared, behind that.
    """
    count = len(runs)
    if not count:
        return [], []
    place, shared = [0] * count, [0 if strings else -1 for strings, _ in runs]
    current = [strings[0] if strings else b"" for strings, _ in runs]
    order: list[tuple[int, int]] = []
    prefixes: list[int] = []

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows what it shares with the winner."""
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        known = shared[a]
        if known < 0:
            return a, b
        x, y = current[a], current[b]
        if x == y:
            win, lose = (a, b) if a < b else (b, a)
            shared[lose] = len(x)
            return win, lose
        win, lose = (a, b) if x < y else (b, a)
        shared[lose] = common_prefix(x, y, known)
        return win, lose

    losers = [-1] * count

    def build(node: int) -> int:
        if node >= count:
            return node - count
        a, b = build(2 * node), build(2 * node + 1)
        win, losers[node] = play(a, b)
        return win

    winner = build(1) if count > 1 else 0
    while shared[winner] >= 0:
        order.append((winner, place[winner]))
        prefixes.append(shared[winner])
        strings, own = runs[winner]
        place[winner] += 1
        at = place[winner]
        if at < len(strings):
            current[winner], shared[winner] = strings[at], own[at]
        else:
            shared[winner] = -1
        node = (winner + count) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    return order, prefixes


def write_run(rights: list[bytes], lefts: list[bytes], counts: np.ndarray, context: np.ndarray) -> bytes:
    """A sorted run, front-coded and compressed."""
    shared = [0, *map(common_prefix, rights, rights[1:])]
    parts = [np.array(x, np.uint8).tobytes() for x in (shared, [len(r) for r in rights], [len(x) for x in lefts], np.minimum(counts, 2))]
    parts += [context.tobytes(), *[r[n:] for r, n in zip(rights, shared)], *lefts]
    return len(rights).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def read_run(data: bytes):
    """Rights, shared prefixes, lefts, counts and contexts of a run."""
    n, data = int.from_bytes(data[:4], "little"), zstandard.ZstdDecompressor().decompress(data[4:])
    shared, sizes, left_sizes, counts = (np.frombuffer(data, np.uint8, n, k * n) for k in range(4))
    context = np.frombuffer(data, np.uint64, 2 * n, 4 * n).reshape(n, 2)
    at, rights, lefts, last = 20 * n, [], [], b""
    for same, size in zip(shared.tolist(), sizes.tolist()):
        last = last[:same] + data[at : at + size - same]
        at += size - same
        rights.append(last)
    for size in left_sizes.tolist():
        lefts.append(data[at : at + size])
        at += size
    return rights, shared.tolist(), lefts, counts, context


def repeated_offsets(classes: np.ndarray, lefts: list[bytes], rights: list[bytes], width: int, head: int) -> np.ndarray:
    """First and last offset (bytes before the anchor) at which a member's string is repeated
    in its class; last below first if none is."""
    reach = width - head
    out = np.tile(np.array([width, -1]), (len(classes), 1))
    first = np.flatnonzero(np.append(True, classes[1:] != classes[:-1])) if len(classes) else np.empty(0, np.int64)
    group_ends = np.append(first[1:], len(classes))
    start = 0
    while start < len(classes):  # whole classes, two thousand members at a time
        end = int(group_ends[max(np.searchsorted(group_ends, start + 2048, side="right") - 1, np.searchsorted(group_ends, start, side="right"))])
        rows = b"".join(lefts[i].rjust(reach, b"\0") + rights[i].ljust(width, b"\0") for i in range(start, end))
        values = np.frombuffer(rows, np.uint8).astype(np.uint64) + np.uint64(1)
        hashes = RunningSums(values)
        base = np.arange(end - start) * (reach + width)
        left, right = (np.fromiter(map(len, x[start:end]), np.int64, end - start) for x in (lefts, rights))
        salt = mix(classes[start:end].astype(np.uint64))
        for offset in range(reach + 1):
            fits = np.flatnonzero((left >= offset) & (right >= width - offset))
            if len(fits) < 2:
                continue
            begin = base[fits] + reach - offset
            h = hashes(begin, begin + width) ^ salt[fits]
            order = np.argsort(h, kind="stable")
            same = h[order[1:]] == h[order[:-1]]
            member = np.zeros(len(fits), bool)
            member[order[1:]] |= same
            member[order[:-1]] |= same
            hit = fits[member] + start
            out[hit, 0] = np.minimum(out[hit, 0], offset)
            out[hit, 1] = offset
        start = end
    return out


def merged_bucket(table: pa.Table, width: int, head: int) -> pa.Table:
    """``chunk, found`` of the runs of one bucket: contexts and their repeated offsets."""
    runs = [read_run(x) for x in table.column("run").to_pylist()]
    order, prefixes = merge([(r[0], r[1]) for r in runs])
    classes = np.cumsum(np.array(prefixes, np.int64) < head)
    owner = np.array([a for a, _ in order], np.int64)
    place = np.array([b for _, b in order], np.int64)
    context = np.concatenate([r[4] for r in runs])
    flat = np.cumsum([0, *[len(r[0]) for r in runs]])[owner] + place
    context, counts = context[flat], np.concatenate([r[3] for r in runs])[flat].astype(np.int64)
    # Equal contexts are one member; if they are several, all their strings are repeated.
    by = np.lexsort((context[:, 1], context[:, 0], classes))
    fresh = np.append(True, (classes[by][1:] != classes[by][:-1]) | (context[by][1:] != context[by][:-1]).any(axis=1))
    member = np.cumsum(fresh) - 1
    total = np.bincount(member, counts[by])
    one = by[fresh]
    sizes = np.bincount(classes[one], minlength=int(classes.max()) + 1 if len(classes) else 0)
    rights, lefts = [runs[a][0][b] for a, b in zip(owner[one], place[one])], [runs[a][2][b] for a, b in zip(owner[one], place[one])]
    left, right = (np.fromiter(map(len, x), np.int64, len(x)) for x in (lefts, rights))
    found = np.column_stack((np.maximum(0, width - right), left))
    found[total < 2] = (width, -1)
    several = np.flatnonzero(sizes[classes[one]] > 1)
    shared = repeated_offsets(classes[one][several], [lefts[i] for i in several], [rights[i] for i in several], width, head)
    found[several] = np.column_stack((np.minimum(found[several, 0], shared[:, 0]), np.maximum(found[several, 1], shared[:, 1])))
    offsets = np.empty((len(classes), 2), np.int64)
    offsets[by] = found[member]
    rows: dict[int, bytes] = {}
    chunks = table.column("chunk").to_pylist()
    of_run = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[of_run], np.arange(len(runs) + 1))
    for run in range(len(runs)):
        mine = of_run[starts[run] : starts[run + 1]]
        mine = mine[offsets[mine, 0] <= offsets[mine, 1]]
        if len(mine):
            rows[run] = np.column_stack((context[mine], offsets[mine].astype(np.uint64))).tobytes()
    return pa.table({"chunk": pa.array([chunks[r] for r in rows], pa.int64()), "found": pa.array(list(rows.values()), pa.binary())})


def repeated_places(chunks: DataFrame, width: int = WIDTH, head: int = HEAD, hot: int = HOT) -> DataFrame:
    """``chunk, found, strings, heads``: contexts with repeated offsets; hashes of repeated strings
    around the anchors of hot classes, and the heads of those anchors."""
    columns = ("chunk", "size", "ids", "lengths", "texts")
    total = chunks.agg(F.sum("size")).first()[0] or 0
    anchors = 2 * total // (width - head + 2)
    bits = sketch.width_bits(anchors)
    buckets = 1 + anchors * (width + head) // BUCKET_BYTES

    def count(batches):
        for row in chunk_rows(batches):
            keys, counts, _ = Anchors(chunk_texts(row)[1], width, head).keys()
            yield sketch.parts(row["chunk"], keys, counts, bits)

    levels = sketch.levels(chunks.select(*columns).mapInArrow(count, sketch.PART), hot)

    def exchange(batches):
        for row in chunk_rows(batches):
            anchors = Anchors(chunk_texts(row)[1], width, head)
            keys, _, which = anchors.keys()
            level = sketch.estimate(keys, row["flags"], bits)[which] if len(keys) else np.empty(0, np.int8)
            out: list[tuple[int, bytes]] = []
            if (level == 2).any():
                _, starts, hashes = anchors.strings(np.flatnonzero(level == 2))
                _, one = np.unique(starts, return_index=True)  # a string may hold several anchors
                hashes, counts = np.unique(hashes[one], axis=0, return_counts=True)
                out.append((STRINGS, np.column_stack((hashes, np.minimum(counts, 2).astype(np.uint64))).tobytes()))
                out.append((HEADS, keys[np.unique(which[level == 2])].tobytes()))
            one, counts = anchors.distinct(np.flatnonzero(level == 1))
            data, bucket = anchors.data, (anchors.heads[one] % np.uint64(buckets)).astype(np.int64)
            rights = [data[a:b] for a, b in zip(anchors.at[one].tolist(), anchors.right[one].tolist())]
            lefts = [data[a:b] for a, b in zip(anchors.left[one].tolist(), anchors.at[one].tolist())]
            order = np.array(sorted(range(len(one)), key=rights.__getitem__), np.int64)
            order = order[np.argsort(bucket[order], kind="stable")]
            cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0)) if len(order) else order
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                mine = order[a:b]
                out.append((int(bucket[mine[0]]), write_run([rights[i] for i in mine], [lefts[i] for i in mine], counts[mine], anchors.context[one[mine]])))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([row["chunk"]] * len(out), pa.int64()), pa.array([r for _, r in out], pa.binary())], ["bucket", "chunk", "run"])

    sent = stored(chunks.select(*columns).join(levels, "chunk").mapInArrow(exchange, "bucket long, chunk long, run binary"), "suffixes")
    places = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(lambda table: merged_bucket(table, width, head), "chunk long, found binary")
    places = places.groupBy("chunk").agg(F.collect_list("found").alias("found"))

    def unpacked(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                hashes = np.frombuffer(batch.column("run")[at].as_py(), np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*hashes.T, np.full(len(hashes), batch.column("chunk")[at].as_py()))], ["a", "b", "n", "chunk"])

    strings = sent.where(F.col("bucket") == STRINGS).select("chunk", "run").mapInArrow(unpacked, "a long, b long, n long, chunk long")
    strings = strings.withColumn("n", F.sum("n").over(Window.partitionBy("a", "b"))).where("n > 1")
    strings = strings.groupBy("chunk").agg(F.collect_list(F.struct("a", "b")).alias("strings"))
    heads = sent.where(F.col("bucket") == HEADS).select("chunk", F.col("run").alias("heads"))
    return places.join(strings.join(heads, "chunk"), "chunk", "full")


def _sorted_lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For rows of two words: the place of each in ``keys`` (sorted by both), or -1."""
    # Rows that share the first word are few.
    at = np.searchsorted(keys[:, 0], wanted[:, 0])
    out = np.full(len(wanted), -1)
    open_rows = np.arange(len(wanted))
    while len(open_rows):
        here = at[open_rows]
        inside = here < len(keys)
        open_rows, here = open_rows[inside], here[inside]
        same = keys[here, 0] == wanted[open_rows, 0]
        open_rows, here = open_rows[same], here[same]
        equal = keys[here, 1] == wanted[open_rows, 1]
        out[open_rows[equal]] = here[equal]
        open_rows = open_rows[~equal]
        at[open_rows] += 1
    return out


def covered(row: dict, texts: list[bytes], width: int, head: int) -> np.ndarray:
    """Which bytes of the chunk's joined texts lie in a repeated string."""
    anchors = Anchors(texts, width, head)
    change = np.zeros(len(anchors.data) + 1, np.int32)
    if row["found"]:
        found = np.frombuffer(b"".join(row["found"]), np.uint64).reshape(-1, 4)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        at = _sorted_lookup(found[:, :2], anchors.context)
        hit = np.flatnonzero(at >= 0)
        first, last = found[at[hit], 2].astype(np.int64), found[at[hit], 3].astype(np.int64)
        np.add.at(change, anchors.at[hit] - last, 1)
        np.add.at(change, anchors.at[hit] - first + width, -1)
    if row["strings"] is not None:
        found = np.column_stack((row["strings"]["a"], row["strings"]["b"])).view(np.uint64)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        hot = np.flatnonzero(np.isin(anchors.heads, np.frombuffer(row["heads"], np.uint64)))
        for first in range(0, len(hot), 2048):
            _, starts, hashes = anchors.strings(hot[first : first + 2048])
            starts = starts[_sorted_lookup(found, hashes) >= 0]
            np.add.at(change, starts, 1)
            np.add.at(change, starts + width, -1)
    return np.cumsum(change[:-1], dtype=np.int32) > 0


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, head: int = HEAD, hot: int = HOT) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept`` (bytes); a row for each row."""
    chunks = chunked(df, text, key)
    places = repeated_places(chunks, width, head, hot)

    def cut(batches):
        for row in chunk_rows(batches):
            ids, texts = chunk_texts(row)
            gone = covered(row, texts, width, head)
            ends = np.cumsum([0, *map(len, texts)])
            for first in range(0, len(texts), 512):
                rows = range(first, min(first + 512, len(texts)))
                removed, spans, kept = [], [], []
                for i in rows:
                    mask = gone[ends[i] : ends[i + 1]]
                    removed.append(int(mask.sum()))
                    spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if removed[-1] else 0)
                    kept.append(np.frombuffer(texts[i], np.uint8)[~mask].tobytes() if removed[-1] else texts[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if ids[i] == NO_ID else int(ids[i]) for i in rows], pa.int64()), pa.array([len(texts[i]) for i in rows], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    ["id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    out = chunks.select("chunk", "size", "ids", "lengths", "texts").join(places, "chunk", "left")
    return out.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", key)


def digests(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    return remove_repeats(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def keep_unrepeated(documents: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows, with all their columns, without repeated bytes; what is left of a character cut
    apart goes too, ``length`` follows the text, and a row of which nothing is left goes."""
    names = documents.columns
    carry = [c for c in names if c != text]
    number = free_name(documents, "__id")
    chunks = chunked(documents.withColumn(number, F.lit(0)), text, number, carry)
    places = repeated_places(chunks)

    def cut(batches):
        for row in chunk_rows(batches):
            _, texts = chunk_texts(row)
            gone = covered(row, texts, WIDTH, HEAD)
            ends = np.cumsum([0, *map(len, texts)])
            rest = chunk_rest(row).combine_chunks()
            for first in range(0, len(texts), 512):
                rows = range(first, min(first + 512, len(texts)))
                masks = [gone[ends[i] : ends[i + 1]] for i in rows]
                cut_texts = [np.frombuffer(texts[i], np.uint8)[~m].tobytes().decode("utf-8", "ignore") if m.any() else texts[i].decode() for i, m in zip(rows, masks)]
                changed = np.array([m.any() for m in masks])
                keep = np.array([not c or bool(t) for c, t in zip(changed, cut_texts)])
                part = rest.slice(first, len(rows))
                columns = {c: part.column(c).combine_chunks() for c in carry}
                columns[text] = pa.array(cut_texts, pa.string())
                if length in columns:
                    sizes = pa.array([len(t) for t in cut_texts], pa.int64()).cast(columns[length].type)
                    columns[length] = pa.compute.if_else(pa.array(changed), sizes, columns[length])
                yield pa.RecordBatch.from_pydict({c: columns[c] for c in names}).filter(pa.array(keep))

    out = chunks.select("chunk", "size", "ids", "lengths", "texts", "rest").join(places, "chunk", "left")
    return out.mapInArrow(cut, documents.schema)
