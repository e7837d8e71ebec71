"""Language-model scores from word classes.

Method: Brown's class-based bigrams.  Exchange clustering assigns words to classes so that class
bigrams are as informative as possible; a text's probability is the product of class transitions
and of words given their class.

Chunks of documents are coded once against a dictionary of their own and stored; later passes
work on numbers.  The most frequent words are exchanged between classes until nothing improves,
on their bigram counts over the whole corpus (a matrix of fixed size on the driver).  Then every
other word is placed by its occurrences next to those words; one that never stands there gets a
class by hash.  In sweeps, each word (those exchanged too) then goes to the class under which all
its occurrences are likeliest next to the classes that its neighbours have.  Sweeps end after SWEEPS,
or when one does not make class bigrams more informative.

The vocabulary is never held in one place.  Words are dealt by hash to parts, so many that about FAN
words of chunks (PART_BYTES at most, if words are short of that) meet in one.  Once, a part numbers its
words and adds up their counts; numbers and counts go back to each chunk that holds the word, learned
from there or not.  From then on no word moves: in each round a chunk sends a part one row, numbers and
lists of counts (each bounded by the number of classes), and gets back one row, the classes.

Smoothing: a transition is mixed with the class's share; a word's count in its class is discounted
by a constant (from the numbers of words seen once and twice), and what that frees belongs to
unseen words, which are one further word, as in the base score.  All probabilities that may follow
a word sum to one.

Cases: a null or empty text is one end; repeated rows count repeatedly; a row without id is scored
and not learned from; without any training text every probability is one.
"""

from __future__ import annotations

import dataclasses
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rulewatch.llm.common import NO_ID, as_bytes, bucketed, chunk_ids, pack, partitions, slices, unpack

CLASSES, SEEDS, SWEEPS = 32, 1024, 2
CHUNK_BYTES = 8 << 20
FAN = 1 << 17  # words of chunks that meet in one part
PART_BYTES = 16 << 20
END = "\n"  # never a word: it holds white space
MIX = 20.0  # weight of the class share in a transition
ENTRY = np.dtype([("code", "<u2"), ("n", "<u2")])  # code + digit * codes: a count is written to base 65536
DIGITS = 4


def fold(key, parts: int) -> int:
    return zlib.crc32(str(key).encode()) % parts


def coded(df: DataFrame, folds: int, held: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stored chunks: ids, which rows are learned from, tokens as places in ``words``, how often each
    of the ``types`` words occurs in rows learned from, their ``order`` by hash, and what the parts
    ``known`` of them, see ``numbered``.  A text's words are followed by END."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches):
        numbers = chunk_ids()

        def flush():
            sizes = np.array(lengths, np.int64)
            codes = np.concatenate(found)
            learn = np.array([i != NO_ID and fold(i, folds) != held for i in ids])
            own = np.repeat(learn, sizes)
            order = np.argsort(-np.bincount(codes, minlength=len(known)), kind="stable")  # small numbers pack well
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            words = list(known)
            counts = np.bincount(codes[own], minlength=len(known))[order]
            by_hash = np.argsort(hashes(words)[order], kind="stable").astype(np.uint32)
            names = pa.array([words[i] for i in order.tolist()], pa.binary()).cast(pa.string())
            whole = pa.array([0, len(words)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([next(numbers)], pa.int64()), *[pa.array([x], pa.binary()) for x in (np.array(ids, np.int64).tobytes(), learn.tobytes(), sizes.tobytes(), pack(place[codes]))],
                 pa.ListArray.from_arrays(whole, names), pa.ListArray.from_arrays(whole, pa.array(counts, pa.int64())),
                 pa.array([len(words)], pa.int32()), pa.array([sum(map(len, words))], pa.int64()), pa.array([pack(by_hash)], pa.binary())],
                ["chunk", "ids", "learn", "lengths", "codes", "words", "counts", "types", "size", "order"],
            )

        known: dict[bytes, int] = {}
        ids, lengths, found, size = [], [], [], 0
        for part in slices(batches, "text"):
            if not ids:
                known = defaultdict()
                known.default_factory = known.__len__
            ids += part.column("id").fill_null(NO_ID).to_pylist()
            for text in as_bytes(part.column("text")):
                words = text.lower().split()
                words.append(END.encode())
                found.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                lengths.append(len(words))
                size += len(text)
            if size >= CHUNK_BYTES:
                yield flush()
                ids, lengths, found, size = [], [], [], 0
        if ids:
            yield flush()

    schema = "chunk long, ids binary, learn binary, lengths binary, codes binary, words array<string>, counts array<long>, types int, size long, order binary"
    chunks = bucketed(rows.mapInArrow(run, schema), "chunk", "coded")
    return chunks.join(numbered(chunks), "chunk")


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def pieces(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values`` up to each of ``ends``."""
    return pa.array([values[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist())], pa.binary())


def joined(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of all arrays of a column of bytes, and where each array ends."""
    data = column.to_pylist()
    width = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(data), dtype), np.cumsum([len(x) // width for x in data])


def of_parts(batch: pa.RecordBatch, column: str, at: int, field: str) -> pa.Array:
    """The values that a chunk got from parts, by part: those of its words by hash."""
    rows = batch.column(column)[at].values
    return rows.field(field).take(pa.array(np.argsort(rows.field("part").to_numpy())))


def to_chunks(rows: DataFrame, name: str, column: str) -> DataFrame:
    """Rows of parts for chunks as one ``column``; bucketed as the chunks are, so that neither side of their joins moves."""
    fields = [c for c in rows.columns if c != "chunk"]
    return bucketed(rows.groupBy("chunk").agg(F.collect_list(F.struct(*fields)).alias(column)), "chunk", name)


def numbered(chunks: DataFrame) -> DataFrame:
    """``chunk, known``: from each part the ``numbers`` there of the chunk's words, how often each is
    learned from in all chunks (``n``), and which of them this chunk stands for (``own``)."""
    total = chunks.agg(F.sum("types").alias("types"), F.sum("size").alias("size")).first()
    parts = max(partitions(chunks), -(-(total["types"] or 0) // FAN), -(-(total["size"] or 0) // PART_BYTES))

    def send(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                order = pa.array(unpack(batch.column("order")[at].as_py(), np.uint32))
                words = batch.column("words")[at].values.take(order).cast(pa.binary()).to_pylist()
                counts = batch.column("counts")[at].values.take(order).to_numpy()
                part, first = np.unique(hashes(words) * np.uint64(parts) >> np.uint64(32), return_index=True)
                ends = np.append(first[1:], len(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.astype(np.int64)), pa.array(np.full(len(part), batch.column("chunk")[at].as_py()), pa.int64()),
                     pa.array([b"".join(words[a:b]) for a, b in zip(first.tolist(), ends.tolist())], pa.binary()),
                     pieces(np.fromiter(map(len, words), np.int32, len(words)), ends), pieces(counts, ends)],
                    ["part", "chunk", "words", "sizes", "counts"],
                )

    def number(table):
        table = table.sort_by("chunk")  # a repeated task numbers alike
        sizes, ends = joined(table.column("sizes"), np.int32)
        offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        data = b"".join(table.column("words").to_pylist())
        words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
        numbers = words.dictionary_encode().indices.to_numpy()
        n = np.zeros(int(numbers.max()) + 1, np.int64)
        np.add.at(n, numbers, joined(table.column("counts"), np.int64)[0])
        own = np.zeros(len(numbers), bool)
        own[np.unique(numbers, return_index=True)[1]] = True
        values = [pieces(x, ends) for x in (numbers.astype(np.int32), n[numbers], own)]
        return pa.table([table.column("chunk"), table.column("part"), *values], ["chunk", "part", "numbers", "n", "own"])

    sent = chunks.select("chunk", "words", "counts", "order").mapInArrow(send, "part long, chunk long, words binary, sizes binary, counts binary")
    return to_chunks(sent.groupBy("part").applyInArrow(number, "chunk long, part long, numbers binary, n binary, own binary"), "numbers", "known")


class Tokens:
    """The tokens of a chunk's rows, all or those learned from."""

    def __init__(self, batch: pa.RecordBatch, at: int, learn_only: bool):
        get = lambda c: batch.column(c)[at].as_py()
        self.lengths, self.learn = np.frombuffer(get("lengths"), np.int64), np.frombuffer(get("learn"), bool)
        self.codes = unpack(get("codes"), np.uint32).astype(np.int64)
        if learn_only:
            self.codes = self.codes[np.repeat(self.learn, self.lengths)]
            self.lengths = self.lengths[self.learn]
        self.ends = np.cumsum(self.lengths)

    def before(self, values: np.ndarray, at_start) -> np.ndarray:
        """The value of the token before each; at the start of a text that of END."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[(self.ends - self.lengths)] = at_start
        return out

    def after(self, values: np.ndarray, at_end) -> np.ndarray:
        out = np.empty_like(values)
        out[:-1] = values[1:]
        out[self.ends - 1] = at_end
        return out


def exchange(bigrams: np.ndarray, classes: int, rounds: int | None = None) -> np.ndarray:
    """Classes of words from their bigram counts: each word moves to where the likelihood is
    greatest, one after another, until a round moves none (or for ``rounds``)."""
    size = len(bigrams)
    classes = min(classes, size)
    label = np.arange(size) % classes
    member = np.zeros((size, classes))
    member[np.arange(size), label] = 1
    to_class, from_class = bigrams @ member, bigrams.T @ member  # counts word -> class, class -> word
    table = member.T @ to_class
    logs = lambda x: x * np.log(np.maximum(x, 1e-300))
    least = max(1e-9, 1e-12 * bigrams.sum())  # a gain beyond rounding, so that rounds end
    for _ in itertools.count() if rounds is None else range(rounds):
        moved = 0
        for w in range(size):
            old, own = label[w], bigrams[w, w]
            right, left = to_class[w].copy(), from_class[w].copy()
            right[old] -= own
            left[old] -= own
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= own
            # Adding w to class k changes row k by right, column k by left and their crossing by both.
            gain = (logs(table + right) - logs(table)).sum(axis=1) + (logs(table + left[:, None]) - logs(table)).sum(axis=0)
            corner = np.diag(table)
            gain += logs(corner + right + left + own) + logs(corner) - logs(corner + right) - logs(corner + left)
            # Every row grows by left and every column by right, whatever k is.
            rows, columns = table.sum(axis=1) + left, table.sum(axis=0) + right
            gain -= logs(rows + right.sum() + own) - logs(rows) + logs(columns + left.sum() + own) - logs(columns)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + least:
                new = old
            table[new] += right
            table[:, new] += left
            table[new, new] += own
            if new != old:
                moved += 1
                label[w] = new
                to_class[:, old] -= bigrams[:, w]
                to_class[:, new] += bigrams[:, w]
                from_class[:, old] -= bigrams[w]
                from_class[:, new] += bigrams[w]
        if not moved:
            break
    return label


def chunk_words(chunks: DataFrame) -> DataFrame:
    """The words of each chunk, with what the parts know of them."""
    return chunks.select("chunk", "words", "order", "known")


def owned(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a chunk's words by hash it stands for, and how often each of these is learned from; all were."""
    own, _ = joined(of_parts(batch, "known", at, "own"), bool)
    n, _ = joined(of_parts(batch, "known", at, "n"), np.int64)
    mine = np.flatnonzero(own & (n > 0))
    return mine, n[mine]


def seed_classes(chunks: DataFrame, *given) -> tuple[dict[str, int], np.ndarray]:
    """Classes of the most frequent words, and the class bigram counts between them; END is the last
    class.  Counts of words and of pairs cover the corpus.  ``given``: the words as ``chunk_words``
    lists them (may be left out), the number of seeds, and that of classes."""
    *listed, seeds, classes = given
    listed = listed[0] if listed else chunk_words(chunks)

    def frequent(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                mine, n = owned(batch, at)
                if len(n) > seeds + 1:  # END may be among them
                    keep = n >= np.partition(n, -seeds - 1)[-seeds - 1]
                    mine, n = mine[keep], n[keep]
                place = unpack(batch.column("order")[at].as_py(), np.uint32)[mine]
                words = batch.column("words")[at].values.take(pa.array(place)).to_pylist()
                best = sorted((-k, w.encode()) for k, w in zip(n.tolist(), words) if w != END)[:seeds]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for _, w in best], pa.string()), pa.array([-k for k, _ in best], pa.int64())], ["word", "n"])

    counts = listed.select("words", "order", "known").mapInArrow(frequent, "word string, n long")
    top = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(seeds).collect()]
    place = {w: i for i, w in enumerate(top)} | {END: len(top)}
    size = len(place)

    def pairs(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                tokens = Tokens(batch, at, True)
                local = np.array([place.get(w, -1) for w in batch.column("words")[at].as_py()], np.int64)
                here = local[tokens.codes]
                before = tokens.before(here, size - 1)
                both = (here >= 0) & (before >= 0)
                pair, n = np.unique(before[both] * size + here[both], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    found = chunks.select("lengths", "learn", "codes", "words").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    bigrams = np.zeros(size * size)
    bigrams[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    bigrams = bigrams.reshape(size, size)
    label = np.append(exchange(bigrams[:-1, :-1], classes), classes)
    member = np.zeros((size, classes + 1))
    member[np.arange(size), label] = 1
    return {w: int(label[i]) for w, i in place.items()}, member.T @ bigrams @ member


def first_classes(chunks: DataFrame, seeds: dict[str, int], table: np.ndarray) -> DataFrame:
    """``chunk, found``: classes of all words learned from, placed by their occurrences next to ``seeds``."""
    classes = len(table) - 1

    def near_seeds(batch, at):
        words = batch.column("words")[at].as_py()
        local = np.array([seeds.get(w, -1) for w in words], np.int16)
        by_hash = (hashes([w.encode() for w in words]) % np.uint64(classes)).astype(np.int16)
        return local, local < 0, np.where(local >= 0, local, -2 - by_hash)

    return placed(chunks.select("chunk", "lengths", "learn", "codes", "words", "types", "order", "known"), near_seeds, table)


def moved_classes(chunks: DataFrame, found: DataFrame, table: np.ndarray) -> DataFrame:
    """``chunk, found``: each word placed anew by all its occurrences, next to words as ``found``."""
    classes = len(table) - 1

    def by_class(batch, at):
        local = local_classes(batch, at)
        return local, local != classes, np.where(local == classes, local, -2 - local)

    rows = chunks.select("chunk", "lengths", "learn", "codes", "types", "order", "known")
    return placed(rows.join(found, "chunk"), by_class, table)


def vocabulary(chunks: DataFrame, seeds: dict[str, int], table: np.ndarray) -> DataFrame:
    """``word, n, class, part, number`` of every word learned from, placed by its occurrences next to ``seeds``."""
    return word_rows(chunks, first_classes(chunks, seeds, table))


def swept(chunks: DataFrame, found: DataFrame, table: np.ndarray) -> DataFrame:
    """``word, n, class, part, number``: each word placed anew by all its occurrences, next to words as ``found``."""
    return word_rows(chunks, moved_classes(chunks, found, table))


def word_rows(chunks: DataFrame, found: DataFrame, named: bool = True) -> DataFrame:
    """``word, n, class, part, number`` of every word learned from; ``n, class`` alone if not ``named``."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                mine, n = owned(batch, at)
                of, ends = joined(of_parts(batch, "found", at, "class"), np.int16)
                columns = [pa.array(n), pa.array(of[mine], pa.int32())]
                if named:
                    place = unpack(batch.column("order")[at].as_py(), np.uint32)[mine]
                    part = of_parts(batch, "found", at, "part").to_numpy()[np.searchsorted(ends, mine, side="right")]
                    number, _ = joined(of_parts(batch, "known", at, "numbers"), np.int32)
                    columns = [batch.column("words")[at].values.take(pa.array(place)), *columns, pa.array(part), pa.array(number[mine])]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n", "class", "part", "number"] if named else ["n", "class"])

    rows = chunks.select("chunk", "known", *["words", "order"] * named).join(found, "chunk")
    return rows.mapInArrow(run, "word string, n long, class int, part long, number int" if named else "n long, class int")


def written(key: np.ndarray, n: np.ndarray, width: int, size: int) -> pa.Array:
    """Counts of ``size`` words as a binary value each, from sorted keys word * ``width`` + code."""
    word, code = np.divmod(key, width)
    found = []
    for digit in range(DIGITS):
        if digit and not (n >> (16 * digit)).any():
            break
        value = n >> (16 * digit) & 0xFFFF
        at = np.flatnonzero(value)
        found.append((word[at], code[at] + digit * width, value[at]))
    word, code, value = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(word, kind="stable")
    entries = np.empty(len(order), ENTRY)
    entries["code"], entries["n"] = code[order], value[order]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=size)))).astype(np.int32) * ENTRY.itemsize
    return pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entries.tobytes())])


def totals(batch: pa.RecordBatch, width: int, step: int = 4096):
    """(first, last + 1, a row of counts for each) of the batch's words, from their lists of counts."""
    for a in range(0, batch.num_rows, step):
        lists = batch.column("entries").slice(a, step)
        flat = lists.flatten()
        _, offsets, bytes_of = flat.buffers()
        ends = np.frombuffer(offsets, np.int32)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else [0, 0]
        data = np.frombuffer(bytes_of or b"", np.uint8)[ends[0] : ends[-1]].view(ENTRY)
        sizes = pa.compute.binary_length(flat).to_numpy(zero_copy_only=False) // ENTRY.itemsize
        each = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.repeat(np.arange(len(lists)), each), sizes)
        digit, code = np.divmod(data["code"].astype(np.int64), width)
        seen = np.bincount(owner * width + code, data["n"] * 65536.0**digit, len(lists) * width)
        yield a, a + len(lists), seen.reshape(len(lists), width)


def placed(chunks: DataFrame, classes_of, table: np.ndarray) -> DataFrame:
    """``chunk, found``: from each part the classes of the chunk's words by hash (-1: not learned from).

    ``classes_of`` gives the classes of a chunk's words (-1: none), which are placed, and for each word
    the class that it has whatever its neighbours, or -2 less the class that it has without any."""
    classes = len(table) - 1
    width = 2 * classes + 2

    def contexts(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                tokens = Tokens(batch, at, True)
                local, open_words, given = classes_of(batch, at)
                types = len(local)
                here = local[tokens.codes]
                other = open_words[tokens.codes]
                small = np.int32 if types * width < 1 << 31 else np.int64
                key = []
                for codes in (tokens.before(here, classes), np.where((after := tokens.after(here, -1)) >= 0, after + np.int16(classes + 1), np.int16(-1))):
                    use = other & (codes >= 0)
                    key.append((tokens.codes[use] * width + codes[use]).astype(small))
                key, n = np.unique(np.concatenate(key), return_counts=True)
                given = np.where(np.bincount(tokens.codes, minlength=types) > 0, given, -1).astype(np.int16)
                order = unpack(batch.column("order")[at].as_py(), np.uint32)
                lists = written(key.astype(np.int64), n, width, types).take(pa.array(order))
                numbers, part = of_parts(batch, "known", at, "numbers"), of_parts(batch, "known", at, "part")
                _, ends = joined(numbers, np.int32)
                _, offsets, data = lists.buffers()
                offsets, data = np.frombuffer(offsets, np.int32), np.frombuffer(data or b"", np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(np.full(len(part), batch.column("chunk")[at].as_py()), pa.int64()), numbers,
                     pieces(np.diff(offsets), ends), pieces(data, offsets[ends]), pieces(given[order], ends)],
                    ["part", "chunk", "numbers", "sizes", "entries", "given"],
                )

    smooth = table + 0.5
    rows, columns = smooth.sum(axis=1), smooth.sum(axis=0)
    # log P(class | class before) + log P(class after | class) - log N(class), for each class
    weights = np.vstack((np.log(smooth[:, :-1] / rows[:, None]) - np.log(columns[:-1]), np.log(smooth[:-1] / rows[:-1, None]).T))

    def assign(table):
        numbers, ends = joined(table.column("numbers"), np.int32)
        offsets = np.concatenate(([0], np.cumsum(joined(table.column("sizes"), np.int32)[0]))).astype(np.int32)
        data = b"".join(table.column("entries").to_pylist())
        lists = pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
        each = np.concatenate(([0], np.cumsum(np.bincount(numbers))))
        lists = pa.ListArray.from_arrays(pa.array(each, pa.int32()), lists.take(pa.array(np.argsort(numbers, kind="stable"))))
        of_rows, _ = joined(table.column("given"), np.int16)
        given = np.full(len(lists), -1, np.int16)
        given[numbers[of_rows != -1]] = of_rows[of_rows != -1]  # all chunks that learn a word say the same
        best = np.empty(len(lists), np.int16)
        for a, b, seen in totals(pa.RecordBatch.from_arrays([lists], ["entries"]), width):
            best[a:b] = np.where(seen.any(axis=1), np.argmax(seen @ weights, axis=1), -2 - given[a:b])
        best = np.where(given >= -1, given, best)
        return pa.table([table.column("chunk"), table.column("part"), pieces(best[numbers], ends)], ["chunk", "part", "class"])

    sent = chunks.mapInArrow(contexts, "part long, chunk long, numbers binary, sizes binary, entries binary, given binary")
    return to_chunks(sent.groupBy("part").applyInArrow(assign, "chunk long, part long, class binary"), "classes", "found")


def looked_up(listed: DataFrame, words: DataFrame) -> DataFrame:
    """``chunk, found``: classes of the chunk's words, from rows as ``word_rows`` gives them."""

    def of_chunks(lists, rows):
        if not lists.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "class": pa.array([], pa.binary())})
        numbers, ends = joined(lists.column("numbers"), np.int32)
        of = np.full(int(numbers.max()) + 1, -1, np.int16)
        of[rows.column("number").to_numpy()] = rows.column("class").to_numpy()
        return pa.table([lists.column("chunk"), lists.column("part"), pieces(of[numbers], ends)], ["chunk", "part", "class"])

    lists = listed.select("chunk", F.explode("known").alias("x")).select("chunk", "x.part", "x.numbers")
    both = lists.groupBy("part").cogroup(words.select("part", "number", "class").groupBy("part"))
    return to_chunks(both.applyInArrow(of_chunks, "chunk long, part long, class binary"), "classes", "found")


@dataclasses.dataclass(frozen=True)
class Model:
    tokens: int  # learned from
    types: int
    transitions: np.ndarray  # log10 P(class | class before); END is the last class
    emission: np.ndarray  # log10 of a class's count, subtracted from that of a word
    discount: float
    unseen: np.ndarray  # log10 P(unseen word | class before)
    unseen_class: int  # what stands before the word after an unseen one


def class_bigrams(chunks: DataFrame, found: DataFrame, classes: int) -> np.ndarray:
    """Counts of neighbouring classes in rows learned from."""

    def transitions(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                tokens = Tokens(batch, at, True)
                here = local_classes(batch, at)[tokens.codes]
                n = np.bincount(tokens.before(here, classes).astype(np.int64) * (classes + 1) + here)
                pair = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n[pair], pa.int64())], ["pair", "n"])

    rows = chunks.select("chunk", "lengths", "learn", "codes", "order").join(found, "chunk")
    pairs = rows.mapInArrow(transitions, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((classes + 1) ** 2)
    for r in pairs:
        table[r["pair"]] = r["n"]
    return table.reshape(classes + 1, classes + 1)


def information(table: np.ndarray) -> float:
    """The part of the learned texts' log probability that depends on the classes."""
    logs = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return logs(table) - logs(table.sum(axis=0)) - logs(table.sum(axis=1))


def fit(chunks: DataFrame, found: DataFrame, words: DataFrame, classes: int, table: np.ndarray | None = None) -> Model:
    table = class_bigrams(chunks, found, classes) if table is None else table
    of_class = words.groupBy("class").agg(
        F.sum("n").alias("n"), F.count("*").alias("types"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")
    ).collect()
    stats = np.zeros((classes + 1, 4))
    for r in of_class:
        stats[r["class"]] = r["n"], r["types"], r["once"], r["twice"]
    total, types, once, twice = stats.sum(axis=0)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    share = (stats[:, 0] + 1e-9) / (total + 1e-9 * len(stats))
    moves = (table + MIX * share) / (table.sum(axis=1, keepdims=True) + MIX)
    free = np.where(stats[:, 0] > 0, discount * stats[:, 1] / np.maximum(1, stats[:, 0]), 1.0)
    free[classes] = 0.0 if stats[classes, 0] else 1.0  # the end is one word, always the same
    logs = lambda x: np.log10(np.maximum(x, 1e-300))
    return Model(int(total), int(types), logs(moves), logs(stats[:, 0]), discount, logs(moves @ free), int(np.argmax(share[:-1] * free[:-1])))


def by_place(batch: pa.RecordBatch, at: int, column: str, field: str, dtype) -> np.ndarray:
    """What a chunk got from parts, by the places of its words."""
    order = unpack(batch.column("order")[at].as_py(), np.uint32)
    out = np.empty(len(order), dtype)
    out[order], _ = joined(of_parts(batch, column, at, field), dtype)
    return out


def local_classes(batch: pa.RecordBatch, at: int) -> np.ndarray:
    """Classes of a chunk's words (-1: not learned from)."""
    return by_place(batch, at, "found", "class", np.int16)


def score(chunks: DataFrame, found: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    classes = len(model.transitions) - 1

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                tokens = Tokens(batch, at, False)
                counts, of_word = by_place(batch, at, "known", "n", np.int64), local_classes(batch, at)
                n, here = counts[tokens.codes], of_word[tokens.codes]
                starts = tokens.ends - tokens.lengths
                if model.tokens:
                    before = tokens.before(np.where(here >= 0, here, model.unseen_class), classes)
                    word = np.where(here == classes, 0.0, np.log10(np.maximum(1e-300, n - model.discount)) - model.emission[here])
                    each = np.where(here >= 0, model.transitions[before, here] + word, model.unseen[before])
                else:
                    each = np.zeros(len(n))
                base = np.log10((n + 1) / (model.tokens + model.types + 1))
                sums = [np.add.reduceat(x, starts) for x in (base, each, (n > 0).astype(np.int64))]
                ids = np.frombuffer(batch.column("ids")[at].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == NO_ID), pa.array(tokens.lengths), pa.array(sums[2]), pa.array(np.full(len(ids), model.tokens)), pa.array(sums[0]), pa.array(sums[1])],
                    ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = chunks.select("chunk", "ids", "lengths", "learn", "codes", "order", "known").join(found, "chunk")
    out = rows.mapInArrow(run, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", key)


def document_scores(documents: DataFrame, folds: int = 7, held: int = 2, classes: int = CLASSES, seeds: int = SEEDS, sweeps: int = SWEEPS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``."""
    chunks = coded(documents, folds, held)
    listed = chunk_words(chunks)
    found = first_classes(chunks, *seed_classes(chunks, listed, seeds, classes))
    table = class_bigrams(chunks, found, classes)
    for _ in range(sweeps):
        moved = moved_classes(chunks, found, table)
        moved_table = class_bigrams(chunks, moved, classes)
        if information(moved_table) <= information(table):
            break
        found, table = moved, moved_table
    scored = score(chunks, found, fit(chunks, found, word_rows(chunks, found, named=False), classes, table))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    return scored.withColumn("held_out", held_out).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
