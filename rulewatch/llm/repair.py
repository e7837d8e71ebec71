"""Repair of conversation structure by the cheapest edits.

Method: rank-convergence parallel Viterbi.  The rows of a conversation, in turn order, are cut into
*pieces* of bounded rows and bytes.  Backward costs (the cheapest way to finish from each of four
states) of all pieces are found at once, each from a speculative vector at its end.  Fix-up passes
then rerun just the pieces whose true end vector, the start vector of the piece after it, differs
from the one they used by more than a constant; constants are summed apart.  When none is left, the
stitched costs steer the tracing: at every row the first letter, in ASCII order, that keeps the
cheapest cost.  Entry states of pieces converge by passes of the same kind over four exits a piece.
How many passes there are depends on how soon costs forget where they came from, on most input one
or two; nothing depends on the length of a conversation otherwise.

States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row; 0 and 3
may end.  In each state one of user and assistant is possible, so letters alone fix the repair.

Order within a conversation: turn (nulls first), then role, the first 40 characters of the text, a
hash of the whole text.  Rows are dealt by ranges of that order and a row number, so one conversation
or one null turn that holds a third of all rows is split.  Copies within a piece are known there;
what a piece shares with earlier ones of its conversation is found by hashes (128 bits), one row for
each text and piece.  Conversations within one piece, nearly all, end there.  The digest of a longer
one runs over its text in order, which SHA-256 allows in no other way: its pieces then stream through one
task, in bounded memory; so does its audit, one value by its contract.

Cases: a null role or text is one space; a null conversation is one of its own; rows without any
fault and in order are kept at cost 0; conversations without rows have zeros, an empty audit and the
digest of an empty text; an empty table has no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rulewatch.llm.common import Kept, chunk_ids, partitions, slices, stored

PIECE_ROWS, PIECE_BYTES = 1 << 14, 4 << 20
BATCH = 256  # pieces taken at once, if they are small
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
FAR = 1 << 60
ENDS = (0, 4, 2, 0)  # what ends cost from each state: rows inserted until one may end
ROLE_OF = {2: "user", 3: "assistant"}  # by the state that such a row leads to
INSERTED = (2, 2, 3, 2)  # the state after the one row that may be inserted or reroled to
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}  # the state after a row kept
LEGAL = ("su", "ua", "au")

GONE, CUT = 8, 4  # bits of a row's code beside its role's initial


def code(initial: str, gone: bool, cut: bool) -> int:
    return "sua".find(initial or "?") + 1 | (CUT if cut else 0) | (GONE if gone else 0)


def choices(row: int, state: int):
    """(letter, cost, next state) of the edits that take a row, in ASCII order of letters."""
    yield "D", DELETE, state
    if not row & GONE:
        more = TRUNCATED if row & CUT else 0
        after = KEPT.get("?sua"[row & 3], {}).get(state)
        if after is not None:
            yield "K", more, after
        yield "R", REROLE + more, INSERTED[state]


EDITS = {(row, state): tuple(choices(row, state)) for row in range(16) for state in range(4)}


_STEPS = Kept()  # vectors without their constants are few


def step_back(row: int, after: tuple) -> tuple:
    """Cheapest costs before a row from those after it, rows inserted before it included."""
    if (row, after) in _STEPS:
        return _STEPS[row, after]
    costs = [min(cost + after[to] for _, cost, to in EDITS[row, state]) for state in range(4)]
    for _ in range(2):  # two rows inserted lead to every state that any number leads to
        costs = [min(costs[s], INSERT + costs[INSERTED[s]]) for s in range(4)]
    if len(_STEPS) < 1 << 16:
        _STEPS[row, after] = tuple(costs)
    return tuple(costs)


def level(costs: tuple) -> tuple[tuple, int]:
    """A vector without its constant, and the constant."""
    least = min(costs)
    return tuple(c - least for c in costs), least


def backward(codes: bytes, end: tuple) -> tuple[list[tuple], int]:
    """Vectors before each row and after the last, each without its constant; all constants summed."""
    vectors, total = [end], 0
    for row in reversed(codes):
        vector, least = level(step_back(row, vectors[-1]))
        vectors.append(vector)
        total += least
    return vectors[::-1], total


def trace(codes: bytes, vectors: list[tuple], state: int, last: bool = True) -> tuple[str, int]:
    """The least audit among the cheapest from a state, and the state it ends in.

    Rows inserted after the last row belong to the ``last`` piece, those at a border to the piece after it.
    """
    letters = []
    for at, row in enumerate(codes):
        after = vectors[at + 1]
        want = step_back(row, after)
        while True:
            for letter, cost, to in (EDITS[row, state][0], ("I", INSERT, INSERTED[state]), *EDITS[row, state][1:]):
                if cost + (want[to] if letter == "I" else after[to]) == want[state]:
                    break
            letters.append(letter)
            state = to
            if letter != "I":
                break
    while last and ENDS[state]:
        letters.append("I")
        state = INSERTED[state]
    return "".join(letters), state


def repaired(rows: list[tuple[str, str]], audit: str, state: int):
    """``role:text`` of the rows after the edits."""
    at = 0
    for letter in audit:
        if letter == "I":
            state = INSERTED[state]
            yield f"{ROLE_OF[state]}:"
            continue
        role, text = rows[at]
        at += 1
        if letter == "K":
            state = KEPT[role[0]][state]
            yield f"{role}:{text}"
        elif letter == "R":
            state = INSERTED[state]
            yield f"{ROLE_OF[state]}:{text}"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` after the damage that crc32(``conv_id:turn``) names; nulls are one space."""
    space = F.lit(" ")
    as_text = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *as_text).cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = conversations.where(kind != 0).select(
        F.col("conv_id").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return rows.select("conv", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")


_FAULTS = ("blank", "duplicate", "truncated")
_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_SPACE = " \t\n\v\f\r"


def pieces(rows: DataFrame, most_rows: int = PIECE_ROWS, most_bytes: int = PIECE_BYTES) -> DataFrame:
    """Stored ``conv, piece, after, rows, edge``: numbers rise in order; ``after`` is the next piece's
    number, if it is of the same conversation and task; ``edge`` marks first and last pieces of a task."""
    number = F.monotonically_increasing_id()
    order = ["conv", "turn", "role", F.substring("text", 1, 40), F.xxhash64("text")]
    ranged = rows.withColumn("at", number).repartitionByRange(partitions(rows), *order, "at")
    ranged = ranged.sortWithinPartitions(*order, "at").drop("at")
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches):
        numbers = chunk_ids()
        done, held, size, bytes_ = [], [], 0, 0  # pieces to write, of which the last waits for the one after it

        def written(items, last):
            nonlocal done
            done = done[len(items) :]
            first = items[0][1] & 0xFFFFFF == 0
            edges = [first, *[False] * (len(items) - 1)]
            edges[-1] |= last
            columns = [*zip(*items), edges]
            kinds = (conv_kind, pa.int64(), pa.int64(), pa.list_(_ROW), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", "piece", "after", "rows", "edge"])

        def cut():
            nonlocal held, size
            piece = next(numbers)
            if done and done[-1][0] == conv:
                done[-1] = (*done[-1][:2], piece, done[-1][3])
            done.append((conv, piece, None, held))
            held, size = [], 0

        conv = None
        for batch in batches:
            conv_kind = batch.schema.field("conv").type
            for part in slices([batch], "text"):
                for key, turn, role, text in zip(*[part.column(c).to_pylist() for c in ("conv", "turn", "role", "text")]):
                    if held and (key != conv or len(held) >= most_rows or size >= most_bytes):
                        bytes_ += size
                        cut()
                        if bytes_ >= most_bytes or len(done) > BATCH:
                            if len(done) > 1:
                                yield written(done[:-1], False)
                            bytes_ = 0
                    conv = key
                    held.append({"turn": turn, "role": role, "text": text})
                    size += 4 * len(text)  # bytes at most
        if held:
            cut()
            yield written(done, True)

    found = ranged.mapInArrow(run, f"conv {kind}, piece long, after long, rows array<struct<turn:long,role:string,text:string>>, edge boolean")
    return stored(found, "repair")


def borders(found: DataFrame) -> dict[int, int]:
    """Pieces that go on in the next task: at most one a task, as two rows of each are read."""
    rows = found.where("edge").select("conv", "piece").collect()
    ends: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        ends.setdefault(r["piece"] >> 24, []).append(r)
    tasks = [ends[k] for k in sorted(ends)]
    return {a[-1]["piece"]: b[0]["piece"] for a, b in zip(tasks, tasks[1:]) if a[-1]["conv"] == b[0]["conv"]}


def _digest(role: str, text: str) -> bytes:
    return xxhash.xxh3_128_digest(f"{len(role)}:{role}:{text}".encode())


def faults(rows: list[dict], seen: set[bytes] = frozenset()) -> list[str | None]:
    """The first fault of each row; ``seen`` are rows of the conversation before these."""
    seen, out = set(seen), []
    for r in rows:
        left = r["text"].rstrip(_SPACE)
        mark = _digest(r["role"], r["text"])
        out.append("blank" if not left else "duplicate" if mark in seen else "truncated" if left[-1] not in ".!?" else None)
        seen.add(mark)
    return out


def coded(rows: list[dict], fault: list[str | None]) -> bytes:
    return bytes(code(r["role"][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, fault))


def facts(rows: list[dict], fault: list[str | None]) -> dict:
    """What a piece adds to its conversation's counts, and what its neighbours need to know of it."""
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [r["role"][:1] for r in rows]
    return {
        **{name: fault.count(name) for name in _FAULTS},
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "least": min(turns, default=None), "most": max(turns, default=None), "turns": len(set(turns)),
        "head": initials[0], "tail": initials[-1],
    }


FACTS = "blank long, duplicate long, truncated long, illegal long, least long, most long, turns long, head string, tail string"
_FACT_TYPES = [(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in FACTS.split(", ")]


def _mapped(df: DataFrame, one, schema: str, fields: list[tuple]) -> DataFrame:
    """Each row of ``df``, as a dict, turned into one of ``fields``; ``conv`` is taken along."""
    kind = df.schema["conv"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            size = max(1, min(BATCH, PIECE_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                names = [name for name in part.schema.names if name != "conv"]
                found = [one(dict(zip(names, row))) for row in zip(*[part.column(name).to_pylist() for name in names])]
                arrays = [pa.array([x[name] for x in found], t) for name, t in fields]
                yield pa.RecordBatch.from_arrays([part.column("conv"), *arrays], ["conv", *[n for n, _ in fields]])

    return df.mapInArrow(run, f"conv {kind}, {schema}")


def _whole(found: DataFrame) -> DataFrame:
    """Conversations of one piece, done where they lie."""

    def one(row):
        rows = row["rows"]
        fault = faults(rows)
        codes = coded(rows, fault)
        vectors, cost = backward(codes, ENDS)
        audit, _ = trace(codes, vectors, 0)
        text = "\n".join(repaired([(r["role"], r["text"]) for r in rows], audit, 0))
        return facts(rows, fault) | {"cost": cost + vectors[0][0], "audit": audit, "sha": hashlib.sha256(text.encode()).hexdigest()}

    return _mapped(found, one, f"{FACTS}, cost long, audit string, sha string", [*_FACT_TYPES, ("cost", pa.int64()), ("audit", pa.string()), ("sha", pa.string())])


def _seen_before(long: DataFrame) -> DataFrame:
    """``piece, seen``: hashes of a piece's rows that an earlier piece of its conversation has."""

    def one(row):
        return {"piece": row["piece"], "marks": list({_digest(r["role"], r["text"]) for r in row["rows"]})}

    marks = _mapped(long, one, "piece long, marks array<binary>", [("piece", pa.int64()), ("marks", pa.list_(pa.binary()))])
    marks = stored(marks.select("conv", "piece", F.explode("marks").alias("mark")), "repair")
    firsts = marks.groupBy("conv", "mark").agg(F.min("piece").alias("first"), F.max("piece").alias("final")).where("first < final")
    firsts = stored(firsts, "repair").alias("f")
    meet = F.col("m.conv").eqNullSafe(F.col("f.conv")) & (F.col("m.mark") == F.col("f.mark"))
    again = marks.alias("m").join(firsts, meet).where("m.piece > f.first")
    # A piece has a bounded number of rows, and so of marks.
    return again.groupBy("m.piece").agg(F.collect_list("m.mark").alias("seen"))


_COSTS = "piece long, after long, codes binary, end array<long>, start array<long>, cost long"
_COST_TYPES = [("piece", pa.int64()), ("after", pa.int64()), ("codes", pa.binary()), ("end", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())), ("cost", pa.int64())]


def _run_back(row: dict, end: tuple) -> dict:
    vectors, cost = backward(row["codes"], end)
    return row | {"end": list(end), "start": list(vectors[0]), "cost": cost}


def stitched_costs(coded_pieces: DataFrame) -> DataFrame:
    """Stored pieces with end vectors that fit the start vectors of the pieces after them."""
    costs = stored(_mapped(coded_pieces, lambda row: _run_back(row, ENDS), _COSTS, _COST_TYPES), "repair")
    while True:
        after = costs.select(F.col("piece").alias("after"), F.col("start").alias("true_end"))
        joined = costs.join(after, "after", "left")
        wrong = F.col("true_end").isNotNull() & (F.col("true_end") != F.col("end"))
        if joined.where(wrong).limit(1).isEmpty():
            return costs

        def again(row):
            end = row.pop("true_end")
            return row if end is None or end == row["end"] else _run_back(row, tuple(end))

        costs = stored(_mapped(joined, again, _COSTS, _COST_TYPES), "repair")


def entry_states(costs: DataFrame) -> DataFrame:
    """Stored ``piece, entry``: the state in which the cheapest, least audit enters each piece."""

    def exits(row):
        vectors, _ = backward(row["codes"], tuple(row["end"]))
        ends = [trace(row["codes"], vectors, s, last=False)[1] for s in range(4)]
        return {"piece": row["piece"], "after": row["after"], "exits": ends}

    found = _mapped(costs, exits, "piece long, after long, exits array<int>", [("piece", pa.int64()), ("after", pa.int64()), ("exits", pa.list_(pa.int32()))])
    found = stored(found.drop("conv"), "repair")
    heads = found.select("piece").join(found.select(F.col("after").alias("piece")), "piece", "left_anti").withColumn("head", F.lit(True))
    # The first piece of a conversation starts with nothing; the others as if after an assistant.
    states = found.join(heads, "piece", "left").withColumn("entry", F.when(F.col("head"), 0).otherwise(3)).drop("head")
    states = stored(states, "repair")
    while True:
        left = F.col("exits")[F.col("entry")]
        before = states.where("after is not null").select(F.col("after").alias("piece"), left.alias("true_entry"))
        joined = states.join(before, "piece", "left")
        if joined.where("true_entry != entry").limit(1).isEmpty():
            return states.select("piece", "entry")
        states = stored(joined.withColumn("entry", F.coalesce("true_entry", "entry")).drop("true_entry"), "repair")


def _joined(costs: DataFrame, marked: DataFrame, entries: DataFrame) -> DataFrame:
    """``conv, audit, sha``: the repaired pieces of each conversation, streamed in order."""

    def one(row):
        rows = [(r["role"], r["text"]) for r in row["rows"]]
        vectors, _ = backward(row["codes"], tuple(row["end"]))
        audit, _ = trace(row["codes"], vectors, row["entry"], last=row["after"] is None)
        texts = list(repaired(rows, audit, row["entry"]))
        return {"piece": row["piece"], "audit": audit, "text": "\n".join(texts), "some": bool(texts)}

    fields = [("piece", pa.int64()), ("audit", pa.string()), ("text", pa.string()), ("some", pa.bool_())]
    rows = marked.select("conv", "piece", "rows").join(costs.drop("conv"), "piece").join(entries, "piece")
    parts = _mapped(rows, one, "piece long, audit string, text string, some boolean", fields)
    parts = parts.repartition(partitions(parts), "conv").sortWithinPartitions("conv", "piece")
    kind = parts.schema["conv"].dataType.simpleString()

    def run(batches):
        conv, started, sha, audits, empty = None, False, None, [], True

        def done():
            return pa.RecordBatch.from_arrays([pa.array([conv], conv_kind), pa.array(["".join(audits)]), pa.array([sha.hexdigest()])], ["conv", "audit", "sha"])

        for batch in batches:
            conv_kind = batch.schema.field("conv").type
            for at in range(batch.num_rows):
                key, audit, text, some = (batch.column(c)[at].as_py() for c in ("conv", "audit", "text", "some"))
                if not started or key != conv:
                    if started:
                        yield done()
                    conv, started, sha, audits, empty = key, True, hashlib.sha256(), [], True
                audits.append(audit)
                if some:
                    sha.update(text.encode() if empty else b"\n" + text.encode())
                    empty = False
        if started:
            yield done()

    return parts.mapInArrow(run, f"conv {kind}, audit string, sha string")


def chains(found: DataFrame) -> DataFrame:
    """``piece, after, before`` of the pieces of conversations that have several."""
    onward = borders(found)  # one row at most for each task of the ordering
    links = found.sparkSession.createDataFrame(list(onward.items()) or [(-1, -1)], "piece long, next long")
    linked = found.select("piece", "after").join(F.broadcast(links), "piece", "left")
    linked = linked.select("piece", F.coalesce("after", "next").alias("after"))
    followed = linked.where("after is not null").select(F.col("after").alias("piece"), F.col("piece").alias("before"))
    return stored(linked.join(followed, "piece", "left").where("after is not null or before is not null"), "repair")


def _long(found: DataFrame, chain: DataFrame) -> DataFrame:
    """Conversations of several pieces."""
    long = stored(found.drop("after", "edge").join(chain, "piece"), "repair")
    marked = stored(long.join(_seen_before(long), "piece", "left"), "repair")

    def one(row):
        fault = faults(row["rows"], set(map(bytes, row["seen"] or ())))
        return facts(row["rows"], fault) | {"piece": row["piece"], "after": row["after"], "codes": coded(row["rows"], fault)}

    fields = [("piece", pa.int64()), ("after", pa.int64()), ("codes", pa.binary()), *_FACT_TYPES]
    known = stored(_mapped(marked, one, f"piece long, after long, codes binary, {FACTS}", fields), "repair")
    costs = stitched_costs(known.select("conv", "piece", "after", "codes"))
    texts = stored(_joined(costs, marked, entry_states(costs)), "repair")
    # Pieces add up; at a border, a turn may be counted twice and a pair of roles not at all.
    after = known.select(F.col("piece").alias("after"), F.col("head").alias("next_head"), F.col("least").alias("next_least"))
    starts = costs.select("piece", F.col("cost"), F.col("start")[0].alias("from_nothing"))
    added = known.join(after, "after", "left").join(starts, "piece")
    first = F.min_by("from_nothing", "piece")
    pair = F.col("next_head").isNotNull() & ~F.concat("tail", "next_head").isin(*LEGAL)
    sums = added.groupBy("conv").agg(
        *[F.sum(name).alias(name) for name in _FAULTS],
        (F.sum("illegal") + F.count_if(pair)).alias("illegal"),
        F.min("least").alias("least"), F.max("most").alias("most"),
        (F.sum("turns") - F.count_if(F.col("most") == F.col("next_least"))).alias("turns"),
        (F.sum("cost") + first).alias("cost"),
    )
    return sums.alias("s").join(texts.alias("t"), F.col("s.conv").eqNullSafe(F.col("t.conv"))).select("s.*", "t.audit", "t.sha")


def repair(conversations: DataFrame, most_rows: int = PIECE_ROWS, most_bytes: int = PIECE_BYTES) -> DataFrame:
    """Structure faults, cheapest cost, audit and repaired digest of each conversation of ``conv, turn, role, text``."""
    found = pieces(conversations, most_rows, most_bytes)
    chain = chains(found)
    whole = _whole(found.select("conv", "piece", "rows").join(chain, "piece", "left_anti"))
    columns = [*_FAULTS, "illegal", "least", "most", "turns", "cost", "audit", "sha"]
    every = whole.select("conv", *columns).unionByName(_long(found, chain).select("conv", *columns))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    return every.select("conv", gaps.alias("gaps"), *_FAULTS, "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))


def repaired_conversations(conversations: DataFrame, most_rows: int = PIECE_ROWS, most_bytes: int = PIECE_BYTES) -> DataFrame:
    """Every original conversation, damaged and repaired."""
    found = repair(damaged(conversations), most_rows, most_bytes)
    ids = conversations.select(F.col("conv_id")).distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    empty = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", *_FAULTS, "illegal", "cost")}
    empty |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))}
    return joined.withColumns(empty)
