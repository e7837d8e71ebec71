"""Byte-level BPE, encoded and decoded in batches.

Method: batched merge rounds.  The symbols of many distinct words lie in one flat array; each
round finds the rank of every neighbouring pair by binary search over the sorted pair keys,
takes the lowest rank of each word and merges all its places at once, left to right.  That is
the order of a one-at-a-time merge if no merge makes a symbol that an earlier merge already
uses; the vocabulary is checked for it, and one place a round is merged where it does not hold.

Rows stay where they are: no shuffle.  A task keeps the vocabulary and a bounded store of words
it has already encoded; texts are handled in slices of bounded bytes.  The vocabulary file is
read on the driver and travels with the task, so no executor needs its path.

Cases: a null text has no tokens and decodes to ''; repeated rows give repeated results; an
added token's string in a text becomes that token, as the tokenizers library has it.
"""

from __future__ import annotations

import dataclasses
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from rulewatch.llm.common import SLICE_BYTES, flat_ranges, slices

# Fixed value: the pattern that splits text before byte-level merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same split for texts of these characters only, where the classes are plain ranges.
PLAIN_TEXT = "\t\n\r -~À-ÖØ-öø-ɏ"
_L, _S = "A-Za-zÀ-ÖØ-öø-ɏ", r"\t\n\r "
PLAIN_SPLIT = rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[0-9]+| ?[^{_L}0-9{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
STORE_BYTES = 64 << 20
NONE = np.int64(1 << 40)


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte: itself if visible, else 256 onwards."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclasses.dataclass(frozen=True)
class Vocabulary:
    """What the rounds need, as arrays."""

    of_byte: np.ndarray  # the id of each single byte
    keys: np.ndarray  # sorted pair keys: left id * size + right id
    ranks: np.ndarray  # rank of each key
    merged: np.ndarray  # id that each key becomes
    added: dict[str, int]
    token_bytes: list[bytes]
    at_once: bool  # all places of a word may be merged in one round

    @property
    def size(self) -> int:
        return len(self.token_bytes)


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    model, added = found["model"], {x["content"]: x["id"] for x in found["added_tokens"]}
    plain = model["type"] == "BPE" and found["normalizer"] is None and not model["ignore_merges"]
    before = found["pre_tokenizer"]
    if not plain or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
        raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
    ids, size, to_byte = model["vocab"], 1 + max([*model["vocab"].values(), *added.values()]), printable_bytes()
    token_bytes = [b""] * size
    for token, i in ids.items():
        token_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
    for token, i in added.items():
        token_bytes[i] = token.encode()
    merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
    left, right, merged = (np.array([ids[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], "".join))
    last_made = np.full(size, -1)
    last_made[merged] = np.arange(len(merges))  # the last rank counts if there are several
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    return Vocabulary(
        np.array([ids[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])], np.int64),
        keys[order], order.astype(np.int64), merged[order], added, token_bytes,
        bool((np.maximum(last_made[left], last_made[right]) < np.arange(len(merges))).all()),
    )


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, end to end, and how many each word has."""
    symbols = v.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    done_symbols, done_owner = [], []
    while len(symbols):
        keys = symbols[:-1] * v.size + symbols[1:]
        at = np.minimum(np.searchsorted(v.keys, keys), len(v.keys) - 1)
        fits = (v.keys[at] == keys) & (owner[:-1] == owner[1:])
        rank = np.append(np.where(fits, v.ranks[at], NONE), NONE)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.minimum.reduceat(rank, first)
        lengths = np.diff(np.append(first, len(symbols)))
        if (lowest == NONE).any():  # these words are done: they leave the array
            over = np.repeat(lowest == NONE, lengths)
            done_symbols.append(symbols[over])
            done_owner.append(owner[over])
            symbols, owner, rank, at = symbols[~over], owner[~over], rank[~over], at[~over[:-1]] if not over[-1] else at[~over[:-1]]
            if not len(symbols):
                break
            keep = lowest != NONE
            lowest, lengths = lowest[keep], lengths[keep]
            first = np.cumsum(lengths) - lengths
            at = np.append(at, 0)[: len(symbols)]
        else:
            at = np.append(at, 0)
        chosen = np.flatnonzero(rank == np.repeat(lowest, lengths))
        if v.at_once:  # of overlapping places (one symbol again and again) every second
            run = np.append(True, np.diff(chosen) > 1)
            starts = chosen[run][np.cumsum(run) - 1]
            chosen = chosen[(chosen - starts) % 2 == 0]
        else:
            chosen = chosen[np.append(True, owner[chosen][1:] != owner[chosen][:-1])]
        symbols[chosen] = v.merged[at[chosen]]
        stays = np.ones(len(symbols), bool)
        stays[chosen + 1] = False
        symbols, owner = symbols[stays], owner[stays]
    if not done_owner:
        return np.empty(0, np.int64), np.zeros(len(words), np.int64)
    symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    return symbols[order], np.bincount(owner, minlength=len(words))


class Encoder:
    """Encodes lists of texts; words once encoded stay stored up to a bounded size."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.any_split, self.plain_split = regex.compile(SPLIT).findall, re.compile(PLAIN_SPLIT).findall
        self.unusual = re.compile(f"[^{PLAIN_TEXT}]").search
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")") if vocabulary.added else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)
        for token, i in self.v.added.items():
            self.learn([(token, np.array([i]), np.array([1]))])

    def learn(self, parts) -> None:
        for words, ids, lengths in parts:
            words = [words] if isinstance(words, str) else words
            starts = len(self.ids) + np.cumsum(lengths) - lengths
            self.known.update(zip(words, range(len(self.starts), len(self.starts) + len(words))))
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
            self.starts = np.concatenate((self.starts, starts))
            self.lengths = np.concatenate((self.lengths, lengths))

    def split(self, text: str) -> list[str]:
        return self.any_split(text) if self.unusual(text) else self.plain_split(text)

    def words(self, text: str) -> list[str]:
        if self.at_added is None or not any(x in text for x in self.v.added):
            return self.split(text)
        out: list[str] = []
        for i, part in enumerate(self.at_added.split(text)):
            out += [part] if i % 2 else self.split(part)
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end and the number of ids of each text."""
        if len(self.ids) * 16 + sum(map(len, self.known)) * 2 > STORE_BYTES:
            self.forget()
        of_text = [self.words(t) for t in texts]
        flat = [w for words in of_text for w in words]
        new = [w for w in dict.fromkeys(flat) if w not in self.known]
        if new:
            self.learn([(new, *merge_words([w.encode() for w in new], self.v))])
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        lengths = self.lengths[at]
        text_ends = np.cumsum([0, *map(len, of_text)])
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return self.ids[flat_ranges(self.starts[at], lengths)], np.diff(ends[text_ends])


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids``, the token ids of each whole text; one row for each input row."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        encoder = Encoder(vocabulary)
        for part in slices(batches, "text", SLICE_BYTES):
            ids, counts = encoder([x or "" for x in part.column("text").to_pylist()])
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], ["key", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key``, ``ids`` and ``text``: the bytes of the ids, read as UTF-8, broken parts replaced."""
    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def run(batches):
        of_id = vocabulary.token_bytes.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [b"".join(map(of_id, x or ())).decode("utf-8", "replace") for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["key", "ids", "text"])

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, ids array<int>, text string")
    return out.select(F.col("key").alias(key), F.col("ids").alias(ids), "text")


def digests(documents: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded, then decoded from the ids."""
    vocabulary = load_vocabulary(path)
    both = decode(encode(documents, vocabulary, text, key), vocabulary, "ids", key)
    return both.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
