"""Token counts under a unigram vocabulary, without building the tokens.

Method: count-only Viterbi.  An Aho-Corasick automaton enumerates every vocabulary piece that
ends at each character; dynamic programming carries the best score and the piece count.  Ties
go to the piece that starts first, as in the tokenizers library's Unigram model: matches with
one end come longest first, and a later one must be strictly better.  A character that no
one-character piece covers costs the lowest score less 10 and counts as its UTF-8 bytes.

Texts are cut where no piece can cross (before a word mark that follows another character), and
the counts of words are stored in a dictionary of bounded size.  That is exact only if scores
add up without rounding, so other vocabularies go through each text in one piece.

Rows stay where they are: no shuffle.  Cases: a null or empty text has no pieces; repeated rows
give repeated results.
"""

from __future__ import annotations

import dataclasses
import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from rulewatch.llm.common import slices

MARK = "▁"  # stands for a space
STORE_WORDS = 500_000
UNKNOWN_PENALTY = 10.0


@dataclasses.dataclass(frozen=True)
class Pieces:
    """A unigram vocabulary: every piece once, with its score; all 256 byte pieces among them."""

    scores: dict[str, float]

    def __post_init__(self):
        if missing := [b for b in range(256) if f"<0x{b:02X}>" not in self.scores]:
            raise ValueError(f"byte pieces are missing: {missing[:3]}")

    @property
    def separable(self) -> bool:
        """No piece has a mark after another character, and sums of scores are exact."""
        whole = all(float(s).is_integer() and abs(s) < 2**33 for s in self.scores.values())
        return whole and not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.scores)


def load_pieces(path: str) -> Pieces:
    """Pieces and scores of a sentencepiece file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return Pieces({model.id_to_piece(i): float(model.get_score(i)) for i in range(model.get_piece_size())})


class Counter:
    """Counts pieces of texts; the store of words is emptied when it is full."""

    def __init__(self, pieces: Pieces):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces.scores if len(p) == 1}
        self.unknown = min(pieces.scores.values()) - UNKNOWN_PENALTY
        self.separable, self.known = pieces.separable, {}

    def best(self, text: str) -> tuple[float, int]:
        """Score and piece count of the best path."""
        unknown, single = self.unknown, self.single
        scores, counts = [0.0] * (len(text) + 1), [0] * (len(text) + 1)
        reached, found = 0, None
        matches = self.automaton.iter(text)
        found = next(matches, None)
        for end, char in enumerate(text):
            best, count = None, 0
            while found is not None and found[0] == end:
                length, score = found[1]
                start = end + 1 - length
                total = scores[start] + score
                if best is None or total > best:
                    best, count = total, counts[start] + 1
                found = next(matches, None)
            if char not in single:
                total = scores[end] + unknown
                if best is None or total > best:
                    best, count = total, counts[end] + len(char.encode())
            scores[end + 1], counts[end + 1] = best, count
        return scores[-1], counts[-1]

    def __call__(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        marked = MARK + text.replace(" ", MARK)
        if not self.separable:
            return self.best(marked)
        known, score, count = self.known, 0.0, 0
        for word in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked):
            got = known.get(word)
            if got is None:
                if len(known) >= STORE_WORDS:
                    known.clear()
                got = self.best(word)
                if len(word) <= 64:
                    known[word] = got
            score += got[0]
            count += got[1]
        return score, count


def token_counts(df: DataFrame, pieces: Pieces, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, score``: pieces of the best path through each whole text, one row each."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        counter = Counter(pieces)
        for part in slices(batches, "text"):
            got = [counter(x or "") for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array([n for _, n in got], pa.int64()), pa.array([s for s, _ in got], pa.float64())],
                ["key", "n_tokens", "score"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, score double").withColumnRenamed("key", key)
