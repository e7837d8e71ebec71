"""BPE, token counts and decontamination against the libraries and brute force."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer, models

from rulewatch.llm import bpe, counts, decontaminate

BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD_TEXTS = [
    "", None, " ", "a", "aaaa" * 300, "!" * 77, "x<|endoftext|>y <|endoftext|><|endoftext", "日本語 \x85 \x1c  \n\n'S's'll",
    "🙂🙃" * 20 + "́", "Straße ñandú  ² ½ ªº _x_ 12٣", "word " * 3000, "\t\r\n \x0b\x0c tail ", "<0x41> <unk> </s> ▁▁ ▁x",
]


def mixed(seed, n):
    rng = random.Random(seed)
    pools = ["abcdeth ", "ñéüß .,!'", "0123456789", "\n\t ", "日本🙂é", "<|endoftext|>"]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(120))) for _ in range(n)]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(BPE)


def test_bpe_like_the_library(spark, vocabulary):
    texts = ODD_TEXTS + mixed(1, 200) + ["twice", "twice"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    library = Tokenizer.from_file(BPE)
    got = {r["doc_id"]: r for r in bpe.digests(rows, BPE).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded)]
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), *digest), text


def test_decoding_broken_bytes(spark, vocabulary):
    ids = [[int(i) for i in vocabulary.of_byte[[0xE2, 0x82, 0x41, 0xFF]]], None, []]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "doc_id long, ids array<int>")
    library = Tokenizer.from_file(BPE)
    want = {i: library.decode(x or [], skip_special_tokens=False) for i, x in enumerate(ids)}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(rows, vocabulary).collect()} == want


def test_one_place_a_round_gives_the_same(vocabulary):
    import dataclasses

    words = [w.encode() for t in mixed(2, 60) for w in t.split(" ") if w]
    slow = dataclasses.replace(vocabulary, at_once=False)
    for a, b in zip(bpe.merge_words(list(words), vocabulary), bpe.merge_words(list(words), slow)):
        assert a.tolist() == b.tolist()


def test_stored_words_are_forgotten(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "STORE_BYTES", 100)
    encoder, library = bpe.Encoder(vocabulary), Tokenizer.from_file(BPE)
    for text in mixed(3, 30):
        assert encoder([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def unigram(scores):
    """The library's own model over the same pieces; the text is marked as our counter marks it."""
    pieces = list(scores.items())
    model = models.Unigram(pieces, unk_id=[p for p, _ in pieces].index("<unk>"), byte_fallback=True)
    return lambda text: len(Tokenizer(model).encode(counts.MARK + text.replace(" ", counts.MARK)).ids) if text else 0


def test_token_counts_like_the_library(spark):
    pieces = counts.load_pieces(PIECES)
    assert pieces.separable
    texts = ODD_TEXTS + mixed(4, 200)
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    library = unigram(pieces.scores)
    got = {r["doc_id"]: r["n_tokens"] for r in counts.token_counts(rows, pieces).collect()}
    assert got == {i: library(t or "") for i, t in enumerate(texts)}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("ab▁é", min_size=1, max_size=3), st.sampled_from([-1.0, -2.0, -3.0, -1.7]), max_size=12), st.text("ab é", max_size=14))
def test_ties_like_the_library(own, text):
    scores = {"<unk>": 0.0} | {f"<0x{b:02X}>": -9.0 for b in range(256)} | own
    assert counts.Counter(counts.Pieces(scores))(text)[1] == unigram(scores)(text)


def test_byte_pieces_are_needed():
    with pytest.raises(ValueError):
        counts.Pieces({"a": 0.0})


def brute_hits(text, items, width=13):
    def words(x):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").encode().lower())

    doc, hit, found = words(text), set(), set()
    for item, item_text in items:
        w = words(item_text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            pattern = w[i : i + width]
            for at in range(len(doc) - len(pattern) + 1):
                if doc[at : at + len(pattern)] == pattern:
                    hit |= set(range(at, at + len(pattern)))
                    if item is not None:
                        found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(doc), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(doc)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_hits_like_brute_force(spark, block_bytes):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "Ab", "c9", "é"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30])))) for k in range(14)]
    items += [(3, items[3][1]), (20, ""), (21, None), (None, "c9 c9 c9 c9 b b"), (22, "!!"), (23, items[0][1])]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(80)))) for i in range(30)]
    docs += [(100 + i, f"x, {t} y. {u}") for i, (_, t) in enumerate(items) if t for u in [t.upper()]]
    docs += [(200, None), (201, ""), (None, items[6][1]), (202, " ".join(t or "" for _, t in items)), (203, "z" * 5000), (30, docs[0][1]), (30, docs[0][1])]
    rows = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, row int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(rows, benchmark, block_bytes=block_bytes).collect()
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((str(r["doc_id"]), *(r[c] for c in columns)) for r in got) == sorted((str(d), *brute_hits(t, items)) for d, t in docs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, benchmark).collect() == []
    assert bpe.digests(docs, BPE).collect() == []
    assert counts.token_counts(docs, counts.load_pieces(PIECES)).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate.contamination(one, benchmark).first()["contaminated"] is False
