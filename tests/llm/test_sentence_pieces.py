"""Merge-type SentencePiece coding against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from llm import sentence_pieces
from llm.common import prepare

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "e", "t", " ", "  ", "▁", "é", "日", "𓀀", "\n", "\t", "\x00", "<s>", "<0x0A>", "qu", "th", "ing", "12", ".", "の", "ни", " the", "́"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return sentence_pieces.Model(file.read())


def wanted(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    packed = struct.pack(f"<{len(ids)}I", *ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("portion", [20, 1 << 18])
def test_random_texts(library, model, portion, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "PORTION", portion)
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 300)
    monkeypatch.setattr(sentence_pieces, "WINDOW", 5)
    random.seed(portion)
    for _ in range(3000):
        text = "".join(random.choice(PARTS) for _ in range(random.randint(0, 40)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert model.encode(text) == ids, text
        assert model.decode(ids) == library.decode(ids), text
        assert model.digest(text) == wanted(library, text), text


def test_long_texts(library, model):
    random.seed(3)
    letters = "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000))
    for text in [" " * 1000, "q" * 30_000, "ab" * 4000 + "日" * 3000, "aaaa " * 90_000, letters, " " * 40 + "word" + " " * 17 + "the"]:
        assert model.digest(text) == wanted(library, text)


def test_ids_that_no_text_gives_decode_as_in_the_library(library, model):
    random.seed(4)
    for _ in range(3000):
        ids = [random.randrange(32_000 if random.random() < 0.5 else 260) for _ in range(random.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids), ids


def test_pieces_are_those_of_merging(model):
    random.seed(5)
    for _ in range(3000):
        text = "".join(random.choice("the ing on re st a".replace(" ", "▁")) for _ in range(random.randint(1, 30)))
        assert model.word_ids(text) == [model.ids[piece] for piece in model.merged(text)]


def test_other_kinds_of_models_are_refused():
    with pytest.raises(ValueError):
        sentence_pieces.Model(b"")


def test_tables(spark, library):
    prepare(spark)
    rows = [(1, "the quick brown", "x"), (1, "the quick brown", "x"), (2, None, "x"), (3, "", "x"), (None, "日本 \n", "x"), (4, "ab " * 9000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    want = sorted(repr((i, *wanted(library, text))) for i, text, _ in rows)
    assert sorted(repr(tuple(r)) for r in sentence_pieces.digests(docs, PATH).collect()) == want
    back = sentence_pieces.decode(sentence_pieces.encode(docs, PATH), PATH).collect()
    assert sorted(repr(tuple(r)) for r in back) == sorted(repr((i, text or "")) for i, text, _ in rows)
    assert sentence_pieces.digests(docs.limit(0), PATH).collect() == []
