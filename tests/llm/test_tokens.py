"""Piecewise encoding equals encoding the whole text in one call."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from interlinear.llm import tokens
from interlinear.llm.tokens import PieceEncoder

PARTS = ["a", "B", "word", " ", " ", "\n", ",", ".", "!", "'s", "\u00e9", "\u0301", "1", "\t", "\xa0", "_", "<|endoftext|>",
         "\u03a3", "\ufb01", "\u00b2", "\x00", "<", "\u0338", "\u0130", "\u3000", "\u6f22", "\u212a", "\u0958", "I", "\u0307"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_whole_texts(name):
    rng = random.Random(5)
    texts = ["", "a, b. c", "x!, y", "word_, x", "a., b", "a ,b , c", "1. 2, 3", "x\n. y", "a'll, b's."]
    texts += ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(30_000)]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    expected = [c.ids for c in whole.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(c, "<u2").tolist() for c in PieceEncoder(public_tokenizers.path(name)).encode_all(texts)]
    assert [t for t, e, g in zip(texts, expected, got) if e != g] == []


WIDE = [*"aZ09'.,!$<|>_-~\n\n   \t\r\0JHTIK", "'s", "'ll", "<|", "|>", "<|endoftext|>", "word",
        "\x1c", "\x1f", "\x7f", "\x85", "\xa0", "\xad", "\xb2", "\xbf", "\xd7", "\xdf", "\xe9", "\xf7", "\xff",
        "\u0130", "\u0307", "\u030c", "\u0331", "\u0308", "\u0338", "\u0345", "\u03a3", "\u0660", "\u0915", "\u093c",
        "\u1100", "\u1161", "\u1680", "\u180e", "\u2000", "\u2003", "\u200b", "\u200d", "\u201d", "\u2028", "\u202f",
        "\u205f", "\u2126", "\u212a", "\u3000", "\u3042", "\u6f22", "\uac00", "\u11a8", "\ufeff", "\uff0c",
        "\U0001d400", "\U0001f600"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_columns_equal_whole_texts(name, monkeypatch):
    """Many kinds of white space, marks and composing characters, a few texts a slice, an often emptied cache,
    a column that starts inside its buffer."""
    monkeypatch.setattr(tokens, "SLICE", 500)
    monkeypatch.setattr(tokens, "CACHE", 300)
    rng = random.Random(9)
    texts = ["".join(rng.choices(WIDE, k=rng.randint(0, 12))) for _ in range(40_000)] + ["x" * 2000, "", ""]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = True
    expected = [c.ids for c in whole.encode_batch(texts, add_special_tokens=False)]
    enc = PieceEncoder(public_tokenizers.path(name))
    got = [np.frombuffer(c, "<u2").tolist() for c in enc.encode_column(pa.array(["left out", *texts]).slice(1))]
    assert [t for t, e, g in zip(texts, expected, got, strict=True) if e != g] == []
    assert list(enc.encode_column(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_marks_and_digits_make_no_new_words(name):
    """A word is learnt once, whatever marks and digits stand beside it."""
    enc, marks = PieceEncoder(public_tokenizers.path(name)), ["", "!!", "%%%", "$$$", "&&&", ".", ",", ")", "?", "7", "42", "'s"]
    enc.encode_all([f"Some {word}{mark} here" for word in ("word", "naïveté", "café") for mark in marks])
    assert len(enc.known) <= 3 + 2 + len(marks)
