"""Ids by words against encoding the whole text, and what the table of words holds."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from foliometer.llm import tokens
from foliometer.llm.tokens import WordIds, vocabulary

ODD = [
    "", None, " ", "\n", "a\n\nb", "  x  ", "it's DON'T. é, É!!! ß. ẞ", "<|endoftext|> a<|startoftext|>,", "a\0b c d",
    "é, É.", "日本語, 日本.", "x" * 5000 + " , ...", "\t a\tb\r\nc", "Ⅷ. Å, K; ﬁ", "ªb, º.", "Ἀ, ΣΑΣ. ΑΣ",
]


@pytest.fixture
def known():
    return WordIds(vocabulary())


def whole(known, text, end=1):
    return [*known.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def of(known, texts):
    ids, lengths = known.of(texts, 1)
    ids, at = ids.tolist(), 0
    for length in lengths.tolist():
        yield ids[at : at + length]
        at += length


@pytest.mark.parametrize("text", ["İ,", "x İ. y", "क़,", "क़.क़", "ɐİ;"])
def test_letters_that_become_letter_and_mark_before_punctuation(known, text):
    assert list(of(known, [text])) == [whole(known, text)]


def test_odd_texts_alone_together_and_sliced(known):
    want = [whole(known, text) for text in ODD]
    assert [ids for text in ODD for ids in of(known, [text])] == want
    assert list(of(known, pa.array(ODD))) == want
    assert list(of(known, pa.array([*ODD, "z"]).slice(3, 9))) == want[3:12]


def test_a_word_takes_one_place(known):
    list(of(known, ["Alpha, beta. gamma!! Alpha,", "beta. delta"]))
    assert sorted(known) == ["Alpha,", "beta.", "delta", "gamma!!"]
    assert len(known.starts) == len(known.counts) == 4


def test_emptied_tables_give_the_same_ids(known, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 50)
    rng = random.Random(1)
    for _ in range(20):
        texts = [" ".join("".join(rng.choices("abéñ.,", k=rng.randint(1, 5))) for _ in range(30)) for _ in range(3)]
        assert list(of(known, texts)) == [whole(known, text) for text in texts]
