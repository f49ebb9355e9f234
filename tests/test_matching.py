"""Long-text matching against difflib on the same pairs."""

from __future__ import annotations

import difflib
import random
import time

import pytest

from foliometer.functions import matching

ALPHABETS = ["ab", "abcdefgh ", "etaoin shrdlu" * 8 + "zqxjkvbpygw0123456789\n", "äß漢😀\ud800 " * 3 + "xyz"]


def edited(rng, text, alphabet, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars) + 1)
        kind = rng.randrange(4)
        if kind == 0:
            chars.insert(at, rng.choice(alphabet))
        elif kind == 1:
            del chars[at : at + rng.randrange(1, 4)]
        elif kind == 2:
            chars[at : at + 1] = rng.choice(alphabet)
        else:
            start = rng.randrange(len(chars) + 1)
            part = chars[start : start + rng.randrange(60)]
            del chars[start : start + len(part)]
            chars[at:at] = part
    return "".join(chars)


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_ratio_and_verdict_equal_difflib(monkeypatch, alphabet):
    monkeypatch.setattr(matching, "LONG_TEXT", 1)
    rng = random.Random(len(alphabet))
    for round_no in range(60):
        left = "".join(rng.choices(alphabet, k=rng.randrange(1, 700)))
        right = edited(rng, left, alphabet, rng.choice([0, 1, 2, 5, 40]))
        if round_no % 7 == 0:
            right = "".join(rng.choices(alphabet, k=rng.randrange(0, 700)))
        expected = difflib.SequenceMatcher(None, left, right).ratio()
        assert matching.ratio(left, right) == expected
        for limit in (0.5, 0.9, 0.999, expected):
            assert matching.below(left, right, limit) == (expected < limit)


def test_bounds_close_in():
    rng = random.Random(3)
    left = "".join(rng.choices("abcdefghij ", k=900))
    matcher = matching.Matcher(left, edited(rng, left, "abc", 30))
    bounds = list(matcher.bounds())
    assert all(a[0] <= b[0] and a[1] >= b[1] for a, b in zip(bounds, bounds[1:], strict=False))
    assert bounds[-1][0] == bounds[-1][1]


def test_empty_and_equal_texts():
    assert matching.ratio("", "") == 1.0
    assert matching.ratio("", "x" * 1000) == 0.0
    assert matching.ratio("x" * 1000, "x" * 1000) == 1.0
    assert not matching.below("", "", 0.999)
    assert matching.below("", "x" * 1000, 0.999)


def test_a_clash_of_hashes_is_left_to_difflib(monkeypatch):
    def clash(self, span):
        raise matching.HashClash

    monkeypatch.setattr(matching, "LONG_TEXT", 1)
    monkeypatch.setattr(matching.Matcher, "block", clash)
    left, right = "abc def " * 100, "abc dxf " * 100
    expected = difflib.SequenceMatcher(None, left, right).ratio()
    assert matching.ratio(left, right) == expected
    assert matching.below(left, right, 0.999) == (expected < 0.999)


def test_a_long_page_takes_seconds():
    rng = random.Random(9)
    letters = "".join(map(chr, range(0x400, 0x500)))
    left = "".join(rng.choices(letters, k=100_000))
    right = edited(rng, left, letters, 8)
    start = time.monotonic()
    assert not matching.below(left, right, 0.999)
    assert matching.below(left, left[::-1], 0.999)
    assert time.monotonic() - start < 60


def test_short_texts_are_matched_with_their_runs_listed_once(monkeypatch):
    rng = random.Random(7)
    pairs = [("", ""), ("", "a"), ("a", "")]
    for letters in ("ab", "abc ", "etaoin shrdlucmfwypvbgkqjxzäöü€😀"):
        for size_a, size_b in [(1, 40), (150, 150), (900, 199), (250, 900), (700, 700)]:
            pairs.append(tuple("".join(rng.choices(letters, k=size)) for size in (size_a, size_b)))
        text = pairs[-1][0]
        pairs.append((text, text[:300] + "b" + text[340:]))
    expected = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert [matching.ratio(a, b) for a, b in pairs] == expected
    # Too many equal characters are not listed; the figures stay.
    monkeypatch.setattr(matching, "RUN_POINTS", 50)
    assert [matching.ratio(a, b) for a, b in pairs] == expected
    monkeypatch.undo()
    monkeypatch.setattr(matching.difflib, "SequenceMatcher", None)
    assert matching.ratio(*pairs[-1]) == expected[-1]
