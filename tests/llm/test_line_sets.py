"""Shingle sets of lines against Python sets."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from foliometer.llm import banding, near_lines


def shingles(line, size):
    return {line[i : i + size] for i in range(len(line) - size + 1)}


def lines_for(rng, n):
    # Few letters, so that shingles repeat within a line and between lines.
    return ["".join(rng.choices("abä", k=rng.choice([4, 5, 30, 200]))) for _ in range(n)]


def test_sets_and_their_sizes():
    lines = lines_for(random.Random(1), 60)
    hashes, sizes = near_lines.distinct_shingles(lines, 4)
    assert sizes.tolist() == [len(shingles(line, 4)) for line in lines]
    assert len(hashes) == sizes.sum()
    assert len(np.unique(hashes)) == len(set().union(*(shingles(line, 4) for line in lines)))


def test_similar_pairs(monkeypatch):
    monkeypatch.setattr(banding, "PIECE_BYTES", 300)
    rng = random.Random(2)
    lines = lines_for(rng, 20)
    left = [rng.choice(lines) for _ in range(200)]
    right = [line[:-1] + "b" if rng.random() < 0.5 else rng.choice(lines) for line in left]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(200)), pa.array(range(200, 400)), pa.array(left), pa.array(right)],
        ["a", "b", "line_a", "line_b"],
    )
    got = [a for found in near_lines.similar(75, 4)([batch, batch.slice(0, 0)]) for a in found.column("a").to_pylist()]
    pairs = [(shingles(x, 4), shingles(y, 4)) for x, y in zip(left, right, strict=True)]
    assert got == [i for i, (x, y) in enumerate(pairs) if 100 * len(x & y) >= 75 * len(x | y)]
    assert 0 < len(got) < 200


def test_signatures_are_minima_of_each_line():
    factors = near_lines.multipliers(6)
    lines = lines_for(random.Random(3), 40) + ["x" * 70_000 + "yzzy"]
    found = near_lines.signatures(lines, factors, 4)
    for number, line in enumerate(lines):
        hashes, _ = near_lines.char_hashes([line], 4)
        assert found[:, number].tolist() == [(hashes * factor).min() for factor in factors]


def test_links_between_groups_of_a_bucket():
    rng = random.Random(4)
    lines = sorted({line + tail for line in lines_for(rng, 12) for tail in ("", "a", "bb")})
    nodes, groups = np.arange(len(lines)), np.array([rng.randrange(9) for _ in lines])
    hashes, sizes = near_lines.distinct_shingles(lines, 4)
    a, b = banding.across_links(nodes, groups, hashes, sizes, 75)
    sets = [shingles(line, 4) for line in lines]
    near = {
        frozenset((groups[i], groups[j]))
        for i in range(len(lines)) for j in range(i)
        if groups[i] != groups[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    }
    assert {frozenset((groups[i], groups[j])) for i, j in zip(a, b, strict=True)} == near
