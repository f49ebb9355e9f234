"""Collocations, Merkle manifest and exact top-k against loops over every row."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from foliometer.llm import collocations, merkle, threshold_search
from foliometer.llm.common import prepare

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, phrase string, block string, place long"


def text_of(rng, n, mark):
    words = [rng.choice(["the", "The", "of", "é", "a" * 30, "new", "york", "x\x0by", "q\tr"] + [f"w{i}" for i in range(30)]) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", "  ", mark]) for w in words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", " \n.;", "one", "New York. " * 40, "a b c d e f g " * 30, "the of " * 2000]
    texts += [text_of(rng, rng.randint(1, 300), mark) for mark in ".,;:!?\n\x0c\r" for _ in range(12)]
    made = [
        (i if i % 17 else None, t, ("en", "de", None, "und")[i % 4], f"s{i % 3}" if i % 5 else None, i, 1, "x", "y", 2)
        for i, t in enumerate(texts)
    ]
    return [*made, made[5], made[5], (3, "AbC other", "en", "s0", None, None, None, None, None)]


def counts_of(rows):
    found = defaultdict(Counter)
    for row in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (row[1] or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 6):
                for at in range(len(words) - size + 1):
                    found[row[2] or "und"][tuple(words[at : at + size])] += 1
    return found


def best_phrases(rows, least, best):
    want = []
    for lang, counts in counts_of(rows).items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        candidates = {g: c for g, c in counts.items() if len(g) > 1 and c >= least}
        inside = defaultdict(int)
        for g, c in candidates.items():
            for size in range(2, len(g)):
                for at in range(len(g) - size + 1):
                    inside[g[at : at + size]] = max(inside[g[at : at + size]], c)
        scored = []
        for g, a in candidates.items():
            if 100 * inside[g] >= 100 * a:
                continue
            score, k = min((1000 * a * n // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:best], 1):
            want.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(want)


@pytest.mark.parametrize("least", [2, 7])
def test_collocations(spark, rows, least):
    docs = prepare(spark).createDataFrame(rows, DOCS).repartition(3)
    settings = collocations.Settings(least=least, best=60)
    found = collocations.collocations(docs, settings)
    assert sorted(tuple(r) for r in found.collect()) == best_phrases(rows, least, 60)


def test_collocations_when_all_counters_collide(spark, rows):
    docs = prepare(spark).createDataFrame(rows, DOCS)
    settings = collocations.Settings(least=9, best=50, slots=1 << 20, bucket_bytes=4096)
    found = collocations.collocations(docs, settings)
    assert sorted(tuple(r) for r in found.collect()) == best_phrases(rows, 9, 50)


def test_collocations_of_long_texts(spark):
    """A text of more than one slice, without any mark, loses no run at the joins."""
    words = ["alpha", "beta", "gamma", "delta"] * 600_000
    text = " ".join(words)
    assert len(text) > 2 * collocations.SLICE_BYTES
    docs = prepare(spark).createDataFrame([(text, "en")], "text string, lang string")
    found = {(r.phrase): r.n for r in collocations.frequent_runs(docs).collect()}
    assert found["alpha beta gamma delta alpha"] == 599_999
    assert found["delta alpha"] == 599_999
    assert found["beta"] == 600_000
    assert found[""] == 2_400_000


def test_collocations_of_nothing(spark):
    docs = prepare(spark).createDataFrame([], DOCS)
    assert collocations.collocations(docs).collect() == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    """1000 * a * n of more than 64 bits is divided exactly."""
    counts = {"new york": 10**12 + 1, "new": 10**12 + 7, "york": 10**12 + 9}
    rows = [("en", len(p.split()), p, n) for p, n in counts.items()] + [("en", 0, "", 9 * 10**15)]
    found = spark.createDataFrame(rows, "lang string, size int, phrase string, n long")
    monkeypatch.setattr(collocations, "frequent_runs", lambda docs, settings: found)
    best = collocations.collocations(None).collect()
    score = 1000 * (10**12 + 1) * 9 * 10**15 // ((10**12 + 7) * (10**12 + 9))
    assert [tuple(r) for r in best] == [("en", 1, "new york", 10**12 + 1, 10**12 + 7, 10**12 + 9, 9 * 10**15, score)]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold_up(nodes):
    """(root, siblings left and right per level for every leaf)."""
    sides = [[] for _ in nodes]
    owners = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, owned = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for place in range(len(run)):
                for leaf in owners[at + place]:
                    sides[leaf].append(("".join(run[:place]), "".join(run[place + 1 :])))
            above.append(sha(*run))
            owned.append([leaf for part in owners[at : at + 16] for leaf in part])
        nodes, owners = above, owned
    return nodes[0], sides


def manifest_of(rows):
    def leaf(row, text):
        values = (row[0], row[3], row[2], row[4], text)
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    trees = defaultdict(list)
    for row in rows:
        tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        shown = row[1].translate(LOWER) if tampered and row[1] else row[1]
        key = (row[3] is not None, (row[3] or "").encode())
        trees[key].append(((row[0] is not None, row[0] or 0), leaf(row, row[1]), leaf(row, shown), row[0]))
    names = sorted(trees)
    roots = {}
    for name in names:
        trees[name].sort()
        roots[name] = fold_up([one[1] for one in trees[name]])
    root, tops = fold_up([roots[name][0] for name in names])
    out = []
    for name, top in zip(names, tops, strict=True):
        subroot, sides = roots[name]
        for (_, own, shown, doc_id), way in zip(trees[name], sides, strict=True):
            folded = shown
            for left, right in way + top:
                folded = sha(left, folded, right)
            proof = sha(*[side for pair in way + top for side in pair])
            out.append((doc_id, own, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def test_manifest(spark, rows):
    docs = prepare(spark).createDataFrame(rows, DOCS).repartition(3)
    found = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=repr)
    assert found == manifest_of(rows)
    assert any(not r[-1] for r in found) and any(r[-1] for r in found)


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (16, 17), (4096, 1), (4097,), (8193, 300, 4096)])
def test_manifest_over_blocks(spark, sizes):
    made = [(i, f"Text {i}", "en", f"s{at}", 5, 1, "", "", 1) for at, size in enumerate(sizes) for i in range(size)]
    docs = prepare(spark).createDataFrame(made, DOCS)
    assert sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=repr) == manifest_of(made)


def test_manifest_of_many_sources(spark):
    made = [(i, f"Text {i}", "en", f"source {i % 4200}", 5, 1, "", "", 1) for i in range(5000)]
    docs = prepare(spark).createDataFrame(made, DOCS)
    assert sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=repr) == manifest_of(made)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(prepare(spark).createDataFrame([], DOCS)).collect() == []


VECTORS = "vec_id long, embedding array<double>, label int, v string, shard int, cutoff long, asks int"


def top_of(rows, best):
    taken = [
        (i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    sizes = Counter(len(v) for _, v in {(i, tuple(v)) for i, v in taken})
    assert len(sizes) < 2 or sizes.most_common(2)[0][1] > sizes.most_common(2)[1][1]
    taken = [(i, v) for i, v in taken if len(v) == sizes.most_common(1)[0][0]]
    score = {}
    for q, a in taken:
        for i, b in taken:
            if q % 20 == 0 and q != i:
                value = max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=True))))
                score[q, i] = max(value, score.get((q, i), value))
    want = []
    for q in {q for q, _ in score}:
        ranked = sorted((-s, i) for (p, i), s in score.items() if p == q)[:best]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(ranked, 1)]
    return sorted(want)


def vectors(rng, n, size, scale=1.0):
    return [(i, [rng.gauss(0, scale) for _ in range(size)], 0, "x", 1, 2, 3) for i in range(n)]


def test_top_scores(spark):
    rng = random.Random(8)
    made = vectors(rng, 400, 9)
    same = [0.5, -0.25] + [0.125] * 7
    made += [(i, same, 0, "x", 1, 2, 3) for i in range(400, 480)]  # ties
    made += [(1, same, 0, "x", 1, 2, 3), (20, same, 0, "x", 1, 2, 3), made[3], made[40]]  # ids that repeat
    for odd in (None, [], [1.0], [None] * 9, [math.nan] + same[1:], [math.inf] + same[1:], [0.0] * 9, [-0.01] * 9):
        made.append((rng.randrange(500, 600), odd, None, None, None, None, None))
    made.append((None, same, 0, "x", 1, 2, 3))
    frame = prepare(spark).createDataFrame(made, VECTORS).repartition(3)
    for settings in (threshold_search.Settings(), threshold_search.Settings(lists=4, heads=1, shard_rows=50, cells=500)):
        assert sorted(tuple(r) for r in threshold_search.top_scores(frame, settings).collect()) == top_of(made, 20)


@pytest.mark.parametrize("scale", [1e6, 1e9, 1e13])
def test_top_scores_of_large_components(spark, scale):
    made = vectors(random.Random(2), 60, 6, scale)
    found = threshold_search.top_scores(prepare(spark).createDataFrame(made, VECTORS)).collect()
    assert sorted(tuple(r) for r in found) == top_of(made, 20)


def test_top_scores_of_few_and_none(spark):
    made = vectors(random.Random(1), 5, 4)
    frame = prepare(spark).createDataFrame(made, VECTORS)
    assert sorted(tuple(r) for r in threshold_search.top_scores(frame).collect()) == top_of(made, 20)
    assert threshold_search.top_scores(frame.filter("vec_id < 0")).collect() == []
    assert threshold_search.top_scores(frame.filter("vec_id = 0")).collect() == []
