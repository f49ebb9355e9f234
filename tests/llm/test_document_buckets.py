"""Documents of one bucket are compared in its tasks, without a row per pair."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliometer.llm import banding, near_docs
from foliometer.llm.common import mixed, prepare


def component_ids(sets, label):
    label = list(label)
    for i, one in enumerate(sets):
        for j, two in enumerate(sets[:i]):
            if label[i] != label[j] and 100 * len(one & two) >= 75 * len(one | two):
                label = [label[j] if x == label[i] else x for x in label]
    return [label.index(x) for x in label]


@pytest.mark.parametrize("cells", [0, 10**9])
def test_linked_groups_of_a_bucket_become_one(monkeypatch, cells):
    monkeypatch.setattr(banding, "DENSE_CELLS", cells)
    rng = random.Random(5)
    sets = [set(range(at, at + 60)) for at in range(0, 400, 4)] + [set(rng.sample(range(1000), 50)) for _ in range(20)]
    rng.shuffle(sets)
    hashes = np.concatenate([sorted(s) for s in sets])
    groups = np.arange(len(sets))
    a, b = banding.across_links(groups, groups, hashes, np.array([len(s) for s in sets]), 75, unite=True)
    assert 0 < len(a) < len(sets)
    label = list(range(len(sets)))
    for i, j in zip(a, b, strict=True):
        label = [label[j] if x == label[i] else x for x in label]
    assert [label.index(x) for x in label] == component_ids(sets, range(len(sets)))


def test_members_ruled_out_are_those_of_the_estimate(spark):
    settings = near_docs.Settings()
    factors = near_docs.multipliers(settings.minima)
    pool = mixed(np.arange(1, 400, dtype=np.uint64))
    packs = [near_docs.packed(near_docs.minima_of(pool[at : at + 120], factors)).view(np.int64).tolist() for at in range(0, 280, 7)]
    packs[3] = None
    may = near_docs.closeness(settings)({"signature": pa.array(packs, pa.list_(pa.int64()))})
    schema = "i long, signature array<long>"
    one, two = (spark.createDataFrame(list(enumerate(packs)), schema).toDF(n, f"signature_{n}") for n in "ab")
    close = near_docs.estimate("signature_a", "signature_b") >= settings.percent / 100 - settings.slack
    pairs = one.crossJoin(two).filter(F.coalesce(close, F.lit(True))).select("a", "b")
    want = {tuple(row) for row in pairs.collect()}
    assert {(a, int(b)) for a in range(len(packs)) for b in np.flatnonzero(may(a))} == want
    assert len(packs) * 2 < len(want) < len(packs) ** 2


def test_large_buckets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_docs, "BLOCK_SHINGLES", 700)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([2, 4, 6])):
            words[at] = f"x{rng.random()}"
        texts.append(" ".join(words))
    sets = [{tuple(text.split()[i : i + 5]) for i in range(116)} for text in texts]
    df = prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {row.doc_id: row.component_id for row in near_docs.near_documents(df).collect()}
    want = component_ids(sets, range(len(sets)))
    assert [got[i] for i in range(len(sets))] == want
    assert 1 < len(set(want)) < len(sets)
