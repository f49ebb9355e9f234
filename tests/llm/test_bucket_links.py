"""Band rows in ranges of keys, and the links made of them."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from foliometer.llm import banding
from foliometer.llm.common import WordHashes


@pytest.mark.parametrize("most", [10**6, 20])
def test_links_reach_all_of_a_bucket(monkeypatch, most):
    monkeypatch.setattr(banding, "MOST_ENTRIES", most)
    rng = np.random.default_rng(1)
    batches, buckets = [], defaultdict(set)
    for _ in range(6):
        keys = rng.integers(0, 40, (3, 30)).astype(np.uint64) * np.uint64(2**58) + np.uint64(5)
        nodes = rng.choice(500, 30, replace=False).astype(np.uint64)
        for band in keys.view(np.int64):
            for key, node in zip(band.tolist(), nodes.tolist(), strict=True):
                buckets[key].add(node)
        batches.append(pa.RecordBatch.from_arrays(banding.local_stars(keys, nodes), ["part", "entries"]))
        # One row per range of keys, however many entries there are.
        assert batches[-1].num_rows == len(set((keys >> np.uint64(52)).ravel().tolist()))
    table = pa.Table.from_batches(batches).sort_by("part").combine_chunks()
    found = [row for out in banding.stars(table.to_batches(max_chunksize=7)) for row in out.to_pylist()]
    count, label = Counter(row["key"] for row in found), {key: {n: n for n in nodes} for key, nodes in buckets.items()}
    for row in found:
        key, a, b = row["key"], row["a"], row["b"]
        assert a < b and (row["many"] or count[key] == 1)
        old, new = label[key][b], label[key][a]
        label[key] = {n: new if x == old else x for n, x in label[key].items()}
    assert all(len(set(groups.values())) == 1 for groups in label.values())


def test_words_a_worker_remembers_stay_few():
    known = WordHashes()
    words = [b"w%d" % i for i in range(120_000)]
    assert known.of(words).tolist() == [xxhash.xxh3_64_intdigest(word) for word in words]
    assert len(known) <= 100_000
