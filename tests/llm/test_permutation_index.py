"""Ranking by permutations: Spearman's rho, ties, and its cost against a scan."""

from __future__ import annotations

import time

import numpy as np

from foliometer.llm.permutation_index import Settings, Shard, inner, nearest_pivots


def shard_of(n, near=128, width=64, n_pivots=256):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(n, width))
    pivots = rng.normal(size=(n_pivots, width))
    places = nearest_pivots(vectors, pivots, near)
    return vectors, places, Shard(vectors, places, n_pivots)


def test_ranking_is_by_spearmans_rho_with_all_ties():
    near, n_pivots = 5, 9
    _, places, shard = shard_of(300, near, 4, n_pivots)
    stand = np.full((300, n_pivots), near)
    for row, pivots in enumerate(places):
        stand[row, pivots] = np.arange(near)
    for query, got in enumerate(shard.best(places, 20)):
        rho = ((stand - stand[query]) ** 2).sum(axis=1)
        assert got.tolist() == np.flatnonzero(rho <= np.sort(rho)[19]).tolist()


def test_nearest_of_the_chosen_are_those_of_the_full_loop():
    vectors, _, shard = shard_of(2000)
    vectors[50:80] = vectors[7]  # ties beyond the number asked for
    chosen = np.arange(0, 2000, 2)
    for query in (7, 11):
        scores = inner(vectors[chosen], vectors[query])
        want = chosen[scores >= np.sort(scores)[-21]]
        got, found = shard.nearest(chosen, vectors[query], 20)
        assert sorted(got.tolist()) == want.tolist()
        assert found.tolist() == sorted(scores[np.isin(chosen, want)].tolist(), reverse=True)


def test_search_of_a_shard_costs_less_than_comparing_every_vector():
    vectors, places, shard = shard_of(16_384)
    settings, queries = Settings(), 100

    def cost(work):
        began = time.thread_time()
        work()
        return time.thread_time() - began

    def search():
        count = int(settings.rerank * len(vectors))
        for query, chosen in enumerate(shard.best(places[:queries], count)):
            shard.nearest(chosen, vectors[query], settings.neighbours)

    def scan():
        for query in range(queries):
            inner(vectors, vectors[query])

    search()
    assert min(cost(search) for _ in range(3)) < min(cost(scan) for _ in range(3))
