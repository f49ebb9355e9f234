"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by its nearest pivots
in order. The index holds the place each pivot has; queries rank the vectors by Spearman's
rho (the squares of how far the pivots' places are apart; a missing pivot stands behind the
last place), a block of queries at once by one matrix product, and compare the best ranked
by exact inner product. How many are compared is measured: every shard looks up the true
neighbours of some of its own vectors and sees how far down the ranking they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mixed, stored, without_clashes

# Queries that are ranked by one matrix product: 32 MB of products with a whole shard.
AT_ONCE = 256


@dataclass(frozen=True)
class Settings:
    """Parameters of index and search.

    ``pivots`` bounds the sample: that many vectors, whatever the size of the table. ``near``
    is how many of them represent a vector. The best of each shard's vectors by rho are
    compared exactly: so many that they hold the share ``recall`` of the true neighbours of
    ``probes`` of the shard's vectors, not fewer than the share ``rerank`` of the shard, and
    not fewer than ``least``. Measured recall is in the README. Shards hold about
    ``shard_rows`` vectors and query blocks ``block_rows`` queries.
    """

    pivots: int = 256
    near: int = 128
    rerank: float = 0.05
    least: int = 400
    recall: float = 0.97
    probes: int = 128
    shard_rows: int = 32_768
    block_rows: int = 4096
    neighbours: int = 20
    query_step: int = 20


def valid_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part, stored.

    Not those that are null, zero, or hold null, NaN or infinite components, nor those
    without an id. Where lengths differ, only vectors of the most frequent length take part
    (the smaller of equally frequent ones), because inner products need one length.
    """
    rows = without_clashes(rows, "vec_id", "embedding")
    v = F.col("embedding").cast("array<double>")
    bound = F.lit(float("inf"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < bound))
    some = F.exists("v", lambda x: x != 0)
    rows = rows.select("vec_id", v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = stored(rows.filter(fine).filter(some), "vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (lengths["n"] if lengths else 0))


def classes(vectors: DataFrame, most: int) -> DataFrame:
    """(node, v, ids): equal vectors once, with their ``most`` smallest ids in order, stored.

    More ids than neighbours asked for, and one for the query itself, can never be returned.
    """
    digest = F.sha2(F.to_json("v"), 256)
    rows = vectors.withColumn("digest", digest).dropDuplicates(["digest", "vec_id"])
    place = F.row_number().over(W.partitionBy("digest").orderBy("vec_id"))
    few = rows.withColumn("place", place).filter(F.col("place") <= most)
    found = few.groupBy("digest").agg(
        F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")
    )
    return stored(found.withColumn("node", F.xxhash64("digest")).drop("digest"), "vector-classes")


def pick_pivots(found: DataFrame, settings: Settings) -> np.ndarray:
    """Pivots: the vectors with the smallest hashes, at most ``settings.pivots``."""
    rows = found.orderBy("node").limit(settings.pivots).select("v").collect()
    return np.array([row["v"] for row in rows], float)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first, by angle."""
    unit = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    near = min(near, len(pivots))
    scores = vectors @ unit.T
    chosen = np.argpartition(-scores, near - 1, axis=1)[:, :near]
    order = np.argsort(-np.take_along_axis(scores, chosen, axis=1), axis=1, kind="stable")
    return np.take_along_axis(chosen, order, axis=1)


def weights(places: np.ndarray, n_pivots: int) -> np.ndarray:
    """How far before the end of each permutation every pivot stands, 0 if it is missing.

    All rows have the same squares, so Spearman's rho falls as the product of two rows
    rises. Products are whole numbers, exact in any order of summation.
    """
    near = places.shape[1]
    most = near * (near + 1) * (2 * near + 1) // 6
    out = np.zeros((len(places), n_pivots), np.float32 if most < 2**24 else np.float64)
    np.put_along_axis(out, places, np.arange(near, 0, -1, dtype=out.dtype)[None], axis=1)
    return out


class Shard:
    """The permutations of one shard of vectors."""

    def __init__(self, vectors: np.ndarray, places: np.ndarray, n_pivots: int):
        self.vectors = vectors
        self.weights = weights(places, n_pivots)
        with np.errstate(over="ignore"):
            self.longest = float(np.linalg.norm(vectors, axis=1).max())

    def likeness(self, places: np.ndarray) -> np.ndarray:
        """(queries x vectors): the larger, the smaller rho is."""
        return weights(places, self.weights.shape[1]) @ self.weights.T

    def best(self, places: np.ndarray, count: int) -> Iterator[np.ndarray]:
        """For each query the ``count`` vectors ranked first, and all that tie with the last of them."""
        size = len(self.vectors)
        for at in range(0, len(places), AT_ONCE):
            part = places[at : at + AT_ONCE]
            if count >= size:
                yield from [np.arange(size)] * len(part)
                continue
            likeness = self.likeness(part)
            for row in likeness:
                yield np.flatnonzero(row >= np.partition(row, size - count)[size - count])

    def nearest(self, chosen: np.ndarray, vector: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``count`` + 1 nearest of the chosen and what ties with the last, nearest first; their scores."""
        if len(chosen) > count + 1:
            # Products of another order of summation differ by less than this.
            with np.errstate(over="ignore"):
                slack = 4 * np.finfo(float).eps * len(vector) * np.linalg.norm(vector) * self.longest
            if np.isfinite(slack):
                rough = self.vectors[chosen] @ vector
                least = np.partition(rough, -count - 1)[-count - 1]
                chosen = chosen[rough >= least - slack - np.finfo(float).tiny]
        scores = inner(self.vectors[chosen], vector)
        order = np.argsort(-scores, kind="stable")
        order = order[scores[order] >= scores[order[min(count, len(order) - 1)]]]
        return chosen[order], scores[order]

    def enough(self, places: np.ndarray, probes: np.ndarray, settings: Settings) -> int:
        """How many of the first ranked hold ``settings.recall`` of the probes' true neighbours."""
        few = min(settings.neighbours, len(self.vectors) - 1)
        ranks = []
        for probe, likeness in zip(probes, self.likeness(places[probes]), strict=True):
            scores = self.vectors @ self.vectors[probe]
            scores[probe] = -np.inf
            true = np.argpartition(-scores, few - 1)[:few]
            ranks.append(np.searchsorted(np.sort(-likeness), -likeness[true], "right"))
        return int(np.quantile(np.concatenate(ranks), settings.recall, method="higher"))


def search(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(query_id, rank, vec_id, score): for each query the nearest vectors found.

    Queries are the rows whose id is divisible by ``query_step``; candidates are all rows
    but those with the query's own id. Nearness is the largest inner product in double
    precision, ties go to the smaller id. All vectors are indexed, in shards by hash; every
    block of queries meets every shard, and the best of the shards are merged per query.
    """
    vectors = valid_vectors(rows)
    found = classes(vectors, settings.neighbours + 1)
    pivots = pick_pivots(found, settings)
    n_shards = max(1, -(-found.count() // settings.shard_rows))
    queries = vectors.filter(F.col("vec_id") % settings.query_step == 0).dropDuplicates(["vec_id", "v"])
    n_blocks = max(1, -(-queries.count() // settings.block_rows))

    def dealt(key, n):
        return F.pmod(F.xxhash64(key, F.lit("deal")), F.lit(n)).cast("int")

    shards = found.withColumn("shard", dealt("node", n_shards))
    shards = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    shards = shards.select("shard", "block", F.lit(None).cast("long").alias("query_id"), "v", "ids")
    blocks = queries.withColumn("block", dealt("vec_id", n_blocks))
    blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    blocks = blocks.select("shard", "block", F.col("vec_id").cast("long").alias("query_id"), "v", F.lit(None).cast(found.schema["ids"].dataType).alias("ids"))

    def run(batches):
        def finish(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            asked = np.array(table.column("ids").is_null())
            width = pivots.shape[1]
            every = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)
            base, wanted = every[~asked], every[asked]
            if not len(base) or not len(wanted):
                return
            ids = table.column("ids").filter(pa.array(~asked)).to_pylist()
            names = table.column("query_id").filter(pa.array(asked)).to_pylist()
            places = nearest_pivots(base, pivots, settings.near)
            shard = Shard(base, places, len(pivots))
            count = max(settings.least, int(np.ceil(settings.rerank * len(base))))
            if count < len(base):
                # By the ids, not by the order in which rows arrive.
                lots = mixed(np.array([one[0] for one in ids], np.int64).view(np.uint64))
                probes = np.argsort(lots, kind="stable")[: settings.probes]
                count = max(count, shard.enough(places, probes, settings))
            out: list[list] = [[], [], []]
            ranked = shard.best(nearest_pivots(wanted, pivots, settings.near), count)
            for name, vector, chosen in zip(names, wanted, ranked, strict=True):
                near, scores = shard.nearest(chosen, vector, settings.neighbours)
                pairs = [(-score, vec_id) for i, score in zip(near, scores, strict=True) for vec_id in ids[i] if vec_id != name]
                for score, vec_id in sorted(pairs)[: settings.neighbours]:
                    for column, value in zip(out, (name, vec_id, -score), strict=True):
                        column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

        parts, current = [], None
        for batch in batches:
            key = batch.column("shard").to_numpy().astype(np.int64) * n_blocks + batch.column("block").to_numpy()
            for value in np.unique(key):
                if parts and value != current:
                    yield from finish(parts)
                    parts = []
                current = value
                parts.append(batch.filter(pa.array(key == value)))
        if parts:
            yield from finish(parts)

    met = shards.unionByName(blocks).repartition(n_shards * n_blocks, "shard", "block")
    hits = met.sortWithinPartitions("shard", "block").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = hits.distinct().withColumn("rank", rank.cast("int"))
    return best.filter(F.col("rank") <= settings.neighbours).select("query_id", "rank", "vec_id", "score")


def inner(vectors: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products summed component by component in order, the same for every shard."""
    total = np.zeros(len(vectors))
    for at in range(len(vector)):
        total += vectors[:, at] * vector[at]
    return total
