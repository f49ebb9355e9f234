"""Exact top-k by inner product with a three-phase uniform threshold.

Vectors are cut into lists: every list holds some of the components and so a part of every
score. First each list gathers its best parts; the whole scores of what they name give, per query,
a score that k vectors are known to reach. This cutoff is sent back to all lists. A vector
whose part stays below cutoff / lists in every list stays below the cutoff as a whole, so,
second, each list hands over only entries from there on. Third, the parts of these that
other lists have not handed over are looked up, and whole scores decide. Nothing is approximate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, without_clashes

EXACT_DOUBLE = 1 << 53
LONG = 1 << 63


@dataclass(frozen=True)
class Settings:
    """``best`` vectors per query; queries are ids divisible by ``query_step``.

    Components are multiplied by ``scale`` and rounded down. A task holds the lists of about
    ``shard_rows`` vectors and scores so many queries at a time that ``cells`` parts are held.
    In the first phase all lists together name about ``heads`` times ``best`` vectors of a list.
    """

    best: int = 20
    query_step: int = 20
    scale: int = 64
    lists: int = 2
    heads: int = 5
    shard_rows: int = 65_536
    cells: int = 1 << 22


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of the vectors that take part, stored.

    Not those that are null, empty, without an id, or with null, NaN or infinite components.
    Where lengths differ, only vectors of the most frequent length take part (the smaller of
    equally frequent ones). Components beyond 64 bits are held at the ends of that range.
    """
    rows = without_clashes(rows, "vec_id", "embedding")
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine)
    whole = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    rows = stored(rows.select("vec_id", whole.alias("v")), "vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (lengths["n"] if lengths else 0))


def arithmetic(one: np.ndarray, two: np.ndarray):
    """The narrowest number type that holds every inner product of these rows exactly."""
    most = max(1, int(np.abs(one.astype(float)).max(initial=0)) + 1) * max(1, int(np.abs(two.astype(float)).max(initial=0)) + 1)
    bound = most * one.shape[1]
    return np.float64 if bound < EXACT_DOUBLE else np.int64 if bound < LONG else object


class Lists:
    """The lists of one shard: component ranges of its vectors, and their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lists: int):
        self.ids, self.vectors = ids, vectors
        self.cuts = [part for part in np.array_split(np.arange(vectors.shape[1]), lists) if len(part)]

    def parts(self, queries: np.ndarray) -> list[np.ndarray]:
        """Per list the part of every score, (queries, vectors)."""
        kind = arithmetic(self.vectors, queries)
        return [queries[:, cut].astype(kind) @ self.vectors[:, cut].astype(kind).T for cut in self.cuts]


def heads_of(shard: Lists, parts: list[np.ndarray], at: int, name: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase one: (ids, whole scores) of each list's best parts for one query."""
    other = shard.ids != name
    chosen = set()
    for part in parts:
        row = np.where(other, part[at], -np.inf) if part.dtype == float else np.where(other, part[at], part[at].min() - 1)
        few = min(count, len(row))
        chosen.update(np.argpartition(row, len(row) - few)[len(row) - few :].tolist())
    places = np.array(sorted(p for p in chosen if other[p]), int)
    return shard.ids[places], sum(part[at][places] for part in parts)


def above(shard: Lists, parts: list[np.ndarray], at: int, name: int, cutoff, best: int):
    """Phases two and three: (ids, whole scores) of the shard's best that reach the cutoff."""
    other = shard.ids != name
    if cutoff == -LONG:  # held there, the true one may be less
        cutoff = None
    if cutoff is None:
        places = np.flatnonzero(other)
    else:
        sent = np.zeros(len(other), bool)
        for part in parts:
            sent |= part[at] * len(parts) >= cutoff
        places = np.flatnonzero(sent & other)
    scores = sum(part[at][places] for part in parts)
    ids = shard.ids[places]
    if cutoff is not None:
        ids, scores = ids[scores >= cutoff], scores[scores >= cutoff]
    if scores.dtype == object:
        scores = np.array([max(-LONG, min(LONG - 1, score)) for score in scores], np.int64)
    # Ascending order of the complement is descending order, without an overflow at the ends.
    order = np.lexsort((ids, ~scores if scores.dtype == np.int64 else -scores))
    ids, scores = ids[order], scores[order]
    first = np.zeros(len(ids), bool)
    first[np.unique(ids, return_index=True)[1]] = True  # the best row of an id that repeats
    return ids[first][:best], scores[first][:best]


def scan(vectors: DataFrame, queries: DataFrame, shards: int, settings: Settings, heads: int | None) -> DataFrame:
    """(query_id, vec_id, score) that every shard finds: with ``heads`` phase one, else the others.

    Vectors are dealt to shards once; the queries, with their cutoffs, come by all of them.
    """
    spread = F.pmod(F.xxhash64("vec_id", F.lit("deal")), F.lit(shards)).cast("int")
    base = vectors.select(spread.alias("shard"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(None).cast("long").alias("cutoff"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = queries.select(every.alias("shard"), F.lit(True).alias("asks"), "vec_id", "v", "cutoff")
    names = ["query_id", "vec_id", "score"]

    def answers(shard: Lists, ids: list, rows: np.ndarray, cutoffs: list):
        step = max(1, settings.cells // max(1, len(shard.ids)))
        for first in range(0, len(ids), step):
            parts = shard.parts(rows[first : first + step])
            out: list[list] = [[], [], []]
            for at, name in enumerate(ids[first : first + step]):
                if heads:
                    found, scores = heads_of(shard, parts, at, name, heads)
                else:
                    found, scores = above(shard, parts, at, name, cutoffs[first + at], settings.best)
                out[0] += [name] * len(found)
                out[1] += found.tolist()
                out[2] += [max(-LONG, min(LONG - 1, int(score))) for score in scores]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in out], names)

    def run(batches):
        held, shard, current = [], None, None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            for value in np.unique(numbers):
                part = batch.filter(pa.array(numbers == value))
                if value != current:
                    held, shard, current = [], None, value
                asks = np.array(part.column("asks"))
                mine = part.filter(pa.array(~asks))
                if mine.num_rows:
                    held.append((mine.column("vec_id").to_numpy(), flat(mine)))
                wanted = part.filter(pa.array(asks))
                if wanted.num_rows and held and shard is None:
                    shard = Lists(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), settings.lists)
                if wanted.num_rows and shard is not None:
                    yield from answers(shard, wanted.column("vec_id").to_pylist(), flat(wanted), wanted.column("cutoff").to_pylist())

    met = base.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks")
    return met.mapInArrow(run, "query_id long, vec_id long, score long")


def flat(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


def top_scores(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(query_id, rank, vec_id, score): for each query the vectors of the largest integer inner product.

    Queries are the rows whose id is divisible by ``query_step``, candidates all rows with another
    id; all of them where there are fewer than ``best``. Ties go to the smaller id. Vectors without an
    id or with components that are null or not finite take no part, vectors of zeros do. Rows
    that repeat count once; of several vectors under one id the best score counts. Further
    columns are not looked at, and an empty table gives no rows. Scores beyond 64 bits are held
    at the ends of that range and tie there.
    """
    kind = rows.schema["vec_id"].dataType
    vectors = integer_vectors(rows, settings.scale).withColumn("vec_id", F.col("vec_id").cast("long"))
    asked = vectors.filter(F.col("vec_id") % settings.query_step == 0)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(cores, -(-vectors.count() // settings.shard_rows))
    heads = -(-settings.heads * settings.best // shards)
    unlimited = asked.withColumn("cutoff", F.lit(None).cast("long"))
    named = scan(vectors, unlimited, shards, settings, heads)
    named = named.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    cutoffs = named.withColumn("place", place).filter(F.col("place") <= settings.best).filter(F.col("place") == settings.best)
    cutoffs = stored(cutoffs.select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff")), "cutoffs")
    found = scan(vectors, asked.join(cutoffs, "vec_id", "left"), shards, settings, None)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= settings.best)
    return ranked.select(F.col("query_id").cast(kind), "rank", F.col("vec_id").cast(kind), "score")
