"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target in words and a weight schedule over training time 0..1. The words
of a source are laid one after another in a random but fixed order, again from the start
when they run out. The integral of the schedule says which part of the target training has
used at a time; its inverse gives each document its position. Documents are then sorted
over the whole mix by position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running_total
from ..operators.skew import attach
from .common import stored, without_clashes

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2


@dataclass(frozen=True)
class Schedule:
    """Relative weight of a source over time, linear between knots (time, weight).

    Times go from 0 to 1 and weights are at least 0 with a positive integral. Only the shape
    counts: the integral is scaled to the target.
    """

    knots: tuple[tuple[float, float], ...]

    def pieces(self) -> list[tuple[float, float, float, float, float]]:
        """(share before, share after, start, weight at start, slope) of each piece."""
        spans = list(zip(self.knots, self.knots[1:], strict=False))
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in spans]
        whole, before, out = sum(areas), 0.0, []
        for ((t0, w0), (t1, w1)), area in zip(spans, areas, strict=True):
            out.append((before / whole, (before + area) / whole, t0, w0 / whole, (w1 - w0) / (t1 - t0) / whole))
            before += area
        return out

    def time_of(self, share: Column) -> Column:
        """The time at which this share of the target has been used."""
        result = F.lit(self.knots[-1][0])
        for before, after, start, weight, slope in reversed(self.pieces()):
            rest = share - before
            # The root of slope / 2 * x^2 + weight * x = rest, in a form without cancellation.
            root = F.sqrt(F.greatest(F.lit(0.0), weight * weight + 2 * slope * rest))
            x = F.when(weight + root > 0, 2 * rest / (weight + root)).otherwise(F.lit(0.0))
            result = F.when(share <= after, start + F.greatest(F.lit(0.0), x)).otherwise(result)
        return result


# Heavy sources fade out, light ones come in late, the others stay level.
SCHEDULES = (
    Schedule(((0.0, 1.5), (1.0, 0.5))),
    Schedule(((0.0, 1.0), (1.0, 1.0))),
    Schedule(((0.0, 0.25), (0.5, 1.0), (1.0, 1.75))),
)


def word_count(text: str = "text") -> Column:
    """Runs of characters other than space and U+0009-U+000D; 0 for null."""
    spaced = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(spaced, " \t\n\x0b\x0c\r", "")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_REPEATS) -> DataFrame:
    """(source, source_size, place, target) from (source, size).

    Sources in the order of their code points, null last, weigh ``weights`` in turn and
    share ``share`` times all words; no target exceeds ``most`` times its source, and what
    is above is shared again by weight until none is. ``share`` must be at most ``most``.
    Two numbers per round reach the driver; a round stops at least one more source.
    """
    if share > most:
        raise ValueError("the mix is larger than all sources may fill")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_total(
        sources.withColumn("last", F.col("source").isNull()), [], ["last", "source"], F.lit(1), "place"
    )
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = stored(ranked.drop("last").withColumn("weight", turn), "sources")
    limit = F.col("source_size") * float(most)
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        full = limit <= level * F.col("weight") if stopped >= 0 else F.lit(False)
        row = ranked.agg(
            F.count_if(full).alias("n"),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).alias("filled"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if row["n"] == stopped or not row["open"]:
            break
        stopped, level = row["n"], (total - row["filled"]) / row["open"]
    target = F.least(limit, level * F.col("weight")) if stopped >= 0 else F.lit(0.0)
    return ranked.select("source", "source_size", "place", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_REPEATS, schedules=SCHEDULES, keep=()) -> DataFrame:
    """One row per document with what the mix takes of it, sorted by training position.

    Returns (doc_id, source, size, source_size, target, taken, position, visits, ``keep``).
    ``visits`` lists (pass, words, position): every pass takes whole documents in an order
    by hash, and the document at which the target is met is cut to the words left, so the
    words taken of a source equal its target rounded down. Position is the training time 0..1 at which
    the first word of the first pass is due; documents that are not taken come last and
    have none. Nulls in any column are allowed; rows that repeat are taken one by one.
    Schedules are given to sources in turn.
    """
    extra = [column for column in keep if column not in ("doc_id", "source")]
    rows = without_clashes(docs, "doc_id", "source", "text", *extra)
    rows = rows.select("doc_id", "source", word_count().alias("size"), *extra)
    rows = stored(rows.withColumn("shuffled", F.xxhash64("doc_id", F.lit("order"))), "sizes")
    targets = source_targets(rows, weights, share, most)
    placed = running_total(rows, ["source"], ["shuffled", "doc_id"], F.col("size"), "end")
    placed = placed.withColumn("group", F.coalesce(F.col("source"), F.lit("")))
    placed = placed.withColumn("none", F.col("source").isNull())
    named = targets.withColumn("group", F.coalesce(F.col("source"), F.lit("")))
    named = named.withColumn("none", F.col("source").isNull()).drop("source")
    counts = placed.groupBy("group", "none").agg(F.count("*").alias("rows"))
    joined = attach(placed, named, ["group", "none"], ["doc_id", "shuffled"], counts=counts)

    goal = F.floor("target")
    visits = []
    for number in range(most):
        first = F.col("end") - F.col("size") + number * F.col("source_size")
        words = F.least(F.col("size"), F.greatest(F.lit(0), goal - first))
        share_used = F.when(F.col("target") > 0, first / F.col("target")).otherwise(F.lit(0.0))
        turn = F.pmod(F.col("place") - 1, F.lit(len(schedules)))
        position = schedules[-1].time_of(share_used)
        for at, schedule in reversed(list(enumerate(schedules[:-1]))):
            position = F.when(turn == at, schedule.time_of(share_used)).otherwise(position)
        visit = F.struct(F.lit(number).alias("pass"), words.alias("words"), position.alias("position"))
        visits.append(visit)
    taken = joined.withColumn("visits", F.filter(F.array(*visits), lambda v: v["words"] > 0))
    total = F.aggregate("visits", F.lit(0).cast("long"), lambda a, v: a + v["words"])
    chosen = taken.select(
        "doc_id", "source", "size", "source_size", "target", total.alias("taken"),
        F.get("visits", F.lit(0))["position"].alias("position"), "visits", *extra,
    )
    late = F.coalesce(F.col("position"), F.lit(2.0))
    return chosen.withColumn("due", late).repartitionByRange("due", "doc_id").sortWithinPartitions("due", "doc_id").drop("due")


def training_order(mixed: DataFrame) -> DataFrame:
    """A row per visit (doc_id, pass, words, position, other columns), sorted by position."""
    other = [c for c in mixed.columns if c not in ("visits", "position", "taken", "size", "source_size", "target")]
    rows = mixed.select(*other, F.explode("visits").alias("visit"))
    rows = rows.select(*other, "visit.pass", "visit.words", "visit.position")
    return rows.repartitionByRange("position", "doc_id", "pass").sortWithinPartitions("position", "doc_id", "pass")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` in training order, every row as often as the mix visits it, all columns.

    Whole documents are returned: the one at which a source's target is met goes in if at
    least half of its words are due, so a source differs from its target by less than a
    document. Documents without words are in no mix and go. Extra columns stay; no column
    may be called ``__document``.
    """
    numbered = docs.withColumn("__document", F.monotonically_increasing_id())
    mixed = mix(numbered, keep=("__document",), **settings).select(
        "doc_id", "size", F.explode("visits").alias("visit"), "__document"
    )
    due = mixed.filter(2 * F.col("visit.words") >= F.col("size")).select(
        "__document", F.col("visit.pass").alias("__pass"), F.col("visit.position").alias("__position")
    )
    rows = numbered.join(stored(due, "visits"), "__document")
    sort = ["__position", "doc_id", "__document", "__pass"]
    return rows.repartitionByRange(*sort).sortWithinPartitions(*sort).select(*docs.columns)
