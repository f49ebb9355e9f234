"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct five-word shingles. Equal sets are one node. Of every
node, minima under 256 permutations are taken; their full values make the band keys, and only
their lowest two bits are kept, packed into eight longs. Candidates share a band. Two packed
signatures agree in a share of their positions, of which a quarter is chance; corrected for
that, the share estimates the similarity, and pairs that it rules out are not compared. All
others are confirmed on their full sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .banding import BAND_ROWS, band_keys, bucket_links, indexed_across, linked, local_stars
from .common import (
    long_lists,
    map_batches,
    multipliers,
    only_ids,
    raw_texts,
    stored,
    without_clashes,
    word_hashes,
    word_shingles,
)


@dataclass(frozen=True)
class Settings:
    """Parameters of the search.

    A pair at the threshold 0.75 is missed by all bands with a probability of 3.5e-6, one at
    0.8 with 6e-9. ``slack`` is by how much an estimate may fall below the threshold before
    its pair is ruled out; 0.2 is six standard deviations. Sets of fewer than ``few``
    shingles have no estimate, because the low bits of their minima agree by less than chance
    for some pairs; they are compared in full.
    """

    shingle: int = 5
    percent: int = 75
    bands: int = 64
    rows: int = 6
    minima: int = 256
    slack: float = 0.2
    few: int = 32


PACKED = 8  # longs of a signature: 256 minima of 2 bits
LOW_BITS = 0x5555555555555555
# Shingles of the sets of a bucket that a task compares together.
BLOCK_SHINGLES = 500_000


def set_node(shingles: np.ndarray) -> int:
    """Identity of a set: a 64-bit digest of its sorted shingles."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def minima_of(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest value of the set under each permutation, as 32-bit numbers."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 256):
        np.minimum(least, (short[at : at + 256, None] * factors).min(axis=0), out=least)
    return least


def packed(minima: np.ndarray) -> np.ndarray:
    """The two lowest bits of each minimum, 32 minima to a long."""
    low = (minima & np.uint32(3)).astype(np.uint64).reshape(-1, 32)
    return np.bitwise_or.reduce(low << (np.uint64(2) * np.arange(32, dtype=np.uint64)), axis=1)


def document_sets(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, n_shingles, node) of every row; the node of an empty set is null."""

    def start():
        known = word_hashes()

        def work(batch):
            sizes, nodes = [], []
            for text in raw_texts(batch.column("text")):
                shingles = word_shingles(text, known, settings.shingle)
                sizes.append(len(shingles))
                nodes.append(set_node(shingles) if len(shingles) else None)
            signed = pa.array(nodes, pa.uint64()).view(pa.int64())
            keys = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield [*keys, pa.array(sizes, pa.int64()), signed]

        return work

    schema = StructType([f for f in docs.schema if f.name != "text"])
    keys = docs.select(*schema.fieldNames(), "text")
    return map_batches(keys, start, schema.add("n_shingles", "long").add("node", "long"))


def band_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    """Band rows of all documents, reduced per batch."""

    def start():
        known, factors = word_hashes(), multipliers(settings.bands * settings.rows)

        def work(batch):
            minima, nodes = [], []
            seen = set()
            for text in raw_texts(batch.column(0)):
                shingles = word_shingles(text, known, settings.shingle)
                if not len(shingles) or (node := set_node(shingles)) in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                minima.append(minima_of(shingles, factors))
            if nodes:
                keys = band_keys(np.array(minima).T, settings.bands, settings.rows)
                yield local_stars(keys, np.array(nodes, np.uint64))

        return work

    return map_batches(without_clashes(docs, "text"), start, BAND_ROWS)


def full_sets(docs: DataFrame, settings: Settings) -> DataFrame:
    """(node, shingles, signature) of documents, one row per node; small sets have no signature."""

    def start():
        known, factors = word_hashes(), multipliers(settings.minima)

        def work(batch):
            found = {}
            for text in raw_texts(batch.column(0)):
                shingles = word_shingles(text, known, settings.shingle)
                if len(shingles):
                    found.setdefault(set_node(shingles), shingles)
            if found:
                nodes = np.fromiter(found, np.uint64, len(found)).view(np.int64)
                signatures = [packed(minima_of(s, factors)) for s in found.values()]
                sets = list(found.values())
                yield [
                    pa.array(nodes),
                    long_lists(np.concatenate(sets), [len(s) for s in sets]),
                    long_lists(np.concatenate(signatures), [PACKED] * len(sets)),
                ]

        return work

    schema = "node long, shingles array<long>, signature array<long>"
    rows = map_batches(without_clashes(docs, "text"), start, schema)
    signature = F.when(F.size(F.first("shingles")) >= settings.few, F.first("signature"))
    return rows.groupBy("node").agg(F.first("shingles").alias("shingles"), signature.alias("signature"))


def estimate(one: str, two: str, bits: int = 2) -> Column:
    """Similarity of two packed signatures, corrected for chance agreement."""
    differing = F.lit(0)
    for at in range(PACKED):
        apart = F.col(one)[at].bitwiseXOR(F.col(two)[at])
        either = apart.bitwiseOR(F.shiftrightunsigned(apart, 1)).bitwiseAND(F.lit(LOW_BITS))
        differing = differing + F.bit_count(either)
    agreeing = 1 - differing / (PACKED * 32)
    chance = 2.0**-bits
    return (agreeing - chance) / (1 - chance)


def closeness(settings: Settings):
    """For ``indexed_across``: the members of a bucket that ``estimate`` does not rule out."""

    def close(columns):
        column = columns["signature"]
        known = column.is_valid().to_numpy(zero_copy_only=False)
        packs = np.zeros((len(column), PACKED), np.uint64)
        packs[known] = column.drop_null().flatten().to_numpy().view(np.uint64).reshape(-1, PACKED)
        least = settings.percent / 100 - settings.slack

        def may(at):
            if not known[at]:
                return np.ones(len(packs), bool)
            apart = packs ^ packs[at]
            either = (apart | (apart >> np.uint64(1))) & np.uint64(LOW_BITS)
            agreeing = 1 - np.bitwise_count(either).sum(axis=1) / (PACKED * 32)
            return ((agreeing - 0.25) / 0.75 >= least) | ~known

        return may

    return close


def list_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a column of lists, and how many each has."""
    return column.flatten().to_numpy(), pc.list_value_length(column).to_numpy()


def document_groups(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """The set of every row of ``docs`` (doc_id, text, other keys), and per node its component.

    Returns (keys, n_shingles, node) and (node, least, component), both stored: ``least`` is
    the smallest doc_id of the node, ``component`` a node that names all linked ones.
    """
    sets = stored(document_sets(docs, settings), "sets")
    nodes = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    nodes = stored(nodes, "nodes")
    buckets = bucket_links(band_rows(docs, settings))

    # One text per node of a bucket; texts without an id cannot be told by it.
    members = buckets.select(F.col("a").alias("node")).union(buckets.select(F.col("b").alias("node")))
    wanted = nodes.join(members, "node", "left_semi").select(F.col("least").alias("doc_id"))
    wanted = stored(wanted.filter("doc_id IS NOT NULL").distinct(), "candidates")
    candidates = only_ids(docs.select("doc_id", "text"), wanted, "doc_id")
    unnamed = docs.filter("doc_id IS NULL").select("doc_id", "text")
    full = stored(full_sets(candidates.unionByName(unnamed), settings), "shingles")

    def with_both(pairs, column):
        for side in ("a", "b"):
            named = full.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}"))
            pairs = pairs.join(named, side)
        return pairs

    def confirm(pairs):
        close = estimate("signature_a", "signature_b") >= settings.percent / 100 - settings.slack
        likely = with_both(pairs, "signature").filter(F.coalesce(close, F.lit(True))).select("a", "b")
        both = with_both(likely, "shingles")
        shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
        union = F.size("shingles_a") + F.size("shingles_b") - shared
        return both.filter(100 * shared >= settings.percent * union).select("a", "b")

    items = full.select("node", F.col("shingles").alias("item"), F.size("shingles").alias("entries"), "signature")
    across = indexed_across(items, list_sets, settings.percent, BLOCK_SHINGLES, closeness(settings))
    groups = linked(buckets, confirm, across)
    named = nodes.join(groups, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    return sets, stored(named, "node-groups")


def near_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, n_shingles, component_id, kept) of every row.

    ``component_id`` is the smallest doc_id reached by links, its own included; ``kept``
    says whether that is its own. Texts that are null or have no word are linked with
    nothing. Rows without a doc_id take part like others; their component_id is null where
    no row with an id is linked to them. Rows that repeat a doc_id share a component only
    if their texts are linked. Extra columns are left out.
    """
    sets, named = document_groups(without_clashes(docs, "doc_id", "text"), settings)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = stored(named.join(ids, "component").select("node", "component_id"), "components")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return sets.join(ids, "node", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def kept_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """One row of ``docs`` per component, all columns included, and all rows without words.

    The row with the smallest doc_id stays, null ids last; of rows that repeat that id, the
    first as read. ``docs`` must be stored, so that its rows come in the same order each time.
    """
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    sets, named = document_groups(numbered.select("doc_id", "__row", "text"), settings)
    rows = sets.join(named.select("node", "component"), "node", "left")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")
    first = rows.filter("node IS NOT NULL").groupBy("component").agg(F.min(place).alias("first"))
    keep = first.select("first.__row").union(rows.filter("node IS NULL").select("__row"))
    return only_ids(numbered, stored(keep, "kept"), "__row").select(*docs.columns)
