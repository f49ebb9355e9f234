"""A Merkle manifest of a table by time-forward processing.

Nodes are labelled (source, level, index). Digests travel as messages to the parent's label
and wait in a priority queue ordered by label until the parent is due; it then hashes what
has arrived and sends its own digest on. The queue is external: a task runs the part of it that
lies inside one block of 16^3 leaves, and what leaves a block is a stored message, delivered to the
next round by a range sort on the label. A reversed sweep sends every node the suffix of its
proof, the siblings on the way from its parent to the root, down to the leaves.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running_total
from .common import stored, without_clashes

FAN = 16
HEIGHT = 3
BLOCK = FAN**HEIGHT
TAMPERED_OF = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(column: Column) -> Column:
    """A value with its length in bytes, so that neighbouring values cannot run into each other."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(c)) for c in FIELDS[:-1]], field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(source, index, digest, doc_id, changed) per row, in order of source and doc_id, stored.

    ``changed`` is the digest of the tampered row where one is due, else null.
    """
    rows = without_clashes(docs, *FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED_OF == 0
    lowered = F.translate("text", LETTERS, LETTERS.lower())
    rows = rows.select(
        "source", "doc_id", leaf_digest(F.col("text")).alias("digest"),
        F.when(tampered, leaf_digest(lowered)).alias("changed"),
    )
    placed = running_total(rows, ["source"], ["doc_id", "digest"], F.lit(1), "place")
    return stored(placed.withColumn("index", F.col("place") - 1).drop("place"), "leaves")


def forward(digests: list[str], height: int) -> tuple[dict, dict]:
    """Run the queue over one block: (children by label, label of each node's parent's digest).

    Labels are (level, index). A block ends after ``height`` levels.
    """
    queue = [((1, at // FAN), at % FAN, one) for at, one in enumerate(digests)]
    children, made = defaultdict(list), {}
    if height == 0:
        return children, made
    heapq.heapify(queue)
    while queue:
        label = queue[0][0]
        while queue and queue[0][0] == label:
            children[label].append(heapq.heappop(queue)[2])
        made[label] = digest(children[label])
        if label[0] < height:
            heapq.heappush(queue, ((label[0] + 1, label[1] // FAN), label[1] % FAN, made[label]))
    return children, made


def levels_of(rows: int, first: bool) -> int:
    """Levels inside a block. The only block of a source ends at the level with one node.

    Indexes have no gaps, so a first block that is not full is the only one; a full one ends at
    one node either way.
    """
    if not first:
        return HEIGHT
    levels = 0
    while rows > 1:
        rows, levels = -(-rows // FAN), levels + 1
    return levels


def by_block(batches) -> Iterator[list[dict]]:
    """Rows of one (source, block) after another from sorted batches."""
    part, current = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["source"], row["block"])
            if part and key != current:
                yield part
                part = []
            current = key
            part.append(row)
    if part:
        yield part


def delivered(messages: DataFrame) -> DataFrame:
    """Messages in the order of the labels they go to; a block lies in one task."""
    return messages.repartitionByRange("source", "block").sortWithinPartitions("source", "block", "index")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Nodes (source, index, digest) of every round, from the given ones to one per source."""
    rounds = [nodes]
    names = ["source", "index", "digest"]

    def run(batches):
        for part in by_block(batches):
            height = levels_of(len(part), part[0]["block"] == 0)
            _, made = forward([row["digest"] for row in part], height)
            top = made[height, 0] if height else part[0]["digest"]
            columns = [[part[0]["source"]], [part[0]["block"]], [top]]
            kinds = (pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    while (rounds[-1].agg(F.max("index")).first()[0] or 0) > 0:
        due = rounds[-1].select("source", F.floor(F.col("index") / BLOCK).alias("block"), "index", "digest")
        above = delivered(due).mapInArrow(run, "source string, index long, digest string")
        rounds.append(stored(above, "nodes"))
    return rounds


PROOF = "left array<string>, right array<string>, subroot string"


def paths(part: list[dict]) -> Iterator[tuple[dict, list[str], list[str], str]]:
    """(row, left siblings, right siblings, subroot) of a block's nodes, by the reversed sweep.

    The part starts with the message from above (index -1). Siblings are joined per level, the
    node's own level first.
    """
    above, rows = part[0], part[1:]
    height = levels_of(len(rows), above["block"] == 0)
    children, _ = forward([row["digest"] for row in rows], height)
    suffix = {(height, 0): (above["left"], above["right"])}
    for label in reversed(children):
        left, right = suffix.pop(label)
        run = children[label]
        for place in range(len(run)):
            own = "".join(run[:place]), "".join(run[place + 1 :])
            suffix[label[0] - 1, label[1] * FAN + place] = [own[0], *left], [own[1], *right]
    for at, row in enumerate(rows):
        yield row, *suffix[0, at], above["subroot"]


def meeting(nodes: DataFrame, above: DataFrame, *extra: str) -> DataFrame:
    """Nodes and, before those of each block, the message for the block."""
    rows = nodes.select("source", F.floor(F.col("index") / BLOCK).alias("block"), "index", "digest", *extra)
    above = above.select("source", F.col("index").alias("block"), F.lit(-1).cast("long").alias("index"), "left", "right", "subroot")
    return delivered(rows.unionByName(above, allowMissingColumns=True))


def descend(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """Proof suffixes of the first round's blocks, from those of the last round's nodes."""
    names = ["source", "index", "left", "right", "subroot"]
    kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())

    def run(batches):
        for part in by_block(batches):
            out = [(row["source"], row["index"], left, right, subroot) for row, left, right, subroot in paths(part)]
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for nodes in reversed(rounds[1:-1]):
        top = stored(meeting(nodes, top).mapInArrow(run, f"source string, index long, {PROOF}"), "suffixes")
    return top


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``docs``.

    The leaf hashes doc_id, source, lang, n_chars and text. Per source, leaves ascend by doc_id
    (a null first, then by digest where ids are equal), and every 16 neighbours become a node until
    one is left; a lone leaf is the subroot. Subroots in the order of their sources (null first)
    likewise give the root. ``proof_sha256`` hashes the siblings from leaf to root. Rows whose id's
    CRC-32 divides by 5 are tampered with by lower-casing A-Z; ``folded_root`` is recomputed from
    the tampered leaf, else from the leaf. Ids without a value are not tampered with. Rows that
    repeat are leaves of their own, texts may be of any length, further columns are not looked
    at, and an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType
    bottom = leaves(docs)
    rounds = climb(bottom.select("source", "index", "digest"))
    subroots = rounds[-1].select("source", "digest")
    placed = running_total(subroots, [], ["source"], F.lit(1), "place")
    tops = stored(
        placed.select(F.lit("").alias("source"), (F.col("place") - 1).alias("index"), "digest", F.col("source").alias("name")),
        "subroots",
    )
    top_rounds = climb(tops.select("source", "index", "digest"))
    last = top_rounds[-1].first()
    root = last["digest"] if last else None
    none = F.array().cast("array<string>")
    start = top_rounds[-1].select("source", "index", none.alias("left"), none.alias("right"), F.lit("").alias("subroot"))

    def to_sources(batches):
        for part in by_block(batches):
            out = [(row["name"], 0, left, right, row["digest"]) for row, left, right, _ in paths(part)]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            names = ["source", "index", "left", "right", "subroot"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def to_leaves(batches):
        for part in by_block(batches):
            out = []
            for row, left, right, subroot in paths(part):
                proof = digest(side for pair in zip(left, right, strict=True) for side in pair)
                ends = zip(left, right, strict=True)
                folded = reduce(lambda own, run: digest((run[0], own, run[1])), ends, row["changed"] or row["digest"])
                out.append((row["doc_id"], row["digest"], subroot, root, proof, folded, folded == root))
            kinds = [pa.string()] * 6 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], result)

    result = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    schema = f"source string, index long, {PROOF}"
    # With one round the nodes are single already and the message goes straight to them.
    if len(top_rounds) == 1:
        top = tops.select(F.col("name").alias("source"), F.lit(0).cast("long").alias("index"), none.alias("left"), none.alias("right"), F.col("digest").alias("subroot"))
    else:
        above = descend(top_rounds, start)
        top = stored(meeting(tops, above, "name").mapInArrow(to_sources, schema), "suffixes")
    named = bottom.withColumn("doc_id", F.col("doc_id").cast("string"))
    above = descend(rounds, top) if len(rounds) > 1 else top
    shape = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    proofs = meeting(named, above, "doc_id", "changed").mapInArrow(to_leaves, shape)
    return proofs.withColumn("doc_id", F.col("doc_id").cast(kind))
