"""Candidate links from bands of minima, without emitting all pairs of a bucket.

A bucket is a band key and the nodes that have it. Each task first links the nodes of a
bucket that it sees together to the smallest of them. Its entries (key, node, smallest node)
are sorted by key and sent in runs, one row per batch and range of keys, so that the shuffle
moves few rows. After it the smallest nodes of a bucket are linked to the least of all. Links
keep their key, so the whole bucket can be told from them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_1, STEP, mixed, stored
from .graph import components

BAND_ROWS = "part int, entries binary"
# Keys are dealt into 2^12 ranges, of which a task holds one at a time.
PART_BITS = 12
# Entries of a range, 24 bytes each, that are held before they are reduced to one a bucket.
MOST_ENTRIES = 2_000_000
# Sets times entries of a bucket up to which a table of both is filled in.
DENSE_CELLS = 1_000_000
# Text whose shingles a task makes at once.
PIECE_BYTES = 2_000_000


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Keys of ``bands`` disjoint runs of ``rows`` minima; ``minima`` is minima x nodes."""
    keys = np.empty((bands, minima.shape[1]), np.uint64)
    for band in range(bands):
        key = np.full(minima.shape[1], (band + 1) * int(STEP) % 2**64, np.uint64)
        for row in minima[band * rows : (band + 1) * rows]:
            key = (key ^ row.astype(np.uint64)) * MIX_1
            key ^= key >> np.uint64(29)
        keys[band] = mixed(key)
    return keys


def local_stars(keys: np.ndarray, nodes: np.ndarray) -> list[pa.Array]:
    """Band rows of a batch: per range of keys its entries (key, node, smallest node with that key)."""
    key, node = keys.ravel(), np.tile(nodes.view(np.int64), len(keys))
    order = np.argsort(key)
    key, node = key[order], node[order]
    starts, counts = runs(key)
    rep = np.repeat(np.minimum.reduceat(node, starts), counts)
    entries = np.stack([key.view(np.int64), node, rep], axis=1)
    part = (key >> np.uint64(64 - PART_BITS)).astype(np.int32)
    begin = runs(part)[0]
    ends = np.append(begin, len(key)).astype(np.int32) * np.int32(24)
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(entries)]
    return [pa.array(part[begin]), pa.Array.from_buffers(pa.binary(), len(begin), buffers)]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    return edges[:-1], np.diff(edges)


def bucket_links(rows: DataFrame) -> DataFrame:
    """(key, a, b, many) from band rows: ``b`` linked to a smaller ``a`` of its bucket; stored.

    ``many`` is false only where the bucket has no other link.
    """
    parts = rows.repartition("part").sortWithinPartitions("part")
    return stored(parts.mapInArrow(stars, "key long, a long, b long, many boolean"), "buckets")


def stars(batches):
    """Links of the band rows of each range; rows of a range come one after another."""
    current, held, carried = None, [], np.zeros((0, 3), np.int64)

    def links(more):
        """The links of what is held, and one entry per bucket in its place."""
        entries = np.concatenate([carried, *held])
        entries = entries[np.argsort(entries[:, 0])]
        key, node, rep = entries.T
        starts, counts = runs(key)
        least = np.minimum.reduceat(rep, starts)
        a = np.where(node != rep, rep, np.repeat(least, counts))
        link = a != node
        # Where entries were reduced before, other links of a bucket may have gone out already.
        many = np.repeat((np.add.reduceat(link, starts, dtype=np.int64) > 1) | more, counts)
        columns = [pa.array(x[link]) for x in (key, a, node, many)]
        return pa.RecordBatch.from_arrays(columns, ["key", "a", "b", "many"]), np.stack([key[starts], least, least], axis=1)

    for batch in batches:
        part = batch.column(0).to_numpy()
        for first, count in zip(*runs(part), strict=True) if len(part) else ():
            if held and part[first] != current:
                yield links(len(carried) > 0)[0]
                held, carried = [], carried[:0]
            current = part[first]
            entries = b"".join(batch.column(1).slice(first, count).to_pylist())
            held.append(np.frombuffer(entries, np.int64).reshape(-1, 3))
            if sum(map(len, held)) > MOST_ENTRIES:
                found, carried = links(True)
                held = [carried[:0]]
                yield found
    if held:
        yield links(len(carried) > 0)[0]


def linked(buckets: DataFrame, confirm, across) -> DataFrame:
    """(node, component) under all confirmed links between nodes that share a bucket.

    ``confirm`` takes distinct pairs (a, b) and returns those that are similar. First the
    links of ``buckets`` are confirmed and united. Buckets whose nodes then are in several
    components may hide further links: ``across`` takes their (key, node, component) and
    returns links between components. Pairs inside a component cannot change the result and
    are never looked at.
    """
    first = stored(confirm(buckets.select("a", "b").distinct()), "links")
    groups = components(first)
    # A bucket with one link has no other pair.
    many = buckets.filter("many")
    members = many.select("key", F.col("a").alias("node")).union(many.select("key", F.col("b").alias("node")))
    labelled = members.distinct().join(groups, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")
    )
    labelled = stored(labelled, "members")
    several = labelled.groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")
    )
    several = stored(several.filter("x <> y").select("key", "members"), "mixed")
    second = stored(across(labelled.join(several, "key")), "links")
    if second.isEmpty():
        return groups
    return components(first.union(second))


def indexed_across(items: DataFrame, sets, percent: int, block: int, close=None):
    """``across`` by an inverted index per bucket, without a row per pair.

    ``items`` is (node, item, other columns); ``sets`` gives the distinct shingle hashes of a
    column of items and how many each has. A bucket of more than ``block`` members, or entries
    where ``items`` counts them as ``entries``, is cut into parts by hash, and every two parts
    meet in a task of their own. ``close`` takes the other columns of a bucket by name and
    returns a function that says which of its members may be similar to one of them; without
    it, all are looked up.

    A bucket of two members has no pair but its link, which has been tried. Of buckets with
    the same members, told by two 64-bit sums over them, one is compared.
    """
    others = [c for c in items.columns if c not in ("node", "item", "entries")]

    def across(members):
        members = members.filter("members > 2")
        if "entries" in items.columns:
            members = members.join(items.select("node", "entries"), "node")
        else:
            members = members.withColumn("entries", F.lit(1))
        digests = [F.sum(F.xxhash64(F.lit(seed), "node").cast("decimal(20,0)")).alias(f"d{seed}") for seed in (1, 2)]
        same = members.groupBy("key", "members").agg(F.sum("entries").alias("total"), *digests)
        chosen = same.groupBy("members", "total", "d1", "d2").agg(F.min("key").alias("key")).select("key", "total")
        members = members.join(stored(chosen, "open-buckets"), "key")
        parts = F.ceil(F.col("total") / block).cast("int")
        part = F.pmod(F.xxhash64("node"), parts).cast("int")
        rows = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        rows = rows.select(
            "key", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "node", "component"
        )
        rows = stored(rows, "open-members").join(items, "node")
        ordered = rows.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
        chosen = ordered.select("key", "one", "two", "node", "component", "item", *others)
        return chosen.mapInArrow(run, "a long, b long").distinct()

    def run(batches):
        current, held, more = None, [], []

        def links():
            may = close and close({c: pa.concat_arrays([m[c] for m in more]) for c in others})
            a, b = across_links(*map(np.concatenate, zip(*held, strict=True)), percent, may, unite=True)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            for piece in pieces(batch, "item"):
                keys = [piece.column(c).to_numpy() for c in ("key", "one", "two")]
                nodes, groups = (piece.column(c).to_numpy() for c in ("node", "component"))
                hashes, sizes = sets(piece.column("item"))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                new = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
                cuts = [0, *(np.flatnonzero(new) + 1), len(nodes)]
                for first, last in zip(cuts, cuts[1:], strict=False):
                    bucket = tuple(key[first] for key in keys)
                    if held and bucket != current:
                        yield links()
                        held.clear()
                        more.clear()
                    current = bucket
                    rows = slice(first, last)
                    held.append((nodes[rows], groups[rows], hashes[ends[first] : ends[last]], sizes[rows]))
                    more.append({c: piece.column(c).slice(first, last - first) for c in others})
        if held:
            yield links()

    return across


def column_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each text, or of each list of longs."""
    sizes = pc.multiply(pc.list_value_length(column), 8) if pa.types.is_list(column.type) else pc.binary_length(column)
    return sizes.to_numpy(zero_copy_only=False).astype(np.int64)


def pieces(batch: pa.RecordBatch, *items: str):
    """Runs of rows of a batch whose items together are not much longer than PIECE_BYTES."""
    taken = np.cumsum(sum(column_bytes(batch.column(c)) for c in items))
    first = 0
    while first < batch.num_rows:
        before = taken[first - 1] if first else 0
        past = max(first + 1, int(np.searchsorted(taken, before + PIECE_BYTES, "right")))
        yield batch.slice(first, past - first)
        first = past


def across_links(nodes, groups, hashes, sizes, percent, close=None, unite=False):
    """Links (a, b) between similar sets of different groups; at least one for each two groups.

    ``hashes`` holds the sets one after another, ``sizes`` how many entries each has. Sets of
    the largest group are looked up by those of the others. ``close(at)`` says which sets may
    be similar to that at ``at``. With ``unite``, groups become one as soon as they are linked,
    so that there are fewer links than groups.
    """
    names, group, members = np.unique(groups, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    probes = np.flatnonzero(group != np.argmax(members))
    index, shares = None, {}
    if len(nodes) * len(hashes) <= DENSE_CELLS:
        counts = shared_counts(probes, hashes, sizes)
        hits = 100 * counts >= percent * (sizes[probes, None] + sizes - counts)
        some = np.flatnonzero((hits & (group[probes, None] != group)).any(axis=1))
        probes, shares = probes[some], dict(zip(probes[some].tolist(), counts[some], strict=True))
    out_a, out_b = [], []
    for at in probes.tolist():
        apart = group != group[at]
        apart &= 100 * np.minimum(sizes, sizes[at]) >= percent * np.maximum(sizes, sizes[at])
        if close:
            apart &= close(at)
        if not apart.any():
            continue
        shared = shares.get(at)
        if shared is None:
            if index is None:
                index = posted, starts, begin, end = posting_lists(hashes, sizes)
            mine = slice(starts[at], starts[at] + sizes[at])
            length = end[mine] - begin[mine]
            before = np.cumsum(length) - length
            found = posted[np.repeat(begin[mine] - before, length) + np.arange(length.sum())]
            shared = np.bincount(found, minlength=len(nodes))
        hits = np.flatnonzero(apart & (100 * shared >= percent * (sizes[at] + sizes - shared)))
        if len(hits):
            linked_groups, once = np.unique(group[hits], return_index=True)
            out_a += [nodes[at]] * len(once)
            out_b += nodes[hits[once]].tolist()
            if unite:
                group[np.isin(group, linked_groups)] = group[at]
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def shared_counts(probes, hashes, sizes):
    """How many entries the sets at ``probes`` share with each set, by a table of sets and entries."""
    order = np.argsort(hashes)
    counts = runs(hashes[order])[1]
    entry = np.repeat(np.arange(len(counts)), counts)
    table = np.zeros((len(sizes), entry[-1] + 1), np.float32)
    table[np.repeat(np.arange(len(sizes)), sizes)[order], entry] = 1
    return (table[probes] @ table.T).astype(np.int64)


def posting_lists(hashes, sizes):
    """The sets of all entries by their hash, where each set starts, and per entry the run of its hash."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(hashes)
    edges, same = runs(hashes[order])
    begin, end = np.empty_like(order), np.empty_like(order)
    begin[order], end[order] = np.repeat(edges, same), np.repeat(edges + same, same)
    return owner[order], np.cumsum(sizes) - sizes, begin, end
