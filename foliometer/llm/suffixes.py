"""Exact dedup of long byte strings by deep-shallow sorting of suffixes.

Every byte covered by a string of 200 bytes that starts elsewhere too is removed. A suffix
counts with its first 200 bytes, its *window*. To bring equal windows together without
sending every suffix, a window is represented by its anchor: the 64-byte gram with the
smallest hash inside it, the leftmost if several are. Consecutive windows with one anchor are
a *segment* of at most 336 bytes. Equal windows have equal grams at the same distance, so

1. texts that occur more than once are removed whole, and go on once;
2. grams that occur once are dropped, by counts over all segments;
3. of the other grams, segments that are equal as a whole are windows that repeat;
4. what differs meets its gram's other segments: suffixes from the anchor on, and prefixes
   before it read backwards, are deep-shallow sorted. Two windows are equal where both
   orders say that enough bytes are shared.

Only the segments of step 4 travel as text. A gram with very many different segments is not
sorted in one task: its windows are counted by their digests over all tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, map_batches, mixed, only_ids, stored
from .deep_shallow import deep_shallow_sort

LENGTH = 200
GRAM = 64
# Windows whose hashes are in memory together; a longer text is cut here.
BLOCK = 1 << 20
PLACE_BITS = 22
# Different segments of one gram that a task sorts together, 7 MB of text.
HOT_SEGMENTS = 20_000
# Segments of many small grams that are sorted together.
SORTED_TOGETHER = 20_000

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * STEP)
_BASE = int(mixed(np.array([77], np.uint64))[0]) | 1


class Hashes:
    """Hashes of any part of a buffer of at most BLOCK + LENGTH bytes."""

    def __init__(self):
        size = BLOCK + LENGTH + 1
        self.powers = np.full(size, _BASE, np.uint64)
        self.powers[0] = 1
        np.cumprod(self.powers, out=self.powers)
        self.inverse = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        self.inverse[0] = 1
        np.cumprod(self.inverse, out=self.inverse)

    def load(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.powers[: len(data)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Hashes of all strings of this length."""
        part = self.sums[length:] - self.sums[:-length]
        part *= self.inverse[: len(part)]
        return mixed(part)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        part = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mixed(part ^ mixed((ends - starts).astype(np.uint64)))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries."""
    reach, found = 1, values
    while 2 * reach <= width:
        found = np.minimum(found[:-reach], found[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(found[: len(found) - rest], found[rest:]) if rest else found


class Segments:
    """Segments of the texts of a block, as arrays.

    ``text`` is the number of the text in its block, ``first`` and ``last`` the first and last
    window in the block's buffer, ``anchor`` the place of the gram, ``gram`` its hash,
    ``digest`` that of the whole segment.
    """

    def __init__(self, hashes: Hashes, data: np.ndarray, bounds: np.ndarray):
        hashes.load(data)
        grams = hashes.every(GRAM)
        places = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = sliding_minimum((grams & ~low) | places, LENGTH - GRAM + 1)
        anchor = (least & low).astype(np.int64)
        # Windows that lie inside one text.
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchor)]
        inside = np.arange(len(anchor)) + LENGTH <= bounds[1:][text]
        first = np.ones(len(anchor), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        starts = np.flatnonzero(first & inside)
        last = np.ones(len(anchor), bool)
        last[:-1] = (anchor[1:] != anchor[:-1]) | ~inside[1:]
        self.first, self.last = starts, np.flatnonzero(last & inside)
        self.anchor, self.text = anchor[starts], text[starts]
        self.gram = grams[self.anchor]
        self.digest = hashes.of(self.first, self.last + LENGTH)


def blocks(column: pa.Array, hashes: Hashes):
    """(row numbers, data, bounds, offset in the text, segments) of the texts of a column.

    Short texts share a block; a long one has blocks of its own, cut at the same windows in
    every batch. Texts shorter than a window are passed over.
    """
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or column.buffers()[2] is None:
        return
    data = np.frombuffer(column.buffers()[2], np.uint8)
    sizes = np.diff(offsets)
    waiting, size = [], 0

    def together(rows):
        parts = [data[offsets[r] : offsets[r + 1]] for r in rows]
        bounds = np.concatenate([[0], np.cumsum([len(part) for part in parts])])
        buffer = np.concatenate(parts)
        return rows, buffer, bounds, 0, Segments(hashes, buffer, bounds)

    for row in np.flatnonzero(sizes >= LENGTH).tolist():
        if sizes[row] > BLOCK:
            text = data[offsets[row] : offsets[row + 1]]
            for at in range(0, len(text) - LENGTH + 1, BLOCK):
                part = text[at : at + BLOCK + LENGTH - 1]
                bounds = np.array([0, len(part)])
                yield [row], part, bounds, at, Segments(hashes, part, bounds)
            continue
        if size + sizes[row] > BLOCK:
            yield together(waiting)
            waiting, size = [], 0
        waiting.append(row)
        size += sizes[row]
    if waiting:
        yield together(waiting)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def segment_rows(texts: DataFrame) -> DataFrame:
    """(key, gram, digest, n): the different segments of each text and how often they occur."""

    def start():
        hashes = Hashes()

        def work(batch):
            keys = batch.column(0).to_numpy()
            for rows, _, _, _, found in blocks(batch.column(1).cast(pa.binary()), hashes):
                order = np.lexsort((found.digest, found.gram, found.text))
                text, gram, digest = found.text[order], found.gram[order], found.digest[order]
                new = np.ones(len(order), bool)
                new[1:] = (digest[1:] != digest[:-1]) | (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(order)))
                key = keys[np.array(rows)[text[at]]]
                yield [pa.array(key), signed(gram[at]), signed(digest[at]), pa.array(n, pa.int64())]

        return work

    return map_batches(texts.select("key", "text"), start, "key long, gram long, digest long, n long")


def segment_texts(texts: DataFrame) -> DataFrame:
    """(gram, digest, open, before, width, content, windows) of the wanted segments of texts.

    ``texts`` has (text, wanted array of (digest, open, hot)). A segment's ``content`` starts
    ``before`` bytes ahead of its anchor and holds ``width`` windows; hot ones bring the
    digests of their windows instead.
    """

    def start():
        hashes = Hashes()

        def work(batch):
            wanted = batch.column(1)
            bounds_of = np.append(wanted.offsets.to_numpy(), 0)
            flat = wanted.values
            every = [flat.field(name).to_numpy(zero_copy_only=False) for name in ("digest", "open", "hot")]
            for rows, data, _, _, found in blocks(batch.column(0).cast(pa.binary()), hashes):
                digest = found.digest.view(np.int64)
                out: list[list] = [[] for _ in range(7)]
                for number, row in enumerate(rows):
                    lo, hi = np.searchsorted(found.text, [number, number + 1])
                    part = slice(bounds_of[row], bounds_of[row + 1])
                    asked, is_open, is_hot = (column[part] for column in every)
                    order = np.argsort(asked)
                    place = np.searchsorted(asked[order], digest[lo:hi])
                    place = order[np.minimum(place, len(order) - 1)]
                    hits = np.flatnonzero(asked[place] == digest[lo:hi])
                    # A segment that the text repeats goes once.
                    _, once = np.unique(digest[lo:hi][hits], return_index=True)
                    for hit in hits[once]:
                        at, which = lo + hit, place[hit]
                        first, last = found.first[at], found.last[at]
                        windows = content = None
                        if is_hot[which]:
                            starts = np.arange(first, last + 1)
                            windows = hashes.of(starts, starts + LENGTH).view(np.int64)
                        else:
                            content = data[first : last + LENGTH].tobytes()
                        values = (found.gram[at], digest[at], is_open[which], found.anchor[at] - first, last - first + 1, content, windows)
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
                if out[0]:
                    gram = signed(np.array(out[0], np.uint64))
                    kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
                    yield [gram, *(pa.array(c, k) for c, k in zip(out[1:], kinds, strict=True))]

        return work

    schema = "gram long, digest long, open boolean, before int, width int, content binary, windows array<long>"
    return map_batches(texts.select("text", "wanted"), start, schema)


def repeated_windows(groups: np.ndarray, before: np.ndarray, width: np.ndarray, contents: list[bytes]) -> np.ndarray:
    """Which windows of different segments occur in another segment of their group.

    ``groups`` ascend. Returns segments x distances: column l is the window that starts l
    bytes ahead of the anchor.
    """
    reach, n = LENGTH - GRAM, len(groups)
    ahead, behind = np.zeros((n, LENGTH), np.uint8), np.zeros((n, reach), np.uint8)
    nearest = before - width + 1
    for row, (content, at, near) in enumerate(zip(contents, before, nearest, strict=True)):
        text = np.frombuffer(content, np.uint8)
        ahead[row, : LENGTH - near] = text[at:]
        behind[row, :at] = text[:at][::-1]
    ranks = []
    for rows in (ahead, behind):
        order, shared = deep_shallow_sort(rows, groups)
        ranks.append((order, shared))
    found = np.zeros((n, reach + 1), bool)
    label = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for distance in range(reach + 1):
        members = np.flatnonzero((nearest <= distance) & (distance <= before))
        if len(members) < 2:
            continue
        # Strings that share enough bytes are neighbours in the order; each run has a label.
        for which, enough in ((0, LENGTH - distance), (1, distance)):
            order, shared = ranks[which]
            label[which][order] = np.cumsum(shared < enough)
        both = label[0][members] * (n + 1) + label[1][members]
        by_label = np.argsort(both, kind="stable")
        both = both[by_label]
        same = both[1:] == both[:-1]
        found[members[by_label[1:][same]], distance] = True
        found[members[by_label[:-1][same]], distance] = True
    return found


def sorted_segments(segments: DataFrame) -> DataFrame:
    """(gram, digest, repeats): of each open segment, a bit per window from the first on."""
    columns = ["gram", "digest", "open", "before", "width", "content"]
    ordered = segments.select(*columns).repartition("gram").sortWithinPartitions("gram")

    def finish(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        gram, before, width = (table.column(c).to_numpy().astype(np.int64) for c in ("gram", "before", "width"))
        groups = np.cumsum(np.append(True, gram[1:] != gram[:-1]))
        found = repeated_windows(groups, before, width, table.column("content").to_pylist())
        is_open = table.column("open").to_numpy()
        rows = np.flatnonzero(is_open & found.any(axis=1))
        # From the first window, the farthest ahead of the anchor, to the last.
        bits = [np.packbits(found[r, before[r] - width[r] + 1 : before[r] + 1][::-1]).tobytes() for r in rows]
        digest = table.column("digest").to_numpy()[rows]
        columns = [pa.array(gram[rows]), pa.array(digest), pa.array(bits, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["gram", "digest", "repeats"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            if size >= SORTED_TOGETHER and batch.num_rows:
                # A gram's segments stay together: the last one may go on in this batch.
                table = pa.Table.from_batches(parts).combine_chunks()
                gram = table.column("gram").to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))
                if cut:
                    yield finish(table.slice(0, cut).to_batches())
                parts = table.slice(cut).to_batches()
                size = len(gram) - cut
            parts.append(batch)
            size += batch.num_rows
        if size:
            yield finish(parts)

    return ordered.mapInArrow(run, "gram long, digest long, repeats binary")


def counted_windows(segments: DataFrame) -> DataFrame:
    """(gram, digest, repeats) of the open segments of hot grams, by digests of their windows."""
    rows = segments.select("gram", "digest", "open", F.posexplode("windows").alias("place", "window"))
    rows = stored(rows, "hot-windows")
    often = rows.groupBy("gram", "window").agg(F.count("*").alias("n")).filter("n > 1")
    often = stored(often.drop("n"), "often-windows")
    hits = rows.filter("open").join(often, ["gram", "window"])
    hits = hits.groupBy("gram", "digest").agg(F.collect_list("place").alias("places"))

    def start():
        def work(batch):
            bits = []
            for places in batch.column(2).to_pylist():
                flags = np.zeros(LENGTH - GRAM + 1, bool)
                flags[places] = True
                bits.append(np.packbits(flags).tobytes())
            yield [batch.column(0), batch.column(1), pa.array(bits, pa.binary())]

        return work

    return map_batches(hits.select("gram", "digest", "places"), start, "gram long, digest long, repeats binary")


def cut_texts(texts: DataFrame) -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256) of texts with their segments that repeat.

    ``repeats`` is an array of (digest, repeats); null bits stand for all windows.
    """

    def start():
        hashes = Hashes()

        def work(batch):
            keys, column, lists = batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)
            flat, offsets = lists.values, np.append(lists.offsets.to_numpy(), 0)
            digests = flat.field("digest").to_numpy()
            bits = flat.field("repeats")
            covered: dict[int, np.ndarray] = {}
            for rows, _, bounds, offset, found in blocks(column, hashes):
                digest = found.digest.view(np.int64)
                for number, row in enumerate(rows):
                    text_size = len(column[row].as_py()) if row not in covered else 0
                    marks = covered.setdefault(row, np.zeros(text_size + 1, np.int32))
                    lo, hi = np.searchsorted(found.text, [number, number + 1])
                    asked = digests[offsets[row] : offsets[row + 1]]
                    order = np.argsort(asked)
                    place = order[np.minimum(np.searchsorted(asked[order], digest[lo:hi]), len(order) - 1)]
                    for hit in np.flatnonzero(asked[place] == digest[lo:hi]):
                        first = found.first[lo + hit] - bounds[number] + offset
                        width = found.last[lo + hit] - found.first[lo + hit] + 1
                        flags = bits[int(offsets[row] + place[hit])].as_py()
                        if flags is None:
                            marks[first] += 1
                            marks[first + width + LENGTH - 1] -= 1
                        else:
                            hits = first + np.flatnonzero(np.unpackbits(np.frombuffer(flags, np.uint8), count=width))
                            marks[hits] += 1
                            marks[hits + LENGTH] -= 1
            chosen = sorted(covered)
            removed, spans, kept = [], [], []
            for row in chosen:
                gone = np.cumsum(covered[row][:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
                text = np.frombuffer(column[row].as_py(), np.uint8)
                kept.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
            rows = keys.take(pa.array(chosen, pa.int64()))
            yield [rows, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())]

        return work

    schema = "key long, n_removed long, n_spans long, kept_sha256 string"
    return map_batches(texts.select("key", "text", "repeats"), start, schema)


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, twin): a number for each (doc_id, text) and a name for each text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    return rows.select("doc_id", "text", key.alias("key"), F.unhex(F.md5("text")).alias("twin"))


def repeated_bytes(docs: DataFrame, hot: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``.

    A byte goes if a string of 200 bytes that covers it starts at another place as well, in
    any document or the same one, judged on the input. Texts are taken as UTF-8, null as
    empty. Rows with equal or null ids are separate documents; rows that are equal as a whole
    repeat each other. Extra columns are left out.
    """
    rows = text_rows(docs)
    facts = stored(
        rows.select("doc_id", "key", "twin", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256")),
        "texts",
    )
    twins = facts.groupBy("twin").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    twins = stored(twins, "twins")
    # One row of each text; rows that repeat in id and text have the same key and count twice,
    # which they may, because they are removed anyway.
    named = rows.select("key", "text").filter(F.octet_length("text") >= LENGTH)
    single = twins.select("key")
    texts = only_ids(named, single, "key")

    every = stored(segment_rows(texts), "segments")
    often = every.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram")
    shared = stored(every.join(stored(often, "grams"), "gram", "left_semi"), "shared-segments")
    kinds = stored(
        shared.groupBy("gram", "digest").agg(F.sum("n").alias("n"), F.min("key").alias("key")), "segment-kinds"
    )
    grams = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    grams = grams.filter("kinds > 1 AND least = 1").select("gram", (F.col("kinds") > hot).alias("hot"))
    wanted = kinds.join(stored(grams, "open-grams"), "gram").select(
        "key", F.struct("digest", (F.col("n") == 1).alias("open"), "hot").alias("one")
    )
    # As many as a text has segments.
    wanted = stored(wanted.groupBy("key").agg(F.collect_list("one").alias("wanted")), "wanted")
    sought = only_ids(texts, wanted.select("key"), "key").join(wanted, "key")
    segments = stored(segment_texts(sought), "segment-texts")
    compared = sorted_segments(segments.filter("content IS NOT NULL"))
    counted = counted_windows(segments.filter("content IS NULL"))
    whole = kinds.filter("n > 1").select("gram", "digest", F.lit(None).cast("binary").alias("repeats"))
    verdicts = stored(whole.unionByName(compared).unionByName(counted), "verdicts")

    marked = shared.select("key", "gram", "digest").join(verdicts, ["gram", "digest"])
    marked = marked.groupBy("key").agg(F.collect_list(F.struct("digest", "repeats")).alias("repeats"))
    marked = stored(marked, "marked")
    cut = stored(cut_texts(only_ids(texts, marked.select("key"), "key").join(marked, "key")), "cut")

    # Results by text: ``key`` is that of the one row which was read for it.
    cut = cut.dropDuplicates(["key"])
    results = stored(twins.join(cut, "key", "left").drop("key"), "results")
    copied = (F.col("n") > 1) & (F.col("n_bytes") >= LENGTH)
    nothing = F.sha2(F.lit(""), 256)
    return facts.join(results, "twin").select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, nothing).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
