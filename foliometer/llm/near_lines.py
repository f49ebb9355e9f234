"""Fuzzy line dedup: one line is kept of each group of near-equal lines.

A line is trimmed of white space and lower-cased A-Z. Equal lines are one node, named by a
64-bit digest. Lines are sets of character shingles; MinHash bands find candidates, exact
Jaccard similarity on the sets confirms them, and distributed union-find joins them. Of
every component the first line (by doc_id, then position) stays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.skew import attach
from .banding import BAND_ROWS, band_keys, bucket_links, indexed_across, linked, local_stars, pieces
from .common import STEP, map_batches, mixed, multipliers, only_ids, raw_texts, stored, without_clashes

# Characters whose signatures a task computes together; they fit the processor's cache.
BLOCK_CHARS = 65_536
# Lines of a bucket that a task compares together.
BLOCK_LINES = 5000
BLANK = " \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Settings:
    """Parameters of the search.

    A pair at the threshold 0.75 is missed by all bands with a probability of 5e-4, one at
    0.8 with 3e-5. Lines of fewer characters than a shingle are removed only as exact copies.
    Lines shorter than ``least_chars`` are always kept.
    """

    shingle: int = 8
    percent: int = 75
    bands: int = 20
    rows: int = 4
    least_chars: int = 20


# Every line that is not blank takes part.
EVERY_LINE = Settings(least_chars=1)


def plain(line: str) -> str:
    """A line as it is compared; bytes lower only A-Z."""
    return line.encode().lower().decode().strip(BLANK)


def line_node(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line)


def wide_hashes(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of lines of at least ``size``, and how many each has."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    run = polynomials(codes, size)
    lengths = np.array([len(line) for line in lines])
    # What begins in the last characters of a line goes past its end.
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(lengths)[:, None] - np.arange(1, size)] = False
    return mixed(run[inside[: len(run)]]), lengths - size + 1


def polynomials(codes: np.ndarray, size: int) -> np.ndarray:
    """The sum of ``codes[i + k] * STEP ** (size - 1 - k)`` over every window, by doubling its size."""
    run, spare, width = codes.copy(), np.empty_like(codes), 1
    for bit in f"{size:b}"[1:]:
        last = len(codes) - 2 * width + 1
        np.multiply(run[:last], np.uint64(pow(int(STEP), width, 2**64)), out=spare[:last])
        spare[:last] += run[width : last + width]
        run, spare, width = spare, run, 2 * width
        if bit == "1":
            last -= 1
            run[:last] *= STEP
            run[:last] += codes[width : last + width]
            width += 1
    return run[: len(codes) - size + 1]


def char_hashes(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """``wide_hashes`` cut to 32 bits."""
    hashes, counts = wide_hashes(lines, size)
    return (hashes >> np.uint64(32)).astype(np.uint32), counts


def signatures(lines: list[str], factors: np.ndarray, size: int) -> np.ndarray:
    """Minima (permutations x lines) of lines of at least ``size`` characters."""
    minima = np.empty((len(factors), len(lines)), np.uint32)
    ends = np.cumsum([len(line) for line in lines])
    at = 0
    while at < len(lines):
        before = ends[at - 1] if at else 0
        past = max(at + 1, int(np.searchsorted(ends, before + BLOCK_CHARS, "right")))
        hashes, counts = char_hashes(lines[at:past], size)
        starts = np.cumsum(counts) - counts
        permuted = np.empty_like(hashes)
        for number, factor in enumerate(factors):
            np.multiply(hashes, factor, out=permuted)
            minima[number, at:past] = np.minimum.reduceat(permuted, starts)
        at = past
    return minima


def lines_of(text: bytes, settings: Settings):
    """(position, compared line) of the lines of a UTF-8 text that take part."""
    # As ``plain``, but lowered at once for the whole text.
    least = settings.least_chars
    for number, line in enumerate(text.lower().split(b"\n")):
        line = line.strip(BLANK.encode())
        # A character has one to four bytes.
        if len(line) >= 4 * least or (len(line) >= least and len(line.decode()) >= least):
            yield number, line


def occurrences(docs: DataFrame, settings: Settings) -> DataFrame:
    """(row, doc_id, line_no, node) of every line that takes part."""

    def start():
        def work(batch):
            counts, numbers, nodes = [], [], []
            for text in raw_texts(batch.column(2)):
                before = len(nodes)
                for number, line in lines_of(text, settings):
                    numbers.append(number)
                    nodes.append(line_node(line))
                counts.append(len(nodes) - before)
            take = np.repeat(np.arange(len(counts)), counts)
            signed = pa.array(np.array(nodes, np.uint64).view(np.int64))
            yield [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.array(numbers, np.int32)), signed]

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, line_no int, node long"
    return map_batches(docs.select("row", "doc_id", "text"), start, schema)


def band_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    """Band rows of the distinct lines of each batch."""

    def start():
        factors = multipliers(settings.bands * settings.rows)

        def work(batch):
            found = sorted({line for text in raw_texts(batch.column(0)) for _, line in lines_of(text, settings)})
            lines = [line.decode() for line in found]
            nodes = [line_node(line) for line, text in zip(found, lines, strict=True) if len(text) >= settings.shingle]
            if nodes:
                nodes = np.array(nodes, np.uint64)
                lines = [line for line in lines if len(line) >= settings.shingle]
                keys = band_keys(signatures(lines, factors, settings.shingle), settings.bands, settings.rows)
                yield local_stars(keys, nodes)

        return work

    return map_batches(docs.select("text"), start, BAND_ROWS)


def line_texts(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(node, line): one text per wanted node, from its first occurrence."""
    places = wanted.groupBy("row").agg(F.collect_list("line_no").alias("numbers"))

    def start():
        def work(batch):
            nodes, lines = [], []
            for text, numbers in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                numbers = set(numbers)
                for number, line in lines_of(text, settings):
                    if number in numbers:
                        nodes.append(line_node(line))
                        lines.append(line)
            yield [pa.array(nodes, pa.uint64()).view(pa.int64()), pa.array(lines, pa.binary()).cast(pa.string())]

        return work

    rows = only_ids(docs.select("row", "text"), stored(places.select("row"), "rows"), "row")
    # Hashing the numbers, texts need not be sorted.
    joined = rows.join(places.hint("shuffle_hash"), "row").select("text", "numbers")
    return map_batches(joined, start, "node long, line string").dropDuplicates(["node"])


def shared_shingles(sides: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many shingles the two lines of each row of ``sides`` share; they number the sets
    of ``distinct_shingles``."""
    lengths = sizes[sides].ravel()
    before = np.cumsum(lengths) - lengths
    starts = (np.cumsum(sizes) - sizes)[sides].ravel()
    both = hashes[np.repeat(starts - before, lengths) + np.arange(lengths.sum())]
    firsts = before[::2]
    lasts = np.append(firsts[1:], len(both))
    for first, past in zip(firsts, lasts, strict=True):
        both[first:past].sort()
    # Within a set no hash is there twice, so equal neighbours are one from each.
    twice = np.append(both[1:] == both[:-1], False)
    twice[lasts - 1] = False
    return np.add.reduceat(twice, firsts, dtype=np.int64)


def similar(percent: int, size: int):
    """Whether two texts have sets of character shingles that are similar enough."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "line_a", "line_b"):
                lines = pa.concat_arrays([piece.column("line_a"), piece.column("line_b")]).dictionary_encode()
                hashes, sizes = distinct_shingles(lines.dictionary.to_pylist(), size)
                sides = lines.indices.to_numpy().reshape(2, -1).T
                shared = shared_shingles(sides, hashes, sizes)
                keep = pa.array(100 * shared >= percent * (sizes[sides].sum(axis=1) - shared))
                yield pa.RecordBatch.from_arrays([piece.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def distinct_shingles(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of lines of at least ``size``, one set after
    another, and how many each has."""
    hashes, counts = wide_hashes(lines, size)
    ends = np.cumsum(counts)
    starts = ends - counts
    for first, past in zip(starts, ends, strict=True):
        hashes[first:past].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[starts] = True
    return hashes[new], np.add.reduceat(new, starts, dtype=np.int64)


def removed_lines(docs: DataFrame, settings: Settings) -> DataFrame:
    """(row, line_no) of the lines to remove; ``docs`` has a stable ``row`` number."""
    every = stored(occurrences(docs, settings), "lines")
    buckets = bucket_links(band_rows(docs, settings))
    place = F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "row", "line_no"
    )
    members = buckets.select(F.col("a").alias("node")).union(buckets.select(F.col("b").alias("node"))).distinct()
    members = members.withColumn("member", F.lit(True))
    nodes = every.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("rows"))
    # Lines that are in no bucket and have no copy stay.
    nodes = stored(nodes.join(members, "node", "left").filter("member OR rows > 1"), "line-nodes")

    wanted = nodes.filter("member").select("node", "first.row", "first.line_no")
    texts = stored(line_texts(docs, stored(wanted, "wanted"), settings), "line-texts")

    def confirm(pairs):
        for side in ("a", "b"):
            pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("line").alias(f"line_{side}")), side)
        return pairs.mapInArrow(similar(settings.percent, settings.shingle), "a long, b long")

    def sets(lines):
        return distinct_shingles(lines.to_pylist(), settings.shingle)

    across = indexed_across(texts.withColumnRenamed("line", "item"), sets, settings.percent, BLOCK_LINES)
    groups = linked(buckets, confirm, across)
    named = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(named, "line-groups")
    firsts = named.groupBy("component").agg(
        F.min("first").alias("stays"), F.sum("rows").alias("n")
    ).filter("n > 1").drop("n")
    # Only nodes of which something goes: copies, or members of a larger component.
    going = stored(named.join(firsts, "component").select("node", "stays", "rows"), "going")
    found = attach(every, going.drop("rows"), ["node"], ["row", "line_no"], counts=going, how="inner")
    return found.filter(~((F.col("row") == F.col("stays.row")) & (F.col("line_no") == F.col("stays.line_no")))).select("row", "line_no")


def with_rows(docs: DataFrame) -> DataFrame:
    """Number the rows of a stored table; its files are read in the same splits each time."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def dedup_lines(docs: DataFrame, settings: Settings = Settings(), keep: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """(doc_id, n_lines, n_removed, text, ``keep``): documents without the lines removed.

    Lines are cut at line feeds and their text is left as it was. A null text stays null and
    has no lines; an empty one has one line. Blank lines and those under ``least_chars`` stay. Where several
    rows share a doc_id their lines are told apart; null ids come last in the order that
    decides which line stays. ``docs`` must be read from files or stored, so that its rows
    come in the same order each time.
    """
    columns = ["doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")]]
    docs = with_rows(without_clashes(docs, *columns))
    gone = removed_lines(docs, settings).groupBy("row").agg(F.collect_list("line_no").alias("gone"))
    joined = docs.join(gone.hint("shuffle_hash"), "row", "left").drop("row")
    at = joined.columns.index("text")
    fields = [f for f in joined.schema if f.name != "gone"]
    schema = StructType(fields).add("n_lines", "long").add("n_removed", "long")

    def start():
        def work(batch):
            lines, removed, texts = [], [], []
            column = batch.column(at).cast(pa.binary()).to_pylist()
            for text, numbers in zip(column, batch.column("gone").to_pylist(), strict=True):
                count = 0 if text is None else text.count(b"\n") + 1
                if numbers:
                    gone = set(numbers)
                    text = b"\n".join([line for i, line in enumerate(text.split(b"\n")) if i not in gone])
                lines.append(count)
                removed.append(len(numbers or ()))
                texts.append(text)
            columns = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "gone"]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield [*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())]

        return work

    return map_batches(joined, start, schema)


def kept_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``docs`` with their text reduced to the lines that stay.

    Documents that lose all their lines with a word are dropped; all others stay.
    """
    columns = docs.columns
    # Other columns may have the names that are worked with here.
    others = {name: f"__column_{at}" for at, name in enumerate(columns) if name not in ("doc_id", "text")}
    rows = dedup_lines(docs.withColumnsRenamed(others), settings, tuple(others.values()))
    lost = (F.col("n_removed") > 0) & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return rows.filter(~lost).withColumnsRenamed({new: old for old, new in others.items()}).select(*columns)
