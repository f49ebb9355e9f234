"""Phrase collocations from a weighted de Bruijn graph of words.

Nodes are runs of four words and edges runs of five: an edge leads from its first four words
to its last four. Every word occurrence starts exactly one run, the longest one that its piece
of text allows: an edge, or, near the end of the piece, a shorter run that no edge leaves. So
the occurrences of a node are what flows out of it over its edges, plus those at a piece's end;
the same holds one size down, where the runs of four words are the edges, and so on.

A run also ends before a word, or a pair of words, that occurs too rarely for any candidate.
These are told by a table of counters of fixed size, so some pass for frequent; the counts of
frequent runs are exact all the same, because every occurrence of one is in the flow of the
run that starts there.

A task builds the graph of its own texts, derives the flow of its nodes of every size, and passes
both on packed, by hash of the run: a dictionary of words and columns of numbers. A run of
any frequency reaches its bucket as one row per task, so no run makes a hot one. Buckets sum and
write out what is frequent as text. There unary nodes, whose whole flow goes over one edge, are
compacted into that edge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import STEP, mixed, raw_texts, stored, without_clashes

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Piece marks become full stops and tabs spaces; a full stop is in no word.
MARKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
BREAK = b"."
SLICE_BYTES = 4 << 20
PACKET_ROWS = 1 << 20
MERGE_ROWS = 1 << 22
MIN_BUCKETS = 16
# Counters that one task sums at a time.
PART = 1 << 20

SCHEMA = "bucket int, lang string, size int, phrase string, n long, names array<string>, words binary, columns binary, counts binary, width int"


@dataclass(frozen=True)
class Settings:
    """``longest`` words per run, ``least`` occurrences of a candidate, ``best`` rows per language.

    ``bucket_bytes`` is the text whose runs one bucket sums; memory of a task follows from it.
    ``slots`` counters of words and pairs, a multiple of PART, bound what the driver receives and
    every task holds: a bit for each, 32 MB.
    """

    longest: int = 5
    least: int = 100
    best: int = 2000
    bucket_bytes: int = 8 << 20
    slots: int = 1 << 28


class Numbers(dict):
    """Numbers of words from 1 on, in order of arrival; 0 is no word."""

    def __init__(self):
        self[BREAK] = 0
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def slots(self, lang: str, words: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The counters of the words, and of the pairs that start at all but the last of them."""
        seed = mixed(np.array([xxhash.xxh3_64_intdigest(lang.encode())], np.uint64))
        alone = mixed(seed * STEP + np.array(self.hashes, np.uint64))[words]
        pairs = mixed(alone[:-1] * STEP + alone[1:])
        return alone % np.uint64(count), pairs % np.uint64(count)


def token_slices(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """(words and breaks, whether more follow); a slice starts with the last four of the one before."""
    tokens: list[bytes] = []
    at = 0
    while True:
        end = text.find(b" ", at + SLICE_BYTES) if at + SLICE_BYTES < len(text) else -1
        part = text[at : end if end >= 0 else len(text)]
        tokens += part.replace(BREAK, b" . ").split()
        yield tokens, end >= 0
        if end < 0:
            return
        at, tokens = end, tokens[-4:]


def runs(words: np.ndarray, joined: np.ndarray, starts: int, longest: int) -> np.ndarray:
    """(longest, occurrences): the words from each of the first ``starts`` places to the run's end.

    ``joined`` says of all words but the last whether a run may go on to the next one.
    """
    padded = np.concatenate([words, np.zeros(longest, np.int32)])
    joined = np.concatenate([joined, np.zeros(longest + 1, bool)])
    columns = [padded[:starts]]
    for shift in range(1, longest):
        on = (columns[-1] != 0) & joined[shift - 1 : shift - 1 + starts]
        columns.append(np.where(on, padded[shift : shift + starts], 0))
    return np.stack(columns)[:, columns[0] != 0]


class Packet:
    """Counted runs over one dictionary. Row 0 of ``columns`` is the language, the others words."""

    def __init__(self, width: int):
        self.width = width
        self.numbers, self.langs = Numbers(), {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, columns: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((columns, counts))
        self.rows += columns.shape[1]

    def lang(self, name: str) -> int:
        return self.langs.setdefault(name, len(self.langs))

    def summed(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, columns, counts) of the different runs cut to ``width`` words, by hash."""
        columns = np.concatenate([c[: width + 1] for c, _ in self.parts], axis=1)
        counts = np.concatenate([n for _, n in self.parts])
        known = np.array(self.numbers.hashes, np.uint64)
        langs = [xxhash.xxh3_64_intdigest(name.encode()) for name in self.langs]
        hashes = mixed(np.array(langs, np.uint64))[columns[0]]
        for column in columns[1:]:
            hashes = mixed(hashes * STEP + known[column])
        order = np.argsort(hashes, kind="stable")
        hashes, columns, counts = hashes[order], columns[:, order], counts[order]
        new = np.ones(len(order), bool)
        new[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
        if (hashes[1:] == hashes[:-1])[new[1:]].any():  # two runs of one hash may alternate
            order = np.lexsort([*columns, hashes])
            hashes, columns, counts = hashes[order], columns[:, order], counts[order]
            new[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
        at = np.flatnonzero(new)
        return hashes[at], columns[:, at], np.add.reduceat(counts, at) if len(at) else counts

    def with_nodes(self) -> Packet:
        """The graph's edges and, from the flow, its nodes of every size, each once."""
        out = Packet(self.width)
        out.numbers, out.langs = self.numbers, self.langs
        flow = self
        for size in range(self.width, 0, -1):
            _, columns, counts = flow.summed(size)
            flow = Packet(size)
            flow.numbers, flow.langs = self.numbers, self.langs
            flow.add(columns, counts)
            exact = columns[-1] != 0
            padding = np.zeros((self.width - size, np.count_nonzero(exact)), np.int32)
            out.add(np.concatenate([columns[:, exact], padding]), counts[exact])
        return out

    def rows_out(self, buckets: int) -> Iterator[tuple]:
        """Rows of SCHEMA, one per bucket that runs fall into."""
        width = self.width
        hashes, columns, counts = self.summed(width)
        lots = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        edges = np.flatnonzero(np.diff(lots, prepend=-1.0))
        names = np.array(list(self.numbers), object)
        packed = zstandard.ZstdCompressor(level=1)
        place = np.zeros(len(names), np.uint32)
        for first, last in zip(edges, [*edges[1:], len(lots)], strict=True):
            part = columns[:, first:last]
            used = np.zeros(len(names), bool)
            used[0] = True
            for column in part[1:]:
                used[column] = True
            used = np.flatnonzero(used)
            place[used] = np.arange(len(used))
            kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
            data = part[0].astype(np.uint32).tobytes() + place[part[1:]].astype(kind).tobytes()
            yield (
                int(lots[first]), None, None, None, int(last - first), list(self.langs),
                packed.compress(b" ".join(names[used[1:]])), packed.compress(data),
                packed.compress(counts[first:last].tobytes()), width,
            )

    def unpack(self, row: dict) -> None:
        """Add the runs of a row of SCHEMA under this packet's numbers."""
        opened = zstandard.ZstdDecompressor()
        words = opened.decompress(row["words"]).split()
        place = np.concatenate([np.zeros(1, np.int32), self.numbers.of(words)])
        langs = np.array([self.lang(name) for name in row["names"]], np.int32)
        data, size, width = opened.decompress(row["columns"]), row["n"], row["width"]
        kind = np.uint16 if len(place) <= 1 << 16 else np.uint32
        columns = np.empty((width + 1, size), np.int32)
        columns[0] = langs[np.frombuffer(data, np.uint32, size)]
        columns[1:] = place[np.frombuffer(data, kind, offset=4 * size).reshape(width, size)]
        self.add(columns, np.frombuffer(opened.decompress(row["counts"]), np.int64))
        if self.rows > MERGE_ROWS:  # copies of a frequent run are summed as they come
            _, columns, counts = self.summed(width)
            self.parts, self.rows = [(columns, counts)], 0

    def frequent(self, least: int) -> Iterator[tuple]:
        """Rows of SCHEMA for the runs that occur often enough."""
        _, columns, counts = self.summed(self.width)
        names = list(self.numbers)
        langs = list(self.langs)
        for at in np.flatnonzero(counts >= least):
            words = [names[i] for i in columns[1:, at] if i]
            yield whole_row(langs[columns[0, at]], len(words), b" ".join(words).decode(), int(counts[at]))


def whole_row(lang: str, size: int, phrase: str, n: int) -> tuple:
    """A row of SCHEMA for a run given as text."""
    return (0, lang, size, phrase, n, None, None, None, None, None)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)],
        schema=schema,
    )


def arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds["array<string>"] = pa.list_(pa.string())
    return pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in SCHEMA.split(", ")])


def words_by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], bool]]:
    """(lang, words and breaks, whether the text goes on) of a batch of (lang, text)."""
    langs = batch.column("lang").to_pylist()
    texts = raw_texts(batch.column("text"))
    for name in dict.fromkeys(langs):
        own = [text for text, lang in zip(texts, langs, strict=True) if lang == name]
        for tokens, more in token_slices(BREAK.join(own).lower().translate(MARKS)):
            yield name, tokens, more


def sliced(slots: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(part, steps between counters, counts) of sorted counters; both compress to a byte or two."""
    packed = zstandard.ZstdCompressor(level=1)
    cuts = np.flatnonzero(np.diff(slots // PART, prepend=-1))
    for first, last in zip(cuts, [*cuts[1:], len(slots)], strict=True):
        own = (slots[first:last] % PART).astype(np.uint32)
        steps = np.diff(own, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
        amounts = counts[first:last].astype(np.uint32).view(np.uint8).reshape(-1, 4).T
        yield int(slots[first] // PART), packed.compress(steps.tobytes()), packed.compress(amounts.tobytes())


def opened(steps: bytes, amounts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What ``sliced`` made of one part."""
    tool = zstandard.ZstdDecompressor()
    both = [np.frombuffer(tool.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.uint32)[:, 0] for data in (steps, amounts)]
    return np.cumsum(both[0], dtype=np.int64), both[1]


def frequent_slots(texts: DataFrame, settings: Settings) -> bytes:
    """A bit per counter: set where the words and pairs of a language that share it may be frequent.

    The driver receives ``slots`` / 8 bytes, whatever the size of the table.
    """
    names = ["part", "steps", "amounts"]

    def count(batches):
        found, held = [], 0

        def out():
            slots, counts = np.unique(np.concatenate(found), return_counts=True)
            rows = zip(*sliced(slots.astype(np.int64), counts), strict=True)
            kinds = (pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

        for batch in batches:
            for name, tokens, more in words_by_lang(batch):
                numbers = Numbers()
                words = numbers.of(tokens)
                starts = max(0, len(words) - 4) if more else len(words)
                alone, pairs = numbers.slots(name, words, settings.slots)
                real = words != 0
                found += [alone[:starts][real[:starts]], pairs[:starts][(real[:-1] & real[1:])[:starts]]]
                held += len(found[-1]) + len(found[-2])
                if held >= 2 * PACKET_ROWS:
                    yield out()
                    found, held = [], 0
        if held:
            yield out()

    def settle(batches):
        totals, current = None, None

        def bits():
            many = np.packbits(totals >= settings.least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([many], pa.binary())], ["part", "bits"])

        for batch in batches:
            for part, steps, amounts in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if part != current:
                    if totals is not None:
                        yield bits()
                    totals, current = np.zeros(PART, np.int64), part
                slots, counts = opened(steps, amounts)
                totals[slots] += counts
        if totals is not None:
            yield bits()

    counted = texts.mapInArrow(count, "part int, steps binary, amounts binary")
    parts = settings.slots // PART
    summed = counted.repartition(min(parts, width_of(texts)), "part").sortWithinPartitions("part")
    table = np.zeros(settings.slots // 8, np.uint8)
    for row in summed.mapInArrow(settle, "part int, bits binary").collect():
        table[row["part"] * PART // 8 : (row["part"] + 1) * PART // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return table.tobytes()


def width_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_runs(texts: DataFrame, settings: Settings, buckets: int) -> DataFrame:
    """Packets of the edges and nodes of (lang, text), summed per task, and its words by language."""
    schema = arrow_schema()
    bits = texts.sparkSession.sparkContext.broadcast(frequent_slots(texts, settings))

    def run(batches):
        table = np.frombuffer(bits.value, np.uint8)
        packet, totals = Packet(settings.longest), {}

        def frequent(slots):
            return (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for batch in batches:
            for name, tokens, more in words_by_lang(batch):
                starts = max(0, len(tokens) - 4) if more else len(tokens)
                words = packet.numbers.of(tokens)
                totals[name] = totals.get(name, 0) + int(np.count_nonzero(words[:starts]))
                alone, pairs = packet.numbers.slots(name, words, settings.slots)
                columns = runs(np.where(frequent(alone), words, 0), frequent(pairs), starts, settings.longest)
                lang = np.full((1, columns.shape[1]), packet.lang(name), np.int32)
                packet.add(np.concatenate([lang, columns]), np.ones(columns.shape[1], np.int64))
                if max(packet.rows, len(packet.numbers)) >= PACKET_ROWS:
                    yield batch_of(list(packet.with_nodes().rows_out(buckets)), schema)
                    packet = Packet(settings.longest)
        out = [whole_row(lang, 0, "", n) for lang, n in totals.items()]
        if packet.rows:
            out += packet.with_nodes().rows_out(buckets)
        if out:
            yield batch_of(out, schema)

    return texts.mapInArrow(run, SCHEMA)


def summed_runs(rows: DataFrame, settings: Settings, partitions: int) -> DataFrame:
    """The frequent runs of all packets; the totals of languages go through."""
    schema = arrow_schema()

    def settle(packet: Packet) -> Iterator[pa.RecordBatch]:
        out = list(packet.frequent(settings.least)) if packet.rows else []
        if out:
            yield batch_of(out, schema)

    def run(batches):
        packet, current = Packet(settings.longest), None
        for batch in batches:
            whole = np.array(batch.column("phrase").is_valid())
            if whole.any():
                yield batch.filter(pa.array(whole))
            for row in batch.filter(pa.array(~whole)).to_pylist():
                if row["bucket"] != current:
                    yield from settle(packet)
                    packet, current = Packet(settings.longest), row["bucket"]
                packet.unpack(row)
        yield from settle(packet)

    return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, SCHEMA)


def frequent_runs(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(lang, size, phrase, n): runs of 1 to ``longest`` words with ``least`` or more occurrences,
    and per language a row of size 0 with the number of its words. Stored."""
    rows = without_clashes(docs, "lang", "text")
    texts = rows.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-size // settings.bucket_bytes))
    partitions = max(width_of(docs), -(-buckets // 4))
    found = summed_runs(text_runs(texts, settings, buckets), settings, partitions)
    found = found.select("lang", "size", "phrase", "n")
    # The totals of a language come from every task.
    return stored(found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")), "runs")


def absorbed(found: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, n) of the nodes whose whole flow goes over one edge that holds them.

    An edge is the run one word longer. A run inside any longer run of the same count is also
    inside one that is one word longer, because counts never rise with length.
    """
    edges = found.filter((F.col("size") > 1) & (F.col("size") <= longest))
    first = F.regexp_replace("phrase", " [^ ]*$", "")
    last = F.regexp_replace("phrase", "^[^ ]* ", "")
    return edges.select("lang", F.explode(F.array(first, last)).alias("phrase"), "n").distinct()


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to five words per language.

    Letters A-Z are lower-cased. Texts split into pieces at ``.,;:!?`` and U+000A-U+000D, pieces
    into words at spaces and tabs; phrases lie within pieces. ``n`` counts the words of the language
    (null: ``und``), ``a`` the phrase, ``l`` and ``r`` the two parts of the cut after the first k words
    that scores lowest, ``floor(1000 * a * n / (l * r))``; the smallest k of several. Products are
    exact decimals. Candidates occur ``least`` times; those inside a longer candidate of the same
    count are dropped. Ranks go by score, then ``a``, both descending, then phrase by its bytes.
    Null and empty texts hold nothing, texts of any length are read in slices, repeated rows count
    each time, and other columns are not looked at. No documents give no rows.
    """
    found = frequent_runs(docs, settings)
    phrases = found.filter("size >= 2")
    kept = phrases.join(absorbed(found, settings.longest), ["lang", "phrase", "n"], "left_anti")
    cuts = kept.select("lang", "size", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    words = F.split("phrase", " ")
    cuts = cuts.withColumn("first", F.array_join(F.slice(words, F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("rest", F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " "))
    counts = found.filter("size >= 1")
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    totals = found.filter("size = 0").select("lang", "n")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    score = F.expr("bigint((decimal(1000) * cast(a AS decimal(18,0)) * cast(n AS decimal(16,0))) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0))))")
    scored = scored.withColumn("score", score)
    worst = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(worst)
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = best.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= settings.best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
