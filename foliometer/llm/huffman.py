"""Token files: canonical length-limited Huffman codes with bit-offset checkpoints.

A code is made from the counts of all ids in the corpus. A token file holds whole
documents in ascending order of their id. Its layout, little-endian:

    magic       8 bytes  b"TOKHUF01"
    part, seq   2 x u32  place of the file in the order of all files
    start       u64      ids of the same part in earlier files
    n_docs, n_ids, n_blocks, interval   4 x u64
    table_crc   u32      of the code lengths, which lie beside the files once
    nulls       n_docs x u8, document ids n_docs x i64, their ids n_docs x u64
    blocks      n_blocks x (n_ids u32, n_bytes u32)
    then per block: checkpoints, a u32 bit offset per ``interval`` ids, and the bits

Blocks and checkpoints can be decoded on their own: a decoder starts at every checkpoint at
once and looks up a fixed number of bits per step in one table.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch
from .common import map_batches, stored, without_clashes
from .files import write_file
from .tokens import vocabulary, word_ids

MAGIC = b"TOKHUF01"
HEADER = "<8s2I5QI"
BLOCK_IDS = 65_536
INTERVAL = 256
FILE_IDS = 1_000_000
SHORTEST_LIMIT = 16


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits, by package-merge.

    0 for entries without counts; an only entry has length 1.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 2**limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    packages, leaves = np.zeros(0, np.int64), []
    for _ in range(limit):
        every = np.concatenate([weights, packages])
        at = np.argsort(every, kind="stable")
        leaves.append(at < len(weights))
        every = every[at]
        packages = every[: len(every) // 2 * 2].reshape(-1, 2).sum(axis=1)
    taken = 2 * len(weights) - 2
    for is_leaf in reversed(leaves):
        n_leaves = int(np.count_nonzero(is_leaf[:taken]))
        lengths[order[:n_leaves]] += 1
        taken = 2 * (taken - n_leaves)
    return lengths


@dataclass(frozen=True)
class Code:
    """Canonical codes by id, and the decoding table; both follow from the lengths."""

    lengths: np.ndarray
    codes: np.ndarray
    table: np.ndarray
    bits: int

    @classmethod
    def of(cls, lengths: np.ndarray) -> Code:
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        bits = max(1, int(lengths.max(initial=1)))
        width = np.int64(1) << (bits - lengths[order].astype(np.int64))
        first = np.concatenate([[0], np.cumsum(width)[:-1]]) if len(order) else width
        codes = np.zeros(len(lengths), np.uint64)
        codes[order] = first >> (bits - lengths[order].astype(np.int64))
        table = np.zeros(2**bits, np.uint32)
        filled = np.repeat(order.astype(np.uint32) << np.uint32(5) | lengths[order], width)
        table[: len(filled)] = filled
        return cls(lengths.astype(np.int64), codes, table, bits)


def encode_block(ids: np.ndarray, code: Code, interval: int) -> tuple[np.ndarray, bytes]:
    """Checkpoints and bits of one block; every id must have a code."""
    size = code.lengths[ids]
    if (size == 0).any():
        raise ValueError("an id has no code")
    ends = np.cumsum(size)
    starts = ends - size
    # A code of at most 32 bits touches two words of 32 bits.
    word, shift = starts >> 5, (64 - (starts & 31) - size).astype(np.uint64)
    value = code.codes[ids] << shift
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    data = out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8]
    return starts[::interval].astype("<u4"), data


def decode(data: bytes, checkpoints: np.ndarray, counts: np.ndarray, code: Code, interval: int) -> np.ndarray:
    """Ids behind all checkpoints: ``counts`` each, at most ``interval``; bit offsets into data."""
    padded = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    at_byte = (padded[:-3] << np.uint32(24)) | (padded[1:-2] << np.uint32(16))
    at_byte |= (padded[2:-1] << np.uint32(8)) | padded[3:]
    position = checkpoints.astype(np.int64)
    last = 8 * len(data)
    out = np.empty((interval, len(position)), np.uint32)
    shift, mask = np.uint32(32 - code.bits), np.uint32(2**code.bits - 1)
    # The bits of an entry start inside a byte, so 7 more than its own are needed.
    for step in range(int(counts.max(initial=0))):
        word = at_byte[position >> 3]
        entry = code.table[(word >> (shift - (position & 7).astype(np.uint32))) & mask]
        out[step] = entry >> np.uint32(5)
        position = np.minimum(position + (entry & np.uint32(31)), last)
    return out.T[np.arange(interval) < counts[:, None]]


def pack_file(part: int, seq: int, start: int, keys: list, ids: list[np.ndarray], code: Code, crc: int) -> bytes:
    """The bytes of one token file."""
    every = np.concatenate(ids)
    blocks = [encode_block(every[at : at + BLOCK_IDS], code, INTERVAL) for at in range(0, len(every), BLOCK_IDS)]
    sizes = [min(BLOCK_IDS, len(every) - at) for at in range(0, len(every), BLOCK_IDS)]
    parts = [
        struct.pack(HEADER, MAGIC, part, seq, start, len(keys), len(every), len(blocks), INTERVAL, crc),
        np.array([key is None for key in keys], np.uint8).tobytes(),
        np.array([key or 0 for key in keys], "<i8").tobytes(),
        np.array([len(x) for x in ids], "<u8").tobytes(),
        np.array([(n, len(bits)) for n, (_, bits) in zip(sizes, blocks, strict=True)], "<u4").tobytes(),
    ]
    for checkpoints, bits in blocks:
        parts += [checkpoints.tobytes(), bits]
    return b"".join(parts)


def unpack_file(data: bytes, code: Code, crc: int):
    """(part, seq, start, document keys, ids of each) of a token file."""
    magic, part, seq, start, n_docs, n_ids, n_blocks, interval, table_crc = struct.unpack_from(HEADER, data)
    if magic != MAGIC or table_crc != crc:
        raise ValueError("not a token file of this code")
    at = struct.calcsize(HEADER)

    def read(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, count, at)
        at += found.nbytes
        return found

    nulls, keys, lengths = read("u1", n_docs), read("<i8", n_docs), read("<u8", n_docs)
    sizes = read("<u4", 2 * n_blocks).reshape(-1, 2).astype(np.int64)
    checkpoints, counts, bits, offset = [], [], [], 0
    for n, n_bytes in sizes.tolist():
        found = read("<u4", -(-n // interval)).astype(np.int64)
        checkpoints.append(found + 8 * offset)
        counts.append(np.minimum(interval, n - interval * np.arange(len(found))))
        bits.append(data[at : at + n_bytes])
        at += n_bytes
        offset += n_bytes
    ids = np.zeros(0, np.uint32)
    if n_ids:
        ids = decode(b"".join(bits), np.concatenate(checkpoints), np.concatenate(counts), code, interval)
    names = [None if null else key for null, key in zip(nulls.tolist(), keys.tolist(), strict=True)]
    return part, seq, start, names, np.split(ids, np.cumsum(lengths[:-1].astype(np.int64)))


def id_type(path: str, end: int | None) -> str:
    """The narrowest unsigned integers that hold every id of a vocabulary and ``end``."""
    largest = max(max(word_ids(path).tokenizer.get_vocab().values()), end or 0)
    return "<u2" if largest < 2**16 else "<u4"


def tokenized(
    docs: DataFrame, path: str | None = None, end: int | None = 1, key: str = "doc_id", kind: str = "<u4"
) -> DataFrame:
    """(key long, ids binary): ids of each whole text as little-endian integers of ``kind``.

    A null or empty text has no ids but ``end``; no row is left out.
    """
    path = path or vocabulary()

    def start():
        known = word_ids(path)
        width = np.dtype(kind).itemsize

        def work(batch):
            ids, lengths = known.of(batch.column(1), end)
            offsets = np.zeros(len(lengths) + 1, np.int64)
            np.cumsum(width * lengths, out=offsets[1:])
            data = pa.py_buffer(ids.astype(kind).tobytes())
            large = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), data])
            yield [batch.column(0), large.cast(pa.binary())]

        return work

    rows = without_clashes(docs, key, "text").withColumn(key, F.col(key).cast("long"))
    return map_batches(rows, start, f"{key} long, ids binary")


def id_counts(tokens: DataFrame, kind: str = "<u4") -> np.ndarray:
    """How often each id occurs in all documents; at most one row per vocabulary entry."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = np.bincount(np.frombuffer(data, kind))
                if len(found) > len(total):
                    total, found = found, total
                total[: len(found)] += found
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = rows.toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


@dataclass(frozen=True)
class TokenFiles:
    """Where token files lie, the code they share, and the ids of each part."""

    folder: str
    lengths: np.ndarray
    parts: DataFrame


def write_tokens(
    tokens: DataFrame, key: str = "doc_id", folder: str | None = None, kind: str = "<u4"
) -> TokenFiles:
    """Encode a stored table of ``tokenized`` documents into files in ascending key order.

    Null keys come first, rows of equal keys in the order of a hash of their ids. Documents
    are range-partitioned, so no task holds more than its range, and files are cut at about
    a million ids. The code lengths (one byte per vocabulary entry) go to every task.
    """
    spark = tokens.sparkSession
    folder = folder or scratch(spark, "tokens")
    counts = id_counts(tokens, kind)
    limit = max(SHORTEST_LIMIT, int(np.ceil(np.log2(max(2, np.count_nonzero(counts))))) + 1)
    lengths = code_lengths(counts, limit)
    write_file(f"{folder}/code", "lengths.bin", lengths.tobytes())
    crc = zlib.crc32(lengths.tobytes())
    ordered = tokens.withColumn("tie", F.xxhash64("ids")).repartitionByRange(key, "tie")
    ordered = ordered.sortWithinPartitions(key, "tie", "ids").select(key, "ids")

    def run(batches):
        code = Code.of(lengths)
        part, seq, before, n_ids = TaskContext.get().partitionId(), 0, 0, 0
        keys, ids = [], []

        def finish():
            name = f"part-{part:06d}-{seq:06d}.tok"
            write_file(f"{folder}/files", name, pack_file(part, seq, before, keys, ids, code, crc))
            row = [pa.array([part]), pa.array([n_ids])]
            return pa.RecordBatch.from_arrays(row, ["part", "n_ids"])

        for batch in batches:
            for name, data in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                keys.append(name)
                ids.append(np.frombuffer(data, kind))
                n_ids += len(ids[-1])
                if n_ids >= FILE_IDS:
                    yield finish()
                    seq, before, n_ids, keys, ids = seq + 1, before + n_ids, 0, [], []
        if keys:
            yield finish()

    written = stored(ordered.mapInArrow(run, "part long, n_ids long"), "token-parts")
    totals = written.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    # One row per task that wrote files.
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))
    return TokenFiles(folder, lengths, parts)


def read_tokens(spark, files: TokenFiles, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Documents read back from token files: (key, start, n_tokens, ids_crc32[, ids])."""
    lengths = files.lengths
    crc = zlib.crc32(lengths.tobytes())

    def start():
        code = Code.of(lengths)

        def work(batch):
            for data in batch.column(0):
                part, _, first, keys, ids = unpack_file(data.as_py(), code, crc)
                sizes = np.array([len(x) for x in ids], np.int64)
                raw = [x.astype("<u4").tobytes() for x in ids]
                columns = [
                    pa.array([part] * len(keys), pa.int64()),
                    pa.array(keys, pa.int64()),
                    pa.array(first + np.cumsum(sizes) - sizes),
                    pa.array(sizes),
                    pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                ]
                yield [*columns, pa.array(raw, pa.binary())] if keep_ids else columns

        return work

    schema = f"part long, {key} long, start long, n_tokens long, ids_crc32 long"
    if files.parts.isEmpty():
        return spark.createDataFrame([], schema + ", ids binary" * keep_ids).drop("part")
    content = spark.read.format("binaryFile").load(f"{files.folder}/files").select("content")
    rows = map_batches(content, start, schema + ", ids binary" * keep_ids)
    # The parts are as many as the tasks that wrote them.
    return (
        rows.join(F.broadcast(files.parts), "part")
        .withColumn("start", F.col("start") + F.col("before"))
        .drop("part", "before")
    )


def round_trip(docs: DataFrame, path: str | None = None, end: int | None = 1) -> DataFrame:
    """Encode all documents into token files and read them back.

    A null text counts as empty, an empty table gives no rows, other columns are passed over.
    """
    path = path or vocabulary()
    kind = id_type(path, end)
    tokens = stored(tokenized(docs, path, end, kind=kind), "ids")
    return read_tokens(docs.sparkSession, write_tokens(tokens, kind=kind))
