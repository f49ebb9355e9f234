"""Running streams, and tables in shared storage that they keep current."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..session import scratch

# Batches between two snapshots of a keyed log, and the buckets a snapshot is divided into.
SNAPSHOT_EVERY = 8
BUCKETS = 32
# The column by which a snapshot is divided; no other may have its name.
BUCKET = "bucket_of_key"
# Snapshots that are kept; older ones and the batches before them are removed.
SNAPSHOTS_KEPT = 2


class KeyedLog:
    """Latest row per key: a snapshot in buckets by key, and the batches since.

    Every micro-batch writes the rows that changed to a folder of its own; repeated after
    a failure, it overwrites that folder, so every batch counts once. After every ``every``
    batches snapshot and batches are merged into a new snapshot. It counts only once its
    pointer, a small file, is moved into place, so a merge that is cut off leaves the old one valid. A
    reader opens one snapshot and fewer than ``every`` batches, and with ``touched`` only the buckets
    that hold those keys, however many batches there have been.
    """

    def __init__(
        self, spark: SparkSession, folder: str, schema: T.StructType, keys,
        every: int = SNAPSHOT_EVERY, buckets: int = BUCKETS,
    ) -> None:
        self.spark, self.folder, self.keys = spark, folder, list(keys)
        self.every, self.buckets = every, buckets
        self.columns = T.StructType(list(schema.fields))
        self.schema = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])

    def _files(self):
        java = self.spark._jvm
        path = java.org.apache.hadoop.fs.Path(self.folder)
        return java, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        java, files = self._files()
        path = java.org.apache.hadoop.fs.Path(f"{self.folder}/{folder}")
        return [entry.getPath().getName() for entry in files.listStatus(path)] if files.exists(path) else []

    def _batches(self) -> list[int]:
        return sorted(int(name.split("=")[1]) for name in self._names("tail") if name.startswith("batch="))

    def _pointers(self) -> list[tuple[int, str]]:
        """(last batch, folder) of every snapshot that counts, oldest first."""
        names = [name.split("-", 1) for name in self._names("pointers") if not name.startswith(".")]
        return sorted((int(batch), name) for batch, name in names)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, batch: int) -> None:
        """Store the changed rows of a micro-batch; from time to time merge all into a snapshot."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/tail/batch={batch}")
        pointers = self._pointers()
        last = pointers[-1][0] if pointers else -1
        if batch - last >= self.every:
            self.publish(self.build(batch), batch)

    def build(self, batch: int) -> str:
        """Write a snapshot up to and including ``batch``; it does not count yet."""
        name = uuid.uuid4().hex
        rows = self._latest(self._rows(batch + 1)).withColumn(BUCKET, self._bucket())
        spread = rows.repartition(self.buckets, BUCKET)
        spread.write.partitionBy(BUCKET).parquet(f"{self.folder}/snapshots/{name}")
        return name

    def publish(self, name: str, batch: int) -> None:
        """Make a snapshot the one that counts, in one step, and remove what it replaces."""
        java, files = self._files()

        def path(*parts):
            return java.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

        draft = path("pointers", f".{name}")
        files.create(draft, True).close()
        files.rename(draft, path("pointers", f"{batch:015d}-{name}"))
        pointers = self._pointers()
        kept = pointers[-SNAPSHOTS_KEPT:]
        for number, folder in pointers[:-SNAPSHOTS_KEPT]:
            files.delete(path("pointers", f"{number:015d}-{folder}"), False)
        # What a merge that was cut off has written goes as well.
        for folder in set(self._names("snapshots")) - {folder for _, folder in kept}:
            files.delete(path("snapshots", folder), True)
        if len(kept) == SNAPSHOTS_KEPT:
            for number in self._batches():
                if number <= kept[0][0]:
                    files.delete(path("tail", f"batch={number}"), True)

    def _rows(self, before: int | None, touched: DataFrame | None = None) -> DataFrame:
        """Rows of the newest snapshot before a batch and of the batches between."""
        pointers = [p for p in self._pointers() if before is None or p[0] < before]
        last, name = pointers[-1] if pointers else (-1, None)
        rows = self.spark.createDataFrame([], self.schema)
        if name is not None:
            layout = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
            kept = self.spark.read.schema(layout).parquet(f"{self.folder}/snapshots/{name}")
            if touched is not None:
                wanted = touched.select(self._bucket().alias(BUCKET)).distinct().collect()
                kept = kept.filter(F.col(BUCKET).isin([row[BUCKET] for row in wanted]))
            rows = kept.drop(BUCKET)
        tail = [n for n in self._batches() if n > last and (before is None or n < before)]
        if tail:
            folder = f"{self.folder}/tail"
            reader = self.spark.read.schema(self.schema).option("basePath", folder)
            rows = rows.unionByName(reader.parquet(*[f"{folder}/batch={n}" for n in tail]))
        return rows

    def _latest(self, rows: DataFrame) -> DataFrame:
        others = [name for name in rows.columns if name not in (*self.keys, "batch")]
        newest = [F.max_by(F.struct(*others), "batch").alias("row")] if others else []
        latest = rows.groupBy(*self.keys).agg(F.max("batch").alias("batch"), *newest)
        return latest.select(*self.keys, *(["row.*"] if others else []), "batch")

    def read(self, before: int | None = None, touched: DataFrame | None = None) -> DataFrame:
        """Current rows, optionally as they were before a batch or of some keys only."""
        rows = self._rows(before, touched)
        if touched is not None:
            rows = rows.join(touched.select(*self.keys).distinct(), self.keys, "left_semi")
        return self._latest(rows).select(*self.columns.fieldNames())


def start(writer: DataStreamWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start a stream: with ``every`` it runs on, with an interval; else until nothing is left."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def drain_batches(
    stream: DataFrame, merge: Callable[[DataFrame, int], None], folder: str, mode: str = "append"
) -> None:
    """Hand every micro-batch to ``merge(batch, number)`` until nothing is left."""
    start_batches(stream, merge, folder, mode).awaitTermination()


def start_batches(
    stream: DataFrame, merge: Callable[[DataFrame, int], None], folder: str, mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Start handing micro-batches to ``merge(batch, number)``; the checkpoint is in ``folder``."""
    return start(stream.writeStream.outputMode(mode).foreachBatch(merge), f"{folder}/checkpoint", every)


@dataclass
class KeptTable:
    """A table that a started query keeps current.

    The query can be stopped at any time; starting it again over the same folder goes on from
    its checkpoint. Rows stay in the table when the watermark has removed their state.
    """

    query: StreamingQuery
    log: KeyedLog

    def rows(self) -> DataFrame:
        """The table as of the last whole micro-batch."""
        return self.log.read()

    def stop(self) -> None:
        self.query.stop()
        self.query.awaitTermination()


def keep_updates(stream: DataFrame, keys, folder: str, every: str | None = None) -> KeptTable:
    """Start an aggregation in update mode that keeps the last value of every key in ``folder``."""
    log = KeyedLog(stream.sparkSession, f"{folder}/rows", stream.schema, keys)
    return KeptTable(start_batches(stream, log.write, folder, "update", every), log)


def drain_updates(stream: DataFrame, keys, label: str, folder: str | None = None) -> DataFrame:
    """Run an aggregation in update mode and return the last value of every key.

    Windows that the watermark has not closed yet are included.
    """
    table = keep_updates(stream, keys, folder or scratch(stream.sparkSession, label))
    table.query.awaitTermination()
    return table.rows()
