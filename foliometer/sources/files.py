"""Stored files."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.filenames import file_extension, sanitize_filename, sharded_path, stored_name
from ..functions.filters import timestamp
from ..session import cut_lineage

LARGEST_FILE = max(per_file for _, per_file, _ in C.PLAN_LIMITS.values()) * C.MEGABYTE
# Files of one folder that a listing task hands on at a time.
LISTED_ROWS = 10_000


def read_binary(
    spark: SparkSession, path: str, pattern: str | None = None, largest: int = LARGEST_FILE
) -> DataFrame:
    """Files under ``path`` as rows; larger ones come without content, as ``file_too_large``.

    The length filters are pushed into the listing, so larger files are never opened.
    Spark's file sources pass over empty files.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.load(path)
    read = found.filter(F.col("length") <= largest).withColumn("error", F.lit(None).cast("string"))
    listed = found.filter(F.col("length") > largest).drop("content")
    refused = listed.withColumns(
        {"content": F.lit(None).cast("binary"), "error": F.lit("file_too_large")}
    )
    return read.unionByName(refused)


def manifest(files: DataFrame, content: str = "content") -> DataFrame:
    """S3: checksum and size of each file instead of its content.

    A file that was not read has no checksum, and the ``length`` of its listing as its size.
    """
    size = F.octet_length(content).cast("long")
    if "length" in files.columns:
        size = F.coalesce(size, "length")
    return files.withColumns(
        {"checksum_sha256": F.sha2(content, 256), "size_bytes": size}
    ).drop(content)


FOUND = "path string, length long, modified timestamp, folder boolean"
CHUNK = 1 << 20


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of every file under ``path``, empty ones too; hidden ones not.

    Folders are listed level by level, each level's by all tasks together; ``path`` is a URI of
    a file system that all machines reach. Nothing is opened.
    """
    level = spark.createDataFrame([(path,)], "path string")

    def look(batches):
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                system, place = fs.FileSystem.from_uri(folder)
                prefix = folder.rstrip("/")
                infos = system.get_file_info(fs.FileSelector(place))
                infos = [i for i in infos if not i.base_name.startswith((".", "_"))]
                for at in range(0, len(infos), LISTED_ROWS):
                    some = infos[at : at + LISTED_ROWS]
                    columns = (
                        pa.array([f"{prefix}/{i.base_name}" for i in some], pa.string()),
                        pa.array([i.size for i in some], pa.int64()),
                        pa.array([i.mtime_ns // 1000 for i in some], pa.timestamp("us", "UTC")),
                        pa.array([i.type == fs.FileType.Directory for i in some], pa.bool_()),
                    )
                    yield pa.RecordBatch.from_arrays(list(columns), ["path", "length", "modified", "folder"])

    files = []
    while True:
        found = cut_lineage(level.mapInArrow(look, FOUND))
        files.append(found.filter(~F.col("folder")).drop("folder"))
        level = found.filter("folder").select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, files)
        level = level.repartition(spark.sparkContext.defaultParallelism * 2, "path")


def file_manifest(spark: SparkSession, path: str, largest: int = LARGEST_FILE) -> DataFrame:
    """S3: (path, size_bytes, modified, checksum_sha256, error) of every file under ``path``.

    Files are read in pieces of a megabyte, so none is held whole. Those above ``largest`` are
    not opened and marked ``file_too_large``. One that cannot be read is marked ``unreadable``.
    """
    found = list_files(spark, path)
    tasks = spark.sparkContext.defaultParallelism * 4

    def checksums(batches):
        for batch in batches:
            sums, errors = [], []
            for name, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                value, error = (None, "file_too_large") if length > largest else checksum(name)
                sums.append(value)
                errors.append(error)
            batch = batch.append_column("checksum_sha256", pa.array(sums, pa.string()))
            yield batch.append_column("error", pa.array(errors, pa.string()))

    shape = "path string, length long, modified timestamp, checksum_sha256 string, error string"
    read = found.repartition(tasks, "path").mapInArrow(checksums, shape)
    return read.withColumnRenamed("length", "size_bytes")


def checksum(name: str) -> tuple[str | None, str | None]:
    """(SHA-256, None) of a file, or (None, error)."""
    digest = hashlib.sha256()
    try:
        system, place = fs.FileSystem.from_uri(name)
        with system.open_input_stream(place) as data:
            while piece := data.read(CHUNK):
                digest.update(piece)
    except OSError:
        return None, "unreadable"
    return digest.hexdigest(), None


def write_contents(rows: DataFrame, folder: str) -> None:
    """Write a file per row of ``rows(relative_path, content)`` under ``folder``, also empty ones.

    A task that runs again writes the same files. Contents come row by row, not as a table.
    """

    def write(batches):
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = batch.column("relative_path").to_pylist()
            for name, content in zip(names, batch.column("content"), strict=True):
                target = f"{root}/{name}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["files"])

    chosen = rows.select("relative_path", F.col("content").cast("binary").alias("content"))
    chosen.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def scratch_entries(spark: SparkSession, path: str) -> DataFrame:
    """M2: path, size and modification time of scratch files; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "length", "modificationTime")


def allocate(rows: DataFrame, key: Column, extension: Column, created_at: Column) -> DataFrame:
    """``stored_name`` and date-sharded ``relative_path`` of new files."""
    name = stored_name(key, extension)
    return rows.withColumn("stored_name", name).withColumn(
        "relative_path", sharded_path(created_at, F.col("stored_name"))
    )


def write_by_day(rows: DataFrame, path: str, ts: str = "created_at") -> None:
    """Append rows partitioned by year, month and day.

    Adaptive execution sizes the write tasks: a busy day is split over several, quiet
    days share one, and no day is scattered over more files than its size needs.
    """
    parts = {"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"),
             "day": F.date_format(ts, "dd")}
    dated = rows.withColumns(parts).hint("rebalance", "year", "month", "day")
    dated.write.mode("append").partitionBy("year", "month", "day").parquet(path)


def stage_outputs(produced: DataFrame, jobs: DataFrame, now) -> DataFrame:
    """Outputs of jobs with everything both tables need.

    ``produced(job_id, position, download_name, media_type, size_bytes,
    checksum_sha256)``. The owner comes from the job, the file expires a day later.
    """
    owners = jobs.select(F.col("id").alias("job_id"), "user_id")
    created = timestamp(now)
    key = F.concat_ws(
        "|", F.col("job_id").cast("string"), F.lit("output"), F.col("position").cast("string")
    )
    staged = (
        produced.join(owners, "job_id", "inner")
        .withColumn("file_id", F.substring(F.sha2(key, 256), 1, 32))
        .withColumn("extension", file_extension("download_name"))
        .withColumn("original_name", sanitize_filename("download_name"))
        .withColumn("created_at", created)
        .withColumn("expires_at", created + F.expr(f"INTERVAL {C.RETENTION_HOURS} HOURS"))
    )
    return allocate(staged, F.col("file_id"), F.col("extension"), F.col("created_at"))


def output_files(staged: DataFrame) -> DataFrame:
    """Rows for ``stored_files``."""
    return staged.select(
        F.col("file_id").alias("id"),
        "original_name",
        "stored_name",
        F.lit("processed").alias("category"),
        "relative_path",
        "media_type",
        "extension",
        "size_bytes",
        F.lit("active").alias("status"),
        "created_at",
        "checksum_sha256",
        "user_id",
        "expires_at",
    )


def output_links(staged: DataFrame) -> DataFrame:
    """Rows for ``job_files``."""
    return staged.select("job_id", "file_id", F.lit("output").alias("role"), "position")
