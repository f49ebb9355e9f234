"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator assumes. They can be applied to a session
# somebody else created, because none of them is static.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even where that costs a later shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Apply "first n per group" before the shuffle for every request limit in use.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # Bytes of an Arrow batch: a Python worker holds a batch several times over.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


# Megabytes that one task reads, from files or from a shuffle; a session's smaller values stay. A
# megabyte of compressed rows takes some 15 MB in the hash table of an aggregate.
TASK_MEGABYTES = {
    "spark.sql.files.maxPartitionBytes": 32,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16,
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to ``spark``, touching only those that differ."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, most in TASK_MEGABYTES.items():
        if size_in_bytes(spark.conf.get(key)) > most << 20:
            spark.conf.set(key, f"{most}m")
    return spark


def size_in_bytes(text: str) -> int:
    """A size as Spark's settings write it: ``64MB``, ``16m``, ``134217728b`` or plain bytes."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", text.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit.strip("ib") or " ")


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foliometer")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``.

    Only a session on one machine may do without the setting; it gets a temporary folder.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith(("local[", "local-cluster[")) and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/foliometer/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``; survives the loss of executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def write_out(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back.

    Survives lost executors as a checkpoint does. A checkpoint also keeps what the optimizer
    has derived about the rows, which grows with every round of a loop; a table does not.
    """
    folder = scratch(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
