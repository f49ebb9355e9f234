"""Jobs with their files: look-ups, nesting, admission, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import plan_limits
from .prefix import running_total

FILES_PER_ROW = 1000


def with_user_email(df: DataFrame, users: DataFrame, name: str = "user_email") -> DataFrame:
    """Left look-up of the owner's e-mail address.

    Rows without an owner match nobody. They are given a spread key, so that the
    anonymous rows do not meet in one partition.
    """
    owners = users.select(
        F.col("id").alias("__owner"), F.lit(0).alias("__spread"), F.col("email").alias(name)
    )
    spread = F.when(
        F.col("user_id").isNull(), F.pmod(F.xxhash64("id"), F.lit(4096)).cast("int") + 1
    ).otherwise(0)
    keyed = df.withColumn("__spread", spread)
    on = (F.col("user_id") == F.col("__owner")) & (keyed["__spread"] == owners["__spread"])
    joined = keyed.join(owners, on, "left")
    return joined.select(*[keyed[column] for column in df.columns], owners[name])


def latest_tool_of_file(job_files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per file, the tool of the newest job that touches it in any role.

    Equally old jobs are told apart by the larger job id.
    """
    links = job_files.select("job_id", "file_id")
    dated = jobs.select(F.col("id").alias("job_id"), "tool", "created_at")
    return (
        links.join(dated, "job_id", "inner")
        .groupBy("file_id")
        .agg(F.max_by("tool", F.struct("created_at", "job_id")).alias("tool"))
    )


def latest_subscription(subscriptions: DataFrame) -> DataFrame:
    """Newest subscription of each user."""
    others = [name for name in subscriptions.columns if name != "user_id"]
    newest = F.max_by(F.struct(*others), F.struct("created_at", "id")).alias("s")
    return subscriptions.groupBy("user_id").agg(newest).select("user_id", "s.*")


def with_subscriber(subscriptions: DataFrame, users: DataFrame) -> DataFrame:
    """Subscriptions of existing users with name and e-mail."""
    people = users.select(
        F.col("id").alias("user_id"),
        F.col("name").alias("user_name"),
        F.col("email").alias("user_email"),
    )
    return subscriptions.join(people, "user_id", "inner")


def _named_links(job_files: DataFrame, files: DataFrame) -> DataFrame:
    names = files.select(F.col("id").alias("file_id"), "original_name")
    return job_files.join(names, "file_id", "left")


def naming_files(job_files: DataFrame) -> DataFrame:
    """The file that names each job: its first input, else its first linked file."""
    place = F.struct(F.col("role") != "input", "position", "file_id")
    return job_files.groupBy("job_id").agg(F.min_by("file_id", place).alias("file_id"))


def display_names(job_files: DataFrame, files: DataFrame) -> DataFrame:
    """Name of a job (see ``naming_files``).

    A link whose file is gone still takes its place and then yields no name. Names are
    looked up for one file per job, not for every link.
    """
    return names_of(naming_files(job_files), files)


def names_of(naming: DataFrame, files: DataFrame) -> DataFrame:
    """(job_id, file_name) from the file that names each job."""
    names = files.select(F.col("id").alias("file_id"), F.col("original_name").alias("file_name"))
    return naming.join(names, "file_id", "left").select("job_id", "file_name")


def nested_files(job_files: DataFrame, files: DataFrame, per_row: int = FILES_PER_ROW) -> DataFrame:
    """Files of each job as arrays in position order, inputs and outputs apart.

    A row holds up to ``per_row`` files, ``part`` 0 the first ones of the job and role, so
    that no row and no task holds an unbounded list.
    """
    keys = ["job_id", "role"]
    item = F.struct("position", "file_id", "original_name")
    links = job_files.select(*keys, "position", "file_id")
    ranked = running_total(links, keys, ["position", "file_id"], F.lit(1), "rank")
    part = F.floor((F.col("rank") - 1) / per_row).alias("part")
    files_of = F.array_sort(F.collect_list(item)).alias("files")
    return _named_links(ranked, files).groupBy(*keys, part).agg(files_of)


def run_summary(job_files: DataFrame, files: DataFrame) -> DataFrame:
    """Inputs, input bytes and outputs of each job."""
    sizes = files.select(F.col("id").alias("file_id"), "size_bytes")
    is_input = F.col("role") == "input"
    return (
        job_files.select("job_id", "file_id", "role")
        .join(sizes, "file_id", "left")
        .groupBy("job_id")
        .agg(
            F.count_if(is_input).alias("input_files"),
            F.coalesce(F.sum(F.when(is_input, F.col("size_bytes"))), F.lit(0)).alias(
                "input_bytes"
            ),
            F.count_if(F.col("role") == "output").alias("output_files"),
        )
    )


def get_many(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Files of request lists (``request_id, ids``) in the order asked for.

    Missing ids drop out, repeated ones come back repeatedly; ``pos`` holds the order
    within a request.
    """
    wanted = requests.select("request_id", F.posexplode("ids").alias("pos", "id"))
    return wanted.join(files, "id", "inner")


def admit_jobs(requests: DataFrame, request_files: DataFrame, files, tools) -> DataFrame:
    """admission of job requests, first failed rule in ``reason``.

    ``requests(request_id, tool, user_id, plan)``, ``request_files(request_id, position,
    file_id)``, ``tools(tool, min_files, max_files, extensions)``. Per-file rules are
    checked file by file in request order, before the rule on the combined size.
    """
    demands = requests.join(tools, "tool", "inner").withColumn("limits", plan_limits("plan"))
    stored = files.select(
        F.col("id").alias("file_id"),
        F.col("user_id").alias("owner"),
        "status",
        "extension",
        "size_bytes",
    )
    checked = (
        request_files.join(stored, "file_id", "left")
        .join(
            demands.select("request_id", "user_id", "extensions", "limits.max_file_bytes"),
            "request_id",
            "inner",
        )
        .withColumn(
            "problem",
            F.when(
                F.coalesce(F.col("status") != "active", F.lit(True))
                | ~F.col("owner").eqNullSafe(F.col("user_id")),
                "not_found",
            )
            .when(~F.array_contains("extensions", F.col("extension")), "unsupported_type")
            .when(F.col("size_bytes") > F.col("max_file_bytes"), "file_too_large"),
        )
        .groupBy("request_id")
        .agg(
            F.count("*").alias("n_files"),
            F.sum("size_bytes").alias("total_bytes"),
            F.min_by(
                "problem", F.when(F.col("problem").isNotNull(), F.col("position"))
            ).alias("problem"),
        )
    )
    reason = (
        F.when(~F.col("n_files").between(F.col("min_files"), F.col("max_files")), "file_count")
        .when(F.col("n_files") > F.col("limits.max_files"), "plan_file_count")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("total_bytes") > F.col("limits.max_total_bytes"), "total_too_large")
    )
    return (
        demands.join(checked, "request_id", "left")
        .na.fill(0, ["n_files", "total_bytes"])
        .withColumn("reason", reason)
        .select(
            "request_id",
            "tool",
            "n_files",
            "total_bytes",
            F.col("reason").isNull().alias("admitted"),
            "reason",
        )
    )
