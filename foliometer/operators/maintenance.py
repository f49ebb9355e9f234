"""Table maintenance, snapshot in and snapshot out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.filters import expired_file, expired_job, timestamp
from ..functions.text import normal_email, strip
from .skew import attach


def expire_files(files: DataFrame, now, expires: str = "expires_at") -> DataFrame:
    """M1: files past retention become expired."""
    due = expired_file(now, expires)
    return files.withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def expire_jobs(jobs: DataFrame, now, expires: str = "expires_at") -> DataFrame:
    """M1: finished jobs past retention become expired."""
    due = expired_job(now, expires)
    return jobs.withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def retention_summary(files, jobs, scratch, now, expires: str = "expires_at") -> DataFrame:
    """How much one sweep expires or removes."""
    counts = [
        files.agg(F.count_if(expired_file(now, expires)).alias("n")).select(
            F.lit("files_removed").alias("what"), "n"
        ),
        jobs.agg(F.count_if(expired_job(now, expires)).alias("n")).select(
            F.lit("jobs_expired").alias("what"), "n"
        ),
    ]
    if scratch is not None:
        stale = stale_scratch(scratch, now).agg(F.count("*").alias("n"))
        counts.append(stale.select(F.lit("temp_workspaces_removed").alias("what"), "n"))
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result


def stale_scratch(
    entries: DataFrame, now, max_age_minutes: int = C.SCRATCH_MAX_AGE_MINUTES
) -> DataFrame:
    """M2: scratch entries last modified before the cutoff (``modificationTime``)."""
    cutoff = timestamp(now) - F.expr(f"INTERVAL {int(max_age_minutes)} MINUTES")
    return entries.filter(F.col("modificationTime") < cutoff)


def _listed(ids: DataFrame, key: str) -> DataFrame:
    return ids.select(F.col(key)).distinct().withColumn("__listed", F.lit(True))


def bulk_users(users: DataFrame, ids: DataFrame, action: str) -> DataFrame:
    """M3: delete, suspend or activate the listed users.

    ``changed`` marks the rows a suspension or activation really altered; after a
    deletion the listed users are gone.
    """
    if action == "delete":
        return users.join(ids.select("id"), "id", "left_anti").withColumn("changed", F.lit(False))
    if action not in ("suspend", "activate"):
        raise ValueError(f"action must be delete, suspend or activate, not {action!r}")
    target = "suspended" if action == "suspend" else "active"
    joined = users.join(_listed(ids, "id"), "id", "left")
    changed = F.col("__listed").isNotNull() & (F.col("status") != target)
    return (
        joined.withColumn("changed", changed)
        .withColumn("status", F.when(F.col("changed"), target).otherwise(F.col("status")))
        .drop("__listed")
    )


def patch(df: DataFrame, patches: DataFrame, key: str, order: str) -> DataFrame:
    """M4: non-null fields of a patch overwrite; later patches (``order``) win per field."""
    fields = [name for name in patches.columns if name not in (key, order)]
    latest = [
        F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(f"__{name}")
        for name in fields
    ]
    changes = patches.groupBy(key).agg(*latest)
    joined = df.join(changes, key, "left")
    return joined.select(
        *[
            F.coalesce(f"__{name}", name).alias(name) if name in fields else F.col(name)
            for name in df.columns
        ]
    )


def forget_owner(df: DataFrame, deleted: DataFrame, column: str = "user_id") -> DataFrame:
    """M5: rows of deleted users stay, without their owner."""
    gone = deleted.select(F.col("id").alias(column)).distinct().withColumn("__gone", F.lit(True))
    joined = attach(df, gone, [column], ["id"])
    owner = F.when(F.col("__gone").isNull(), F.col(column))
    return joined.withColumn(column, owner).select(*df.columns)


def cascade(df: DataFrame, deleted: DataFrame, column: str) -> DataFrame:
    """M5: rows that refer to a deleted parent are deleted with it."""
    return df.join(deleted.select(F.col("id").alias(column)), column, "left_anti")


def delete_files(files: DataFrame, ids: DataFrame) -> DataFrame:
    """M6: soft deletion."""
    joined = files.join(_listed(ids, "id"), "id", "left")
    status = F.when(F.col("__listed"), "deleted").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("__listed")


def cancel_jobs(jobs: DataFrame, ids: DataFrame, now) -> DataFrame:
    """M7: cancel unfinished jobs; ``rejected`` marks listed jobs that had finished."""
    joined = jobs.join(_listed(ids, "id"), "id", "left")
    listed = F.col("__listed").isNotNull()
    finished = F.col("status").isin(*C.TERMINAL_STATUSES)
    return (
        joined.withColumn("rejected", listed & finished)
        .withColumn("__cancel", listed & ~finished)
        .withColumn("finished_at", F.when(F.col("__cancel"), timestamp(now)).otherwise(
            F.col("finished_at")))
        .withColumn("status", F.when(F.col("__cancel"), "cancelled").otherwise(F.col("status")))
        .drop("__listed", "__cancel")
    )


def retry_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """M7: listed jobs go back to the queue; the start time is kept."""
    joined = jobs.join(_listed(ids, "id"), "id", "left")
    listed = F.col("__listed").isNotNull()
    reset = {
        "status": F.lit("queued"),
        "progress": F.lit(0),
        "error_code": F.lit(None),
        "error_message": F.lit(None),
        "finished_at": F.lit(None),
    }
    for name, value in reset.items():
        if name in jobs.columns:
            kind = jobs.schema[name].dataType
            new = F.when(listed, value.cast(kind)).otherwise(F.col(name))
            joined = joined.withColumn(name, new)
    return joined.drop("__listed")


def register_users(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """M8: new users with an unused e-mail address, letter case ignored.

    Of equal addresses within the batch the first (``created_at``, ``id``) is taken:
    a minimum per address, which is reduced before the shuffle.
    """
    cleaned = candidates.withColumns({"email": normal_email("email"), "name": strip("name")})
    place = F.struct("created_at", "id")
    first = cleaned.groupBy("email").agg(F.min_by(F.struct(*cleaned.columns), place).alias("u"))
    taken = users.select(F.lower("email").alias("email"))
    return first.join(taken, "email", "left_anti").select("u.*")


def _members(value: Column) -> Column:
    """Members of a JSON object by name; NULL for any other value."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _laid_over(below: Column, above: Column, depth: int) -> Column:
    if not depth:
        return above
    both = F.map_zip_with(
        _members(below),
        _members(above),
        lambda _, x, y: F.when(y.isNull(), x).when(x.isNull(), y).otherwise(
            _laid_over(x, y, depth - 1)),
    )
    # ``both`` is named once: twice would double the expression on every level.
    return F.coalesce(F.to_variant_object(both), above)


def _levels(value: str) -> Column:
    """How deeply objects and lists of a JSON text lie in one another."""
    bare = F.regexp_replace(value, r'"(?:[^"\\]|\\.)*+"', "")
    marks = F.split(F.regexp_replace(bare, r"[^{}\[\]]+", ""), "")
    step = lambda mark: F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)
    deepest = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda seen, mark: F.struct(
            (seen["now"] + step(mark)).alias("now"),
            F.greatest(seen["top"], seen["now"] + step(mark)).alias("top"),
        ),
    )
    return deepest["top"]


def overlay_settings(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Settings per key with overrides laid over them: objects are merged,
    lists and scalars replaced.

    Merged objects list their members by name. A key without an override, or only there,
    keeps its text. A first pass counts the levels that both sides of a key have at most;
    the expression that merges them is that deep. More than 40 levels are refused.
    """
    above = overrides.select("key", F.col("value").alias("__above"))
    joined = base.select("key", "value").join(above, "key", "full")
    pairs = base.select("key", "value").join(above, "key")
    shared = F.max(F.least(_levels("value"), _levels("__above")))
    depth = pairs.agg(shared.alias("depth")).first().depth or 0
    if depth > C.SETTINGS_DEPTH:
        raise ValueError(f"settings share {depth} levels; at most {C.SETTINGS_DEPTH} can be merged")
    merged = F.to_json(_laid_over(F.parse_json("value"), F.parse_json("__above"), depth))
    one_side = F.col("value").isNull() | F.col("__above").isNull()
    value = F.when(one_side, F.coalesce("value", "__above")).otherwise(merged)
    return joined.select("key", value.alias("value"))


def mark_read(messages: DataFrame, ids: DataFrame, read: bool = True) -> DataFrame:
    """Read flag of the listed messages."""
    joined = messages.join(_listed(ids, "id"), "id", "left")
    flag = F.when(F.col("__listed"), F.lit(read)).otherwise(F.col("is_read"))
    return joined.withColumn("is_read", flag).drop("__listed")


def reply_messages(messages: DataFrame, replies: DataFrame, now) -> DataFrame:
    """A reply (``id, reply``) also sets its time and the read flag."""
    given = replies.groupBy("id").agg(F.max("reply").alias("__reply"))
    joined = messages.join(given, "id", "left")
    hit = F.col("__reply").isNotNull()
    return (
        joined.withColumn("reply", F.coalesce("__reply", "reply"))
        .withColumn("replied_at", F.when(hit, timestamp(now)).otherwise(F.col("replied_at")))
        .withColumn("is_read", F.col("is_read") | hit)
        .drop("__reply")
    )


def latest_per_key(df: DataFrame, keys, order) -> DataFrame:
    """Newest row per key; the rank filter is applied before the shuffle as well."""
    ranking = W.partitionBy(*keys).orderBy(*[F.desc_nulls_last(name) for name in order])
    return (
        df.withColumn("__rank", F.row_number().over(ranking))
        .filter(F.col("__rank") == 1)
        .drop("__rank")
    )
