"""Running results over the event streams: first exposures and daily rollups.

Aggregates run in update mode over day windows, so a watermark lets their state
go. Every batch adds the groups it changed as a part of a table; readers merge
the versions of a group, and parts are folded by the same merge. Nothing is
updated in place, and a reader sees either the parts or what they were folded
into.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from liftwise.sources.generations import FAN_IN, Generations
from liftwise.streaming.ingest import interval_micros

FIRST_EXPOSURES = "env_id string, flag_key string, user_key string, first struct<timestamp: timestamp, variant: string>"
DAILY_EVENTS = (
    "date date, env_id string, event_name string, users_sketch binary, events bigint, value_sum double, value_sum_sq double, batch bigint"
)

_DAY = 86_400_000_000


def run_versions(
    changes: DataFrame, table: Generations, merge: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True, fan_in: int = FAN_IN
) -> StreamingQuery:
    """Add each batch's changed groups to ``table`` and fold its parts by ``merge`` as they gather."""

    def write(df: DataFrame, batch: int) -> None:
        table.append(df.withColumn("batch", F.lit(batch).cast("bigint")), batch)
        table.compact(merge, fan_in)

    writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def first_exposure_table(spark: SparkSession, path: str) -> Generations:
    return Generations(spark, path, FIRST_EXPOSURES)


def running_first_exposures(evals: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Earliest (instant, variant) per (env, flag, user) and day, as evaluations arrive.

    A user's first exposure is the smallest of all days, taken at read. State is
    one small row per user and day, and goes when the watermark has passed the
    day: it holds the users of the last days, not of all time. An evaluation
    that arrives late by up to ``lateness``, yet is earlier, still corrects its
    day. Later ones never get here: ingest quarantines them by the same bound.
    """
    return (
        evals.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 day"), "env_id", "flag_key", "user_key")
        .agg(F.min(F.struct("timestamp", "variant")).alias("first"))
        .drop("window")
    )


def merge_first_exposures(versions: DataFrame) -> DataFrame:
    """The smallest version wins, whatever order they came in."""
    return versions.groupBy("env_id", "flag_key", "user_key").agg(F.min("first").alias("first"))


def read_first_exposures(table: Generations) -> DataFrame:
    return merge_first_exposures(table.read()).select(
        "env_id", "flag_key", "user_key", F.col("first.variant").alias("variant"), F.col("first.timestamp").alias("exposure_ts")
    )


def daily_event_table(spark: SparkSession, path: str) -> Generations:
    return Generations(spark, path, DAILY_EVENTS)


def daily_events(events: DataFrame, lateness: str = "2 days", precision: int = 14) -> DataFrame:
    """Events, sums and a user sketch per (env, event, day), updated as data arrives; a day's state goes with the watermark."""
    v = F.col("numeric_value")
    day = F.window("timestamp", "1 day").alias("day")
    return events.withWatermark("timestamp", lateness).groupBy(day, "env_id", "event_name").agg(
        F.hll_sketch_agg("user_key", precision).alias("users_sketch"), F.count("*").alias("events"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("value_sum"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("value_sum_sq"),
    ).select(F.to_date("day.start").alias("date"), "env_id", "event_name", "users_sketch", "events", "value_sum", "value_sum_sq")


def merge_daily_events(versions: DataFrame) -> DataFrame:
    """The last version of each day's rollup."""
    columns = ["users_sketch", "events", "value_sum", "value_sum_sq"]
    last = versions.groupBy("date", "env_id", "event_name").agg(F.max_by(F.struct(*columns), "batch").alias("v"), F.max("batch").alias("batch"))
    return last.select("date", "env_id", "event_name", "v.*", "batch")


def read_daily_events(table: Generations) -> DataFrame:
    return merge_daily_events(table.read()).drop("batch")


def daily_exposed_users(evals: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Each user once per (env, flag, variant, day): the exact-distinct state as a stream of rows.

    A user's rows of one day may lie a day apart, so with a shorter ``lateness``
    a repeat could come after its key was forgotten; that is refused.
    """
    if interval_micros(evals.sparkSession, lateness) < _DAY:
        raise ValueError("lateness must be a day at least, for a day's repeats to be recognised")
    return (
        evals.withColumn("date", F.to_date("timestamp"))
        .withWatermark("timestamp", lateness)
        .dropDuplicatesWithinWatermark(["env_id", "flag_key", "variant", "date", "user_key"])
        .select("env_id", "flag_key", "variant", "date", "user_key")
    )


def run_rows(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream of rows to a table."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(path)
