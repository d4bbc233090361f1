"""The two event tables: layout, write, pruned read, retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from liftwise.operators import filters as fl
from liftwise.schemas import FLAG_EVALUATIONS, METRIC_EVENTS

EVALUATION_KEY = "flag_key"
EVENT_KEY = "event_name"


def event_month(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMM").cast("int")


def in_table_layout(df: DataFrame, key: str) -> DataFrame:
    """Arrange rows as the table is stored: by month, then env, key, day, user.

    Adaptive execution cuts the rows of a month and key into tasks of the
    advisory size, however many there are, and joins small ones. So no task gets
    a whole hot group and the number of tasks follows the data; each writes few
    months, sorted, with narrow key ranges in its files, which later scans can
    skip. The input is computed once.
    """
    order = ["event_month", "env_id", key, "_day", "user_key", "timestamp"]
    return (
        df.withColumn("event_month", event_month(F.col("timestamp")))
        .withColumn("_day", F.to_date("timestamp"))
        .hint("rebalance", "event_month", "env_id", key)
        .sortWithinPartitions(*order)
        .drop("_day")
    )


def write_events(df: DataFrame, path: str, key: str, mode: str = "append", **options: str) -> None:
    """Write one event table, partitioned by month."""
    writer = in_table_layout(df, key).write.mode(mode).partitionBy("event_month").option("compression", "zstd")
    for name, value in options.items():
        writer = writer.option(name, value)
    writer.parquet(path)


def write_tables(evals: DataFrame, events: DataFrame, path: str, mode: str = "append") -> None:
    write_events(evals, f"{path}/flag_evaluations", EVALUATION_KEY, mode)
    write_events(events, f"{path}/metric_events", EVENT_KEY, mode)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType(list(schema.fields)).add("event_month", T.IntegerType())).parquet(path)


def read_evaluations(
    spark: SparkSession, path: str, env_id: str, flag_key: str, start: str | dt.date, end: str | dt.date
) -> DataFrame:
    """Evaluations of one flag and window; months outside are not read."""
    df = _read(spark, f"{path}/flag_evaluations", FLAG_EVALUATIONS)
    return fl.scan_flag(fl.scan_environment(fl.scan_window(df, start, end), env_id), flag_key)


def read_events(
    spark: SparkSession, path: str, env_id: str, event_name: str, start: str | dt.date, end: str | dt.date
) -> DataFrame:
    """Events of one name and window; months outside are not read."""
    df = _read(spark, f"{path}/metric_events", METRIC_EVENTS)
    return fl.scan_event(fl.scan_environment(fl.scan_window(df, start, end), env_id), event_name)


def read_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Both tables whole, with their month column for pruning by the plans."""
    return (
        _read(spark, f"{path}/flag_evaluations", FLAG_EVALUATIONS),
        _read(spark, f"{path}/metric_events", METRIC_EVENTS),
    )


def expired_before(as_of: str | dt.date, days: int = 365) -> int:
    """The first month, yyyymm, that still holds rows younger than the retention period."""
    first = fl._date(as_of, "as_of") - dt.timedelta(days=days - 1)
    return int(first.strftime("%Y%m"))


def retained(df: DataFrame, as_of: str | dt.date, days: int = 365, ts: str = "timestamp") -> DataFrame:
    """Rows younger than the retention period: day + ``days`` lies after ``as_of``.

    On a month-partitioned table, months that are wholly expired are pruned.
    """
    as_of = fl._date(as_of, "as_of")
    oldest = as_of - dt.timedelta(days=days)  # this day itself has expired
    if "event_month" in df.columns:
        df = df.where(F.col("event_month") >= int(oldest.strftime("%Y%m")))
    first = oldest + dt.timedelta(days=1)
    return df.where(F.col(ts) >= F.lit(dt.datetime(first.year, first.month, first.day, tzinfo=dt.timezone.utc)))
