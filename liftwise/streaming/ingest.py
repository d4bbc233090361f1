"""Streaming ingest of payloads into the two event tables.

Each batch lands as one part of a table whose manifest says what is visible, so
a batch that is replayed after a failure lands once, and the parts of many
small batches are merged without any reader noticing. Load is limited at the
source instead of dropping events. With a ``delay`` given, repeats are dropped
and rows that come too late go to a table of their own: every row is kept, a
repeat, or quarantined, and counted as such.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from liftwise.schemas import FLAG_EVALUATIONS, METRIC_EVENTS
from liftwise.sources import payloads as pl
from liftwise.sources.generations import FAN_IN, Generations
from liftwise.sources.tables import EVALUATION_KEY, EVENT_KEY, event_month, expired_before, in_table_layout, write_events

FLUSH_INTERVAL = "5 seconds"

BATCH_SCHEMA = "env_id string, body string"
COUNTS = "ingest_batch bigint, rows bigint, kept bigint, repeated bigint, late bigint"

EVALUATION_ID = ["env_id", "flag_key", "user_key", "variant", "timestamp"]
EVENT_ID = ["env_id", "event_name", "user_key", "numeric_value", "timestamp"]


def read_batches(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Request bodies arriving as JSON files of (env_id, body)."""
    return spark.readStream.schema(BATCH_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def interval_micros(spark: SparkSession, interval: str) -> int:
    """Length of an interval such as '2 days' in microseconds."""
    zero = "TIMESTAMP '1970-01-01 00:00:00+00:00'"
    return spark.sql(f"SELECT unix_micros({zero} + INTERVAL {interval})").first()[0]


@dataclass(frozen=True)
class Landing:
    """One landed table: its rows, those that came too late, and per batch how many of each."""

    rows: Generations
    late: Generations
    counts: Generations
    key: str
    identity: list[str]


def landing(spark: SparkSession, path: str, schema: T.StructType, key: str, identity: list[str]) -> Landing:
    """A landed table at ``path``: columns of ``schema``, which has a timestamp, and the batch each row came in."""
    stored = T.StructType(list(schema.fields)).add("ingest_batch", T.LongType())
    return Landing(
        Generations(spark, path, stored, month=True, time="timestamp"), Generations(spark, f"{path}_late", stored, month=True),
        Generations(spark, f"{path}_counts", COUNTS), key, identity,
    )


def landed_evaluations(spark: SparkSession, path: str) -> Landing:
    return landing(spark, f"{path}/flag_evaluations", FLAG_EVALUATIONS, EVALUATION_KEY, EVALUATION_ID)


def landed_events(spark: SparkSession, path: str) -> Landing:
    return landing(spark, f"{path}/metric_events", METRIC_EVENTS, EVENT_KEY, EVENT_ID)


def rejected_bodies(spark: SparkSession, path: str) -> Generations:
    return Generations(spark, f"{path}/rejected", f"{BATCH_SCHEMA}, error string, ingest_batch bigint")


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    on = [left[c].eqNullSafe(right[c]) for c in columns]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return condition


def land(rows: DataFrame, batch: int, table: Landing, delay: str | None = None, fan_in: int = FAN_IN) -> dict[str, int]:
    """Land one batch of rows; returns how many came, were kept, were repeats, and were late.

    Without ``delay`` every row is kept. With it, a row is late if its instant
    is more than ``delay`` before the greatest of the earlier batches, or
    absent; the rest is kept unless a row of the same identity has landed,
    which by the same bound can only be among the rows since then. Only the
    identity columns of those months are read for that, and only matches of
    this batch leave the scan. The bound comes from the manifest, so a replay
    decides alike.
    """
    spark = rows.sparkSession
    if table.counts.landed() is not None and table.counts.landed() >= batch:
        return _counts(table, batch)
    rows = rows.withColumn("ingest_batch", F.lit(batch).cast("bigint")).persist()
    try:
        kept, late = rows, rows.limit(0)
        latest = table.rows.latest(before=batch)
        if delay is not None:
            # Whether a row is late is decided before repeats are, by the same bound for a row and its repeats.
            bound = None if latest is None else F.timestamp_micros(F.lit(latest - interval_micros(spark, delay)))
            in_time = F.col("timestamp").isNotNull() & (F.lit(True) if bound is None else F.col("timestamp") >= bound)
            late = rows.where(~in_time)
            kept = rows.where(in_time).dropDuplicates(table.identity)
            if bound is not None:
                known = table.rows.read(before=batch).where((F.col("event_month") >= event_month(bound)) & (F.col("timestamp") >= bound)).select(*table.identity)
                ours = kept.select(*table.identity)
                seen = known.join(ours, _same(known, ours, table.identity), "left_semi").distinct()
                kept = kept.join(seen, _same(kept, seen, table.identity), "left_anti")
            table.late.append(in_table_layout(late, table.key), batch)
        table.rows.append(in_table_layout(kept, table.key), batch)
        n, n_kept = rows.count(), table.rows.read(after=batch - 1).count()
        n_late = table.late.read(after=batch - 1).count() if delay is not None else 0
        table.counts.append(spark.createDataFrame([(batch, n, n_kept, n - n_kept - n_late, n_late)], COUNTS), batch)
    finally:
        rows.unpersist()
    for part in (table.rows, table.late):
        part.compact(lambda merged: in_table_layout(merged, table.key), fan_in)
    table.counts.compact(lambda merged: merged.coalesce(1), fan_in)
    return _counts(table, batch)


def _counts(table: Landing, batch: int) -> dict[str, int]:
    found = table.counts.read(after=batch - 1).where(F.col("ingest_batch") == batch).first()
    return {c: found[c] for c in ("rows", "kept", "repeated", "late")}


def write_batch(bodies: DataFrame, batch: int, path: str, delay: str | None = None, fan_in: int = FAN_IN) -> dict[str, int]:
    """Write one micro-batch to both tables and the quarantine; returns row counts."""
    spark = bodies.sparkSession
    decoded = pl.decode_payloads(bodies).persist()
    try:
        evals = land(pl.flag_evaluations(decoded), batch, landed_evaluations(spark, path), delay, fan_in)
        events = land(pl.metric_events(decoded), batch, landed_events(spark, path), delay, fan_in)
        quarantine = rejected_bodies(spark, path)
        quarantine.append(pl.rejected(decoded).withColumn("ingest_batch", F.lit(batch).cast("bigint")), batch)
        rejected = quarantine.read(after=batch - 1).where(F.col("ingest_batch") == batch).count()
        quarantine.compact(fan_in=fan_in)
    finally:
        decoded.unpersist()
    counts = {"evaluations": evals["kept"], "events": events["kept"], "rejected": rejected}
    if delay is not None:
        counts |= {"repeated": evals["repeated"] + events["repeated"], "late": evals["late"] + events["late"]}
    return counts


def start_ingest(batches: DataFrame, path: str, checkpoint: str, available_now: bool = False, delay: str | None = None) -> StreamingQuery:
    """Run the ingest; one flush every five seconds, or everything at hand and stop."""
    writer = batches.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch: write_batch(df, batch, path, delay) and None
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=FLUSH_INTERVAL)
    return writer.start()


def start_landing(rows: DataFrame, table: Landing, checkpoint: str, delay: str, available_now: bool = False) -> StreamingQuery:
    """Land a stream of rows without repeats, late ones apart."""
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: land(df, batch, table, delay) and None)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=FLUSH_INTERVAL)
    return writer.start()


def landed_months(table: Generations) -> list[int]:
    """Months that a landed table has, from its folders; a few numbers."""
    return sorted(r[0] for r in table.read().select("event_month").distinct().collect())


def publish_month(landed: Generations, table: str, key: str, month: int) -> None:
    """Rewrite one month of a landed table as large, sorted files of the query table.

    The month's partition of ``table`` is replaced as a whole, so publishing again,
    after late data or a failure, is safe.
    """
    rows = landed.read().where(F.col("event_month") == month).drop("event_month", "ingest_batch")
    write_events(rows, table, key, mode="overwrite", partitionOverwriteMode="dynamic")


def expire(table: Landing, as_of: str, days: int = 365) -> int:
    """Let whole months before the retention period go, from rows and late rows; returns the first month kept.

    Readers on an older version of the manifest go on undisturbed until
    ``Generations.vacuum`` removes the files. ``tables.retained`` cuts the first
    month that is kept at the exact day.
    """
    first = expired_before(as_of, days)
    for part in (table.rows, table.late):
        part.expire(first)
    return first
