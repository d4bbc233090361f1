"""Totals of landed rows that a BIGINT can't hold are exact all the same."""

from decimal import Decimal

from pyspark.sql import functions as F

from workload import QUERIES
from workload.streaming_queries import _bigint_where_it_fits

VIEWS, CLICKS = 45_000, 5_000
FIRST = 253_300_000_000_000  # epoch milliseconds, in the year 9996


def _good(ids):
    """Events in batches that are neither cut short nor empty."""
    return [i for i in ids if i // 10 % 50 > 1]


def test_sum_of_instants_beyond_bigint(spark, tmp_path):
    e = spark.range(VIEWS + CLICKS).select(
        F.col("id").alias("event_id"), F.timestamp_millis(F.col("id") + FIRST).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 100).alias("user_id"), F.when(F.col("id") < VIEWS, "view").otherwise("click").alias("event_type"),
        F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    e.write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES["j1_stream_ingest"](spark, str(tmp_path))
    views, clicks = _good(range(VIEWS)), _good(range(VIEWS, VIEWS + CLICKS))
    total = sum(views) + FIRST * len(views)
    assert total > 2**63
    found = {r.name: (r.row_count, r.users, r.instants, r.bounded) for r in df.collect()}
    assert found["flag_evaluations"] == (len(views), 100, total, True)
    assert found["metric_events"] == (len(clicks), 100, sum(clicks) + FIRST * len(clicks), True)
    assert found["rejected"] == ((VIEWS + CLICKS) // 500 * 2, 0, 0, True)


def test_bigint_where_it_fits(spark):
    most = 2**63 - 1
    for totals, kind in (([most, None, -most - 1], "bigint"), ([most + 1, None, 1], "decimal(30,0)"), ([None], "bigint"), ([], "bigint")):
        df = _bigint_where_it_fits(spark.createDataFrame([(None if t is None else Decimal(t),) for t in totals], "t decimal(30,0)"), "t")
        assert dict(df.dtypes) == {"t": kind} and [r.t for r in df.collect()] == totals
