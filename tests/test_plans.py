"""What the physical plans must look like for the jobs to hold at scale."""

import json

import pytest

from liftwise.operators import attribution as at
from liftwise.operators import runs as run_lists
from liftwise.session import scratch_dir
from liftwise.sources import tables
from liftwise.streaming import ingest
from workload import fixtures as fx

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def event_tables(spark):
    path = scratch_dir(spark, "plans")
    tables.write_tables(fx.evaluations(spark, DATA), fx.metric_events(spark, DATA), path)
    return tables.read_tables(spark, path)


def test_statistics_read_few_columns_and_months(spark, event_tables):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    df = at.variant_stats(*event_tables, fx.design(spark, DATA))
    plan = plan_of(df)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "user_properties" not in plan and "hash_bucket" not in plan
    assert "GreaterThanOrEqual(timestamp" in plan and "BroadcastHashJoin" in plan
    assert "event_month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan


def test_exposures_are_shuffled_once(spark, event_tables):
    df = at.variant_stats(*event_tables, fx.design(spark, DATA))
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final


def test_latest_activities_are_limited_before_the_shuffle(spark):
    activities = fx.raw_events(spark, DATA).selectExpr("user_id as experiment_id", "event_id as activity_id", "ts as created_at")
    plan = plan_of(run_lists.latest_activities(activities)).split("== Initial Plan ==")[-1]
    assert "row_number(), 20, Partial" in plan


def test_batch_counts(spark, tmp_path):
    body = json.dumps([{"user": {"keyId": "u"}, "variations": [{"flagKey": "f", "variant": "v", "timestamp": 1}],
                        "metrics": [{"eventName": "e", "timestamp": 2}, {"eventName": "e", "timestamp": 3}]}])
    bodies = spark.createDataFrame([("env", body), ("env", "oops")], ingest.BATCH_SCHEMA)
    assert ingest.write_batch(bodies, 3, str(tmp_path)) == {"evaluations": 1, "events": 2, "rejected": 1}
    assert ingest.write_batch(bodies, 3, str(tmp_path)) == {"evaluations": 1, "events": 2, "rejected": 1}
    assert ingest.landed_events(spark, str(tmp_path)).rows.read().count() == 2
