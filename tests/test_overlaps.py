"""Interval join of windows, and lists that stay short."""

import datetime as dt
import random

from pyspark.sql import functions as F

from liftwise.operators import design, variants
from liftwise.sources import sinks
from tests.helpers import runs


def test_dyadic_join_equals_brute_force(spark):
    rng, zero = random.Random(6), dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
    rows = []
    for i in range(10_000):
        start = zero + dt.timedelta(hours=rng.randrange(24 * 2000))
        end = None if i % 97 == 0 else start + dt.timedelta(hours=rng.randrange(-20, 24 * 20))
        rows.append((f"r{i:05d}", f"x{i % 4000}", "f" if i % 10 else "g", rng.choice(("draft", "collecting", "decided")), start, end))
    table = spark.createDataFrame(rows, "run_id string, experiment_id string, flag_key string, status string, observation_start timestamp, observation_end timestamp")
    focus = spark.createDataFrame([(f"x{i}",) for i in range(0, 4000, 40)], "experiment_id string")
    far = dt.datetime(2099, 12, 31, tzinfo=dt.timezone.utc)
    last = [r[5] or far for r in rows]
    mine = [i for i, r in enumerate(rows) if int(r[1][1:]) % 40 == 0 and r[3] != "decided"]
    want = sorted((rows[i][0], r[0]) for i in mine for j, r in enumerate(rows) if r[3] != "decided" and r[2] == rows[i][2] and r[1] != rows[i][1] and rows[i][4] <= last[j] and r[4] <= last[i])
    got = design.overlaps_of(table, focus)
    assert sorted((r.focus_run, r.run_id) for r in got.select("focus_run", "run_id").collect()) == want and len(want) > 2000


def test_pairs_made_follow_pairs_returned(spark):
    """Ten thousand windows of one flag that hardly overlap make few pairs."""
    rows = spark.range(10_000).select(F.lit("f").alias("flag_key"), F.col("id").alias("w"), F.timestamp_seconds(F.lit(1_500_000_000) + F.col("id") * 86_400).alias("_from"))
    rows = rows.withColumn("_to", F.col("_from") + F.expr("INTERVAL 2 DAYS"))
    made = design._starts_within(rows.select("flag_key", F.col("_from").alias("_at")), rows.select("flag_key", "w", "_from", "_to"), "flag_key")
    assert made.count() <= 3 * 10_000


def test_rows_under_spans_are_not_broadcast(spark):
    """A table small enough for a broadcast is not, once every row is there under each of its spans."""
    rows = spark.range(1_000).select(F.col("id").alias("run_id"), F.col("id").alias("experiment_id"), F.concat(F.lit("f"), F.col("id") % 2).alias("flag_key"), F.lit("draft").alias("status"),
                                     F.timestamp_seconds(F.col("id") * 86_400).alias("observation_start"), F.timestamp_seconds(F.col("id") * 86_400 + 7).alias("observation_end"))
    found = design.overlaps_of(rows, rows.where("run_id < 3").select("experiment_id"))
    plan = found._jdf.queryExecution().sparkPlan().toString().splitlines()
    joins = [line for line in plan if "Join" in line and "span#" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins)
    assert sum("LeftSemi" in line and "flag_key#" in line for line in plan) == 2
    assert found.count() == 0


def test_many_strays_give_a_bounded_row(spark):
    configured = runs(spark, [{"run_id": "r", "control_variant": "a", "treatment_variant": "b"}])
    strays = spark.range(200_000).select(F.lit("r").alias("run_id"), F.lit(0).alias("metric_ord"), F.lit("m").alias("metric"), F.lit("primary").alias("role"), F.lit(False).alias("inverse"),
                                         F.concat(F.lit("user-"), F.col("id")).alias("variant"), F.col("id").cast("double").alias("n"))
    stats = strays.withColumns({c: F.lit(None).cast("double") for c in ("k", "sum", "sum_squares", "mean", "variance")})
    found = variants.variant_mismatches(stats, configured).first()
    assert len(found.available) == variants.LISTED and found.n_available == 200_000 and "user-199999" in found.available
    assert found.warning.endswith("and 199900 more]. Set the run's variants to those of its data.")
    assert variants.stray_variants(stats, configured).count() == 200_000
    one = stats.limit(1).withColumns({"variant": F.lit("a"), "n": F.lit(-1.0)})
    document = sinks.input_data_json(stats.unionByName(one), configured, most=5).first()
    assert document.omitted == 199_996 and '"a":{' in document.input_data and len(document.input_data) < 1000
    assert sinks.omitted_statistics(stats.unionByName(one), configured, most=5).count() == 199_996
