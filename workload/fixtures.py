"""Experiment views over the given tables.

Everything is derived by Spark from the tables in the data folder and grows
with them; ``CTE`` holds the same definitions for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from liftwise.functions.hashing import hash_bucket
from liftwise.operators.attribution import Design, load_design
from liftwise.operators.normalize import metric_specs, run_defaults
from liftwise.session import configure

AS_OF = "2024-02-01 00:00:00"


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its schema is read from the file once per process."""
    configure(spark)
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with its zone-less times read as UTC instants."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _event_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir).where(F.col("event_type") == "view")
    shift = F.when(F.col("event_id") % 10 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    user = F.col("user_id").cast("string")
    return e.select(
        F.lit("env-0").alias("env_id"),
        F.lit("flag-a").alias("flag_key"),
        user.alias("user_key"),
        F.concat(F.lit("v"), (shift % 3).cast("string")).alias("variant"),
        F.lit(None).cast("string").alias("experiment_id"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("layer-"), (F.col("event_id") % 2).cast("string")))
        .alias("layer_id"),
        hash_bucket(user, F.lit("flag-a")).alias("hash_bucket"),
        F.col("ts").alias("timestamp"),
        F.col("props").alias("user_properties"),
    )


def _order_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 5 == 0)
    user = F.col("o_custkey").cast("string")
    return o.select(
        F.lit("env-1").alias("env_id"),
        F.lit("flag-b").alias("flag_key"),
        user.alias("user_key"),
        F.concat(F.lit("arm-"), (F.col("o_custkey") % 4).cast("string")).alias("variant"),
        F.lit(None).cast("string").alias("experiment_id"),
        F.lit(None).cast("string").alias("layer_id"),
        hash_bucket(user, F.lit("flag-b")).alias("hash_bucket"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.lit("{}").alias("user_properties"),
    )


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_evaluations(spark, sf_dir).unionByName(_order_evaluations(spark, sf_dir))


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir).where(F.col("event_type") != "view")
    first = e.select(
        F.lit("env-0").alias("env_id"),
        F.col("event_type").alias("event_name"),
        F.col("user_id").cast("string").alias("user_key"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("numeric_value"),
        F.col("ts").alias("timestamp"),
        F.col("props").alias("user_properties"),
    )
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 5 != 0)
    second = o.select(
        F.lit("env-1").alias("env_id"),
        F.col("o_orderpriority").alias("event_name"),
        F.col("o_custkey").cast("string").alias("user_key"),
        F.col("o_totalprice").alias("numeric_value"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.lit("{}").alias("user_properties"),
    )
    return first.unionByName(second)


GUARDRAILS_A = (
    '["click",{"event":"error","metricType":"continuous","metricAgg":"count","direction":"increase_bad"}]'
)
GUARDRAILS_B = (
    '[{"event":"5-LOW","metricType":"numeric","metricAgg":"average","inverse":true},'
    '{"event":"2-HIGH","metricType":"binary","metricAgg":"sum"}]'
)


def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment runs, one per nation; even ones on flag-a, odd ones on flag-b."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    on_a = key % 2 == 0
    start = F.when(on_a, F.date_add(F.lit("2024-01-01").cast("date"), key)).otherwise(
        F.date_add(F.lit("1996-01-01").cast("date"), key * 30)
    )
    return n.select(
        F.concat(F.lit("run-"), F.lpad(key.cast("string"), 2, "0")).alias("run_id"),
        F.concat(F.lit("exp-"), F.col("n_regionkey").cast("string")).alias("experiment_id"),
        F.lower("n_name").alias("slug"),
        F.when(on_a, F.lit("env-0")).otherwise(F.lit("env-1")).alias("env_id"),
        F.when(on_a, F.lit("flag-a")).otherwise(F.lit("flag-b")).alias("flag_key"),
        F.when(key % 3 == 1, F.lit("bandit")).when(key % 3 == 2, F.lit("bayesian_ab")).alias("method"),
        F.when(on_a, F.lit("v0")).otherwise(F.lit("arm-0")).alias("control_variant"),
        F.when(on_a, F.lit("v1, v2,")).otherwise(F.lit("arm-1,arm-2 ,arm-3")).alias("treatment_variant"),
        F.when(on_a, F.lit("purchase")).otherwise(F.lit("1-URGENT")).alias("primary_metric_event"),
        F.when(on_a, F.lit("numeric")).otherwise(F.lit("binary")).alias("primary_metric_type"),
        F.when(on_a, F.lit("sum")).otherwise(F.lit("once")).alias("primary_metric_agg"),
        F.when(on_a, F.lit(GUARDRAILS_A)).otherwise(F.lit(GUARDRAILS_B)).alias("guardrail_events"),
        start.cast("timestamp").alias("observation_start"),
        F.date_add(start, F.when(on_a, F.lit(3)).otherwise(F.lit(730))).cast("timestamp").alias("observation_end"),
        (key % 5 == 0).alias("prior_proper"),
        (key * 2).cast("int").alias("minimum_sample"),
        ((key % 4) * 25).cast("int").alias("traffic_offset"),
        F.when(key % 3 == 0, F.lit(100.0)).otherwise((key % 5) * 10.0 + 30).alias("traffic_percent"),
        F.when(key % 4 == 0, F.lit("layer-1")).alias("layer_id"),
        F.when(
            key % 3 == 2, F.lit('[{"property":"k","op":"nin","values":["1","2","3"]},{"property":" ","op":"eq"}]')
        ).when(key % 3 == 1, F.lit('[{"property":"k","op":"neq","value":"7"}]')).alias("audience_filters"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_defaults(raw_runs(spark, sf_dir), AS_OF)


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_specs(runs(spark, sf_dir))


def design(spark: SparkSession, sf_dir: str) -> Design:
    prepared = runs(spark, sf_dir)
    return load_design(prepared, metric_specs(prepared))


# The same views for the comparison engine, without a leading WITH.
CTE = """
evals AS (
  SELECT 'env-0' AS env_id, 'flag-a' AS flag_key, CAST(user_id AS VARCHAR) AS user_key,
         'v' || CAST((CASE WHEN event_id % 10 = 0 THEN user_id + 1 ELSE user_id END) % 3 AS VARCHAR) AS variant,
         CASE WHEN event_id % 5 <> 0 THEN 'layer-' || CAST(event_id % 2 AS VARCHAR) END AS layer_id,
         ts, props AS user_properties
  FROM events WHERE event_type = 'view'
  UNION ALL
  SELECT 'env-1', 'flag-b', CAST(o_custkey AS VARCHAR), 'arm-' || CAST(o_custkey % 4 AS VARCHAR),
         NULL, o_orderdate, '{}'
  FROM orders WHERE o_orderkey % 5 = 0
),
mevents AS (
  SELECT 'env-0' AS env_id, event_type AS event_name, CAST(user_id AS VARCHAR) AS user_key,
         CASE WHEN event_id % 7 <> 0 THEN value END AS numeric_value, ts, props AS user_properties
  FROM events WHERE event_type <> 'view'
  UNION ALL
  SELECT 'env-1', o_orderpriority, CAST(o_custkey AS VARCHAR), o_totalprice, o_orderdate, '{}'
  FROM orders WHERE o_orderkey % 5 <> 0
),
runs AS (
  SELECT 'run-' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS run_id, n_nationkey AS nk,
         'exp-' || CAST(n_regionkey AS VARCHAR) AS experiment_id, lower(n_name) AS slug,
         CASE WHEN n_nationkey % 2 = 0 THEN 'env-0' ELSE 'env-1' END AS env_id,
         CASE WHEN n_nationkey % 2 = 0 THEN 'flag-a' ELSE 'flag-b' END AS flag_key,
         CASE WHEN n_nationkey % 3 = 1 THEN 'bandit' ELSE 'bayesian_ab' END AS method,
         CASE WHEN n_nationkey % 2 = 0 THEN DATE '2024-01-01' + n_nationkey
              ELSE DATE '1996-01-01' + n_nationkey * 30 END AS start_date,
         CASE WHEN n_nationkey % 2 = 0 THEN DATE '2024-01-01' + n_nationkey + 3
              ELSE DATE '1996-01-01' + n_nationkey * 30 + 730 END AS end_date,
         n_nationkey % 5 = 0 AS prior_proper, n_nationkey * 2 AS minimum_sample,
         (n_nationkey % 4) * 25 AS traffic_offset,
         CASE WHEN n_nationkey % 3 = 0 THEN 100.0 ELSE (n_nationkey % 5) * 10.0 + 30 END AS traffic_percent,
         CASE WHEN n_nationkey % 4 = 0 THEN 'layer-1' END AS run_layer
  FROM nation
),
arms AS (
  SELECT run_id, nk, idx, arm FROM runs, (VALUES
    ('env-0', 0, 'v0'), ('env-0', 1, 'v1'), ('env-0', 2, 'v2'),
    ('env-1', 0, 'arm-0'), ('env-1', 1, 'arm-1'), ('env-1', 2, 'arm-2'), ('env-1', 3, 'arm-3')
  ) a(env_id, idx, arm) WHERE a.env_id = runs.env_id
),
specs AS (
  SELECT run_id, nk, s.* FROM runs, (VALUES
    ('env-0', 0, 'purchase', 'primary', 'continuous', 'sum', false),
    ('env-0', 1, 'click', 'guardrail', 'binary', 'once', false),
    ('env-0', 2, 'error', 'guardrail', 'continuous', 'count', true),
    ('env-1', 0, '1-URGENT', 'primary', 'binary', 'once', false),
    ('env-1', 1, '5-LOW', 'guardrail', 'continuous', 'average', true),
    ('env-1', 2, '2-HIGH', 'guardrail', 'binary', 'once', false)
  ) s(env_id, metric_ord, event_name, role, metric_type, metric_agg, inverse) WHERE s.env_id = runs.env_id
),
fe AS (
  SELECT run_id, env_id, user_key, f.variant AS variant, f.ts AS exposure_ts, f.props AS user_properties
  FROM (
    SELECT r.run_id, e.env_id, e.user_key,
           min({'ts': e.ts, 'variant': e.variant, 'props': e.user_properties}) AS f
    FROM evals e JOIN runs r ON e.env_id = r.env_id AND e.flag_key = r.flag_key
     AND CAST(e.ts AS DATE) BETWEEN r.start_date AND r.end_date
    GROUP BY ALL)
),
ut AS (
  SELECT s.run_id, s.metric_ord, m.user_key, count(*) AS conv_count,
         sum(coalesce(m.numeric_value, 0)) AS user_sum, avg(coalesce(m.numeric_value, 0)) AS user_avg
  FROM fe JOIN runs r ON r.run_id = fe.run_id
  JOIN specs s ON s.run_id = fe.run_id
  JOIN mevents m ON m.env_id = fe.env_id AND m.user_key = fe.user_key AND m.event_name = s.event_name
   AND CAST(m.ts AS DATE) BETWEEN r.start_date AND r.end_date AND m.ts >= fe.exposure_ts
  GROUP BY ALL
),
uc AS (
  SELECT fe.run_id, fe.user_key, fe.variant, fe.user_properties, s.metric_ord, s.event_name, s.metric_agg,
         coalesce(ut.conv_count, 0) AS conv_count,
         CASE s.metric_agg WHEN 'once' THEN (CASE WHEN coalesce(ut.conv_count, 0) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE
           WHEN 'count' THEN coalesce(ut.conv_count, 0)::DOUBLE
           WHEN 'sum' THEN coalesce(ut.user_sum, 0) ELSE coalesce(ut.user_avg, 0) END AS x
  FROM fe JOIN specs s ON s.run_id = fe.run_id
  LEFT JOIN ut ON ut.run_id = fe.run_id AND ut.metric_ord = s.metric_ord AND ut.user_key = fe.user_key
),
vs AS (
  SELECT u.run_id, u.metric_ord, s.event_name AS metric, s.role, s.metric_type, s.metric_agg, s.inverse, u.variant,
         count(*) AS users, count(*) FILTER (WHERE u.conv_count > 0) AS conversions,
         sum(u.x) AS sum_val, sum(u.x * u.x) AS sum_sq
  FROM uc u JOIN specs s ON s.run_id = u.run_id AND s.metric_ord = u.metric_ord
  GROUP BY ALL
)
"""
