"""Streaming queries (J): each must end in the batch result over the same rows.

Rows arrive in four spans of time, one micro-batch each, and the query is
started anew for every one, from its checkpoint.
"""

from pyspark.sql import functions as F

from liftwise.operators.attribution import load_design
from liftwise.operators.normalize import metric_specs
from liftwise.session import materialize, scratch_dir
from liftwise.sources import tables
from liftwise.sources.generations import Generations
from liftwise.streaming import incremental, ingest, reweight, state
from workload import fixtures as fx
from workload.analysis_queries import BANDIT
from workload.catalog import query, r, rnd, stamp
from workload.source_queries import EV, payload_batches

W = "WITH " + fx.CTE

STEPS = 4
#: The span a row belongs to, in both engines.
SPAN = "CASE WHEN {ts} < TIMESTAMP '1998-01-01' THEN 0 WHEN {ts} < TIMESTAMP '2010-01-01' THEN 1 WHEN {ts} < TIMESTAMP '2024-01-16' THEN 2 ELSE 3 END"


def _finish(q):
    q.awaitTermination()
    return q


def _span(ts="timestamp"):
    return F.expr(SPAN.format(ts=ts))


def _stepwise(df, prefix, start, arrival=None):
    """Land ``df`` span by span as files and run the stream that ``start`` makes of them after each; returns the last run."""
    spark = df.sparkSession
    path, q = scratch_dir(spark, prefix), None
    rows = materialize(df.withColumn("_arrival", _span() if arrival is None else arrival), prefix)
    for step in range(STEPS):
        rows.where(F.col("_arrival") == step).drop("_arrival").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{path}/in")
        q = _finish(start(stream, path))
    return path, q


def _bigint_where_it_fits(df, column):
    """``column``, exact sums, as the SQL's BIGINT if that holds them all; else as they are, since no BIGINT would be right."""
    total = F.col(column)
    beyond = df.where(total.isNotNull() & total.try_cast("bigint").isNull())
    return df.withColumn(column, total.cast("bigint")) if beyond.isEmpty() else df


@query("j1_stream_ingest", EV + """
SELECT 'flag_evaluations' AS name, count(*) AS row_count, count(DISTINCT user_id) AS users, sum(epoch_ms(ts))::BIGINT AS instants, true AS bounded
FROM ev WHERE state = 'good' AND event_type = 'view'
UNION ALL SELECT 'metric_events', count(*), count(DISTINCT user_id), sum(epoch_ms(ts))::BIGINT, true FROM ev WHERE state = 'good' AND event_type <> 'view'
UNION ALL SELECT 'rejected', count(DISTINCT batch_id), 0, 0, true FROM ev WHERE state <> 'good'""")
def j1(spark, d):
    """Many small batches end in few parts, and every body in one table."""
    path = scratch_dir(spark, "ingest")
    payload_batches(spark, d).select("env_id", "body").repartition(5).write.json(f"{path}/in")
    for _ in range(2):  # the second run finds nothing new
        _finish(ingest.start_ingest(ingest.read_batches(spark, f"{path}/in", 1), f"{path}/out", f"{path}/check", available_now=True))
    landed = {"flag_evaluations": ingest.landed_evaluations(spark, f"{path}/out").rows, "metric_events": ingest.landed_events(spark, f"{path}/out").rows}
    bodies = ingest.rejected_bodies(spark, f"{path}/out")
    zero = F.lit(0).cast("bigint")
    instants = F.unix_millis("timestamp").cast("decimal(20,0)")  # a few million instants of today sum up to more than a bigint holds

    def bounded(table):
        table.compact(fan_in=3)
        return F.lit(len(table.manifest()[1]) <= 4)

    counts = [
        t.read().agg(F.count("*").alias("row_count"), F.count_distinct("user_key").alias("users"), F.sum(instants).alias("instants"))
        .select(F.lit(name).alias("name"), "row_count", "users", "instants", bounded(t).alias("bounded"))
        for name, t in landed.items()
    ]
    rejected = bodies.read().agg(F.count("*").alias("row_count")).select(
        F.lit("rejected").alias("name"), "row_count", zero.alias("users"), zero.alias("instants"), bounded(bodies).alias("bounded")
    )
    return _bigint_where_it_fits(materialize(counts[0].unionByName(counts[1]).unionByName(rejected), "totals"), "instants")


@query("j2_replayed_batch", EV + "SELECT count(*) AS row_count FROM ev WHERE state = 'good' AND event_type = 'view'")
def j2(spark, d):
    path = scratch_dir(spark, "replay")
    bodies = payload_batches(spark, d).select("env_id", "body")
    for _ in range(2):  # the second write finds the batch landed
        ingest.write_batch(bodies, 7, path)
    return ingest.landed_evaluations(spark, path).rows.read().agg(F.count("*").alias("row_count"))


@query("j2_published_months", EV + """
SELECT CAST(strftime(ts, '%Y%m') AS INTEGER) AS event_month, count(*) AS row_count FROM ev WHERE state = 'good' AND event_type <> 'view' GROUP BY 1""")
def j2_published(spark, d):
    path = scratch_dir(spark, "publish")
    ingest.write_batch(payload_batches(spark, d).select("env_id", "body"), 1, path)
    landed = ingest.landed_events(spark, path).rows
    for _ in range(2):
        for month in ingest.landed_months(landed):
            ingest.publish_month(landed, f"{path}/table", tables.EVENT_KEY, month)
    return spark.read.parquet(f"{path}/table").groupBy("event_month").agg(F.count("*").alias("row_count"))


# Every event is delivered twice; the first copies of some users and the second ones of others come a span later.
DELIVERIES = f"""
, d AS (SELECT *, least(span + CASE WHEN copy = 0 AND user_key LIKE '%7' OR copy = 1 AND user_key LIKE '%3' THEN 1 ELSE 0 END, {STEPS - 1}) AS arrival
  FROM (SELECT env_id, event_name, user_key, numeric_value, ts, {SPAN.format(ts='ts')} AS span FROM mevents) e, (VALUES (0), (1)) c(copy)),
b AS (SELECT arrival, max(ts) AS latest FROM d GROUP BY 1),
j AS (SELECT d.*, coalesce(d.ts < (SELECT max(latest) FROM b WHERE b.arrival < d.arrival) - INTERVAL 10 DAY, false) AS late FROM d),
k AS (SELECT env_id, event_name, user_key, numeric_value, ts, min(arrival) AS arrival FROM j WHERE NOT late GROUP BY ALL)"""


@query("j3_stream_dedup", W + DELIVERIES + """
SELECT j.arrival::BIGINT AS ingest_batch, count(*) AS rows, (SELECT count(*) FROM k WHERE k.arrival = j.arrival) AS kept,
 count(*) FILTER (late) AS late, count(*) FILTER (NOT late) - (SELECT count(*) FROM k WHERE k.arrival = j.arrival) AS repeated,
 (SELECT count(DISTINCT user_key) FROM k) AS users, (SELECT count(*) FROM j WHERE late) AS quarantined
FROM j GROUP BY j.arrival""")
def j3(spark, d):
    """Every delivery is kept, a repeat, or late, and counted as such per batch."""
    e = fx.metric_events(spark, d)
    copies = e.withColumn("_copy", F.lit(0)).unionByName(e.withColumn("_copy", F.lit(1)))
    behind = F.when(((F.col("_copy") == 0) & F.col("user_key").endswith("7")) | ((F.col("_copy") == 1) & F.col("user_key").endswith("3")), 1).otherwise(0)
    landed = ingest.landed_events(spark, scratch_dir(spark, "dedup"))
    rows = copies.withColumn("_at", F.least(_span() + behind, F.lit(STEPS - 1)))
    _stepwise(rows, "dedup", lambda stream, path: ingest.start_landing(stream.drop("_copy", "_at"), landed, f"{path}/check", "10 days", available_now=True), F.col("_at"))
    users, late = (t.read().agg(c).first()[0] for t, c in ((landed.rows, F.count_distinct("user_key")), (landed.late, F.count("*"))))
    return landed.counts.read().select("ingest_batch", "rows", "kept", "late", "repeated", F.lit(users).cast("bigint").alias("users"), F.lit(late).cast("bigint").alias("quarantined"))


# Some evaluations of the last two days of a span come with the next one, within the bound.
LATENESS = "4 days"
LAG = "CASE WHEN user_key LIKE '%7' AND {ts} >= TIMESTAMP '2024-01-14' AND {ts} < TIMESTAMP '2024-01-16' THEN 1 ELSE 0 END"


def _running_exposures(spark, d, fan_in=3):
    table = state.first_exposure_table(spark, scratch_dir(spark, "exposures"))

    def start(stream, path):
        return state.run_versions(state.running_first_exposures(stream, LATENESS), table, state.merge_first_exposures, f"{path}/check", fan_in=fan_in)

    return table, _stepwise(fx.evaluations(spark, d), "exposures", start, _span() + F.expr(LAG.format(ts="timestamp")))[1]


@query("j4_running_first_exposure", W + """
SELECT env_id, flag_key, user_key, f.variant AS variant, strftime(f.ts, '%Y-%m-%d %H:%M:%S.%g') AS exposure_ts
FROM (SELECT env_id, flag_key, user_key, min({'ts': ts, 'variant': variant}) AS f FROM evals GROUP BY ALL)""")
def j4(spark, d):
    fe = state.read_first_exposures(_running_exposures(spark, d)[0])
    return fe.select("env_id", "flag_key", "user_key", "variant", stamp("exposure_ts"))


@query("j4_state_rows", W + """
SELECT count(*) AS state_rows, (SELECT count(*) FROM (SELECT DISTINCT env_id, flag_key, user_key FROM evals)) AS exposed_users FROM (
 SELECT DISTINCT env_id, flag_key, user_key, CAST(ts AS DATE) AS day FROM evals
 WHERE CAST(ts AS DATE) + INTERVAL 1 DAY > (SELECT max(ts) FROM evals) - INTERVAL 4 DAY)""")
def j4_state(spark, d):
    """What the stream still holds at its end: the users of the days that late evaluations may still reach."""
    table, q = _running_exposures(spark, d)
    held = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    return state.read_first_exposures(table).agg(F.lit(held).cast("bigint").alias("state_rows"), F.count("*").alias("exposed_users"))


@query("j5_running_event_rollup", W + f"""
SELECT env_id, event_name, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS events, {r('coalesce(sum(numeric_value), 0)', 3)} AS value_sum FROM mevents GROUP BY ALL""")
def j5(spark, d):
    table = state.daily_event_table(spark, scratch_dir(spark, "rollup"))

    def start(stream, path):
        return state.run_versions(state.daily_events(stream, LATENESS), table, state.merge_daily_events, f"{path}/check", fan_in=3)

    _stepwise(fx.metric_events(spark, d), "rollup", start, _span() + F.expr(LAG.format(ts="timestamp")))
    e = state.read_daily_events(table)
    return e.select("env_id", "event_name", F.col("date").cast("string").alias("date"), "events", rnd("value_sum", 3))


@query("j5_running_exposed_users", W + """
SELECT env_id, flag_key, variant, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(DISTINCT user_key) AS users FROM evals GROUP BY ALL""")
def j5_users(spark, d):
    def start(stream, path):
        return state.run_rows(state.daily_exposed_users(stream, LATENESS), f"{path}/out", f"{path}/check")

    path, _ = _stepwise(fx.evaluations(spark, d), "userdays", start, _span() + F.expr(LAG.format(ts="timestamp")))
    days = spark.read.parquet(f"{path}/out")
    return days.groupBy("env_id", "flag_key", "variant", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("users"))


def _followed(spark, d, runs):
    """Statistics that followed both tables through all spans; evaluations lag behind events for some users."""
    running = incremental.RunningStatistics(spark, scratch_dir(spark, "running"), LATENESS, fan_in=3)
    path = scratch_dir(spark, "landed")
    evals, events = ingest.landed_evaluations(spark, path), ingest.landed_events(spark, path)
    sources = [
        (t, materialize(df.withColumn("_arrival", _span() + lag), "landing"))
        for t, df, lag in ((evals, fx.evaluations(spark, d), F.expr(LAG.format(ts="timestamp"))), (events, fx.metric_events(spark, d), F.lit(0)))
    ]
    weights = None
    for step in range(STEPS):
        for table, rows in sources:
            ingest.land(rows.where(F.col("_arrival") == step).drop("_arrival"), step, table, LATENESS)
        weights = reweight.reweight_step(evals, events, running, runs, F.substring("run_id", 5, 2).cast("bigint") * 101 + 7)
    return running, weights


@query("j6_reweighting", W + "," + BANDIT + f"""
SELECT run_id, arm, enough AS enough_units, {r('p_best', 4)} AS p_best, {r('weight', 6)} AS weight,
 {r('sum(weight) OVER (PARTITION BY run_id ORDER BY arm_idx ROWS UNBOUNDED PRECEDING)', 5)} AS range_end FROM bw""")
def j6(spark, d):
    """Weights of the last step, which read the last span only, equal those of all rows."""
    runs = fx.runs(spark, d).withColumn("method", F.lit("bandit"))
    w = _followed(spark, d, runs)[1]
    return w.select("run_id", "arm", "enough_units", rnd("p_best", 4), rnd("weight", 6), rnd("range_end", 5))


@query("j6_running_statistics", W + f"""
SELECT run_id, metric, variant, users, conversions, {r('sum_val', 4)} AS sum_val, {r('sum_sq', -2)} AS sum_sq FROM vs""")
def j6_statistics(spark, d):
    """Sums kept by taking off old contributions and adding new ones equal sums over all rows."""
    runs = fx.runs(spark, d).withColumn("method", F.lit("bandit"))
    running, _ = _followed(spark, d, runs)
    v = running.statistics(load_design(runs, metric_specs(runs)))
    return v.select("run_id", "metric", "variant", "users", "conversions", rnd("sum_val", 4), rnd("sum_sq", -2))
