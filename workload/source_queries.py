"""Source and sink queries (A1-A17)."""

from pyspark.sql import functions as F

from liftwise.operators import attribution as at
from liftwise.session import scratch_dir
from liftwise.sources import payloads as pl
from liftwise.sources import sinks, statistics, tables
from liftwise.streaming import ingest
from workload import fixtures as fx
from workload.catalog import query, r, rnd, stamp

W = "WITH " + fx.CTE

# Ten events make one batch; every 50th batch is cut short, every next one empty.
STATE = "CASE (event_id // 10) % 50 WHEN 0 THEN 'broken' WHEN 1 THEN 'empty' ELSE 'good' END"


def payload_batches(spark, d):
    """Request bodies built from the events table: JSON arrays of payloads."""
    e = fx.raw_events(spark, d)
    view = F.col("event_type") == "view"
    none = F.lit(None).cast("string")
    ms = F.unix_millis("ts")
    variation = F.struct(
        F.lit("flag-a").alias("flagKey"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string"))).alias("variant"),
        ms.alias("timestamp"), none.alias("experimentId"),
        F.when(F.col("event_id") % 5 != 0, F.lit("layer-1")).alias("layerId"),
    )
    metric = F.struct(
        F.when(F.col("event_id") % 13 != 0, F.col("event_type")).alias("eventName"), ms.alias("timestamp"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("numericValue"), F.lit("x").alias("type"),
    )
    user = F.struct(
        F.col("user_id").cast("string").alias("keyId"),
        F.when(F.col("event_id") % 3 != 0, F.from_json("props", "map<string,string>")).alias("properties"),
    )
    payload = F.struct(
        user.alias("user"),
        F.when(view, F.array(variation)).alias("variations"),
        F.when(~view, F.array(metric)).alias("metrics"),
    )
    batch = (F.col("event_id") / 10).cast("bigint")
    body = F.to_json(F.collect_list("payload"))
    grouped = e.select(batch.alias("batch_id"), payload.alias("payload")).groupBy("batch_id").agg(body.alias("body"))
    return grouped.select(
        "batch_id",
        F.lit("env-0").alias("env_id"),
        F.when(F.col("batch_id") % 50 == 0, F.substring("body", F.lit(1), F.length("body") - 5))
        .when(F.col("batch_id") % 50 == 1, F.lit("[]"))
        .otherwise(F.col("body")).alias("body"),
    )


EV = f"WITH ev AS (SELECT *, event_id // 10 AS batch_id, {STATE} AS state FROM events) "


@query("a1_decode_payloads", EV + """
SELECT batch_id, CASE state WHEN 'broken' THEN 'Invalid JSON body' WHEN 'empty' THEN 'Empty payload' END AS error,
 CASE state WHEN 'good' THEN count(*) ELSE 0 END AS payloads
FROM ev GROUP BY batch_id, state""")
def a1(spark, d):
    decoded = pl.decode_payloads(payload_batches(spark, d))
    return decoded.select(
        "batch_id", "error", F.when(F.col("error").isNull(), F.size("payloads")).otherwise(0).cast("bigint").alias("payloads")
    )


A2_BUCKET = (
    "CAST(list_reduce(list_prepend(0::UBIGINT, list_transform(string_split(CAST(user_id AS VARCHAR) || ':flag-a', ''),"
    " lambda c: ord(c)::UBIGINT)), lambda a, x: (a * 31 + x) % 4294967296) % 100 AS BIGINT)"
)


@query("a2_flag_evaluations", f"""
SELECT 'env-0' AS env_id, 'flag-a' AS flag_key, CAST(user_id AS VARCHAR) AS user_key,
 CASE WHEN event_id % 11 <> 0 THEN 'v' || CAST(user_id % 3 AS VARCHAR) ELSE '' END AS variant,
 CAST(NULL AS VARCHAR) AS experiment_id, CASE WHEN event_id % 5 <> 0 THEN 'layer-1' END AS layer_id,
 {A2_BUCKET} AS hash_bucket, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS "timestamp",
 CASE WHEN event_id % 3 <> 0 THEN '{{"k":"' || json_extract_string(props, '$.k') || '"}}' ELSE '{{}}' END AS user_properties
FROM events WHERE event_type = 'view' AND {STATE} = 'good'""")
def a2(spark, d):
    rows = pl.flag_evaluations(pl.decode_payloads(payload_batches(spark, d)))
    return rows.withColumn("hash_bucket", F.col("hash_bucket").cast("bigint")).withColumn("timestamp", stamp("timestamp"))


@query("a3_metric_events", f"""
SELECT 'env-0' AS env_id, CASE WHEN event_id % 13 <> 0 THEN event_type ELSE '' END AS event_name,
 CAST(user_id AS VARCHAR) AS user_key, CASE WHEN event_id % 7 <> 0 THEN value END AS numeric_value,
 strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS "timestamp",
 CASE WHEN event_id % 3 <> 0 THEN '{{"k":"' || json_extract_string(props, '$.k') || '"}}' ELSE '{{}}' END AS user_properties
FROM events WHERE event_type <> 'view' AND {STATE} = 'good'""")
def a3(spark, d):
    rows = pl.metric_events(pl.decode_payloads(payload_batches(spark, d)))
    return rows.withColumn("timestamp", stamp("timestamp"))


@query("a4_user_properties", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{}' WHEN event_id % 3 = 1 THEN '{}'
 ELSE '{"k":"' || json_extract_string(props, '$.k') || '"}' END AS user_properties FROM events""")
def a4(spark, d):
    props = F.from_json("props", "map<string,string>")
    empty = F.map_filter(props, lambda k, v: F.lit(False))
    by_case = F.when(F.col("event_id") % 3 == 1, empty).when(F.col("event_id") % 3 == 2, props)
    return fx.raw_events(spark, d).select("event_id", pl.properties_json(by_case).alias("user_properties"))


@query("a5_write_defaults", f"""
SELECT count(*) AS evaluations, count(*) FILTER (event_id % 11 = 0) AS blank_variant, count(*) FILTER (event_id % 5 = 0) AS null_layer
FROM events WHERE event_type = 'view' AND {STATE} = 'good'""")
def a5(spark, d):
    rows = pl.flag_evaluations(pl.decode_payloads(payload_batches(spark, d)))
    return rows.agg(
        F.count("*").alias("evaluations"), F.count_if(F.col("variant") == "").alias("blank_variant"),
        F.count_if(F.col("layer_id").isNull()).alias("null_layer"),
    )


@query("a7_event_tables", W + f"""
SELECT 'flag_evaluations' AS name, CAST(strftime(ts, '%Y%m') AS INTEGER) AS event_month, count(*) AS row_count, 0.0 AS total FROM evals GROUP BY ALL
UNION ALL SELECT 'metric_events', CAST(strftime(ts, '%Y%m') AS INTEGER), count(*), {r('sum(coalesce(numeric_value, 0))', 3)} FROM mevents GROUP BY ALL""")
def a7(spark, d):
    path = scratch_dir(spark, "tables")
    tables.write_tables(fx.evaluations(spark, d), fx.metric_events(spark, d), path)
    evals, events = tables.read_tables(spark, path)
    return (
        evals.groupBy("event_month").agg(F.count("*").alias("row_count"), F.lit(0.0).alias("total"))
        .withColumn("name", F.lit("flag_evaluations"))
        .unionByName(
            events.groupBy("event_month")
            .agg(F.count("*").alias("row_count"), rnd(F.sum(F.coalesce("numeric_value", F.lit(0.0))), 3, "total"))
            .withColumn("name", F.lit("metric_events"))
        )
    )


@query("a8_pruned_scan", W + """
SELECT user_key, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS "timestamp", numeric_value FROM mevents
WHERE env_id = 'env-1' AND event_name = '1-URGENT' AND CAST(ts AS DATE) BETWEEN DATE '1996-02-10' AND DATE '1996-05-05'""")
def a8(spark, d):
    path = scratch_dir(spark, "tables")
    tables.write_events(fx.metric_events(spark, d), f"{path}/metric_events", tables.EVENT_KEY)
    rows = tables.read_events(spark, path, "env-1", "1-URGENT", "1996-02-10", "1996-05-05")
    return rows.select("user_key", stamp("timestamp"), "numeric_value")


@query("a9_retention", W + """
SELECT env_id, event_name, count(*) AS events, strftime(min(ts), '%Y-%m-%d') AS first_day FROM mevents
WHERE CAST(ts AS DATE) + 365 > DATE '2000-06-15' GROUP BY ALL""")
def a9(spark, d):
    kept = tables.retained(fx.metric_events(spark, d), "2000-06-15")
    return kept.groupBy("env_id", "event_name").agg(
        F.count("*").alias("events"), F.date_format(F.min("timestamp"), "yyyy-MM-dd").alias("first_day")
    )


@query("a9_expired_months", W + """
SELECT CAST(strftime(ts, '%Y%m') AS INTEGER) AS event_month, count(*) AS row_count, min(CAST(ts AS DATE))::VARCHAR AS first_day, true AS gone, true AS undisturbed
FROM mevents WHERE CAST(ts AS DATE) + 365 > DATE '2000-06-15' GROUP BY 1""")
def a9_expired(spark, d):
    """Whole months expire from the table; a reader that began before sees all rows, and files go once it may be done."""
    landed = ingest.landed_events(spark, scratch_dir(spark, "expiry"))
    events = fx.metric_events(spark, d)
    ingest.land(events, 0, landed)
    before = landed.rows.read()
    first = ingest.expire(landed, "2000-06-15")
    kept_files = landed.rows.vacuum(keep_versions=2)
    undisturbed = not kept_files and before.count() == events.count()
    removed = landed.rows.vacuum(keep_versions=1)
    gone = all(int(m[-6:]) < first for m in removed if "event_month=" in m) and (bool(removed) or landed.rows.read().count() == events.count())
    rows = tables.retained(landed.rows.read(), "2000-06-15")
    return rows.groupBy("event_month").agg(F.count("*").alias("row_count"), F.date_format(F.min("timestamp"), "yyyy-MM-dd").alias("first_day")).withColumns(
        {"gone": F.lit(gone), "undisturbed": F.lit(undisturbed)}
    )


@query("a10_ingest_counts", EV + """
SELECT batch_id, CASE state WHEN 'good' THEN count(*) ELSE 0 END AS payloads,
 CASE state WHEN 'good' THEN count(*) FILTER (event_type = 'view') ELSE 0 END AS evaluations,
 CASE state WHEN 'good' THEN count(*) FILTER (event_type <> 'view') ELSE 0 END AS events,
 CASE state WHEN 'good' THEN count(*) ELSE 0 END AS accepted,
 CAST(CASE state WHEN 'good' THEN 0 ELSE 1 END AS BIGINT) AS rejected
FROM ev GROUP BY batch_id, state""")
def a10(spark, d):
    return pl.ingest_counts(pl.decode_payloads(payload_batches(spark, d)))


def warehouse_documents(spark, d):
    """One statistics document per customer, some of them broken in different ways."""
    c = fx.table(spark, d, "customer")
    key = F.col("c_custkey")
    n = 100 + key % 50
    sum_ = F.round(n * 5 + key % 7, 2)
    two = F.when(
        key % 2 == 0, F.format_string('{"n":%d,"mean":%d.5,"stddev":%d}', n, key % 90, 1 + key % 9)
    ).otherwise(F.format_string('{"n":%d,"sum":%d,"sum_squares":%d}', n, sum_.cast("bigint"), (n * 40).cast("bigint")))
    two = F.when(key % 19 == 0, F.format_string('{"n":%d}', n)).otherwise(two)
    one_n = F.when(key % 23 == 0, F.lit('"ten"')).otherwise(n.cast("string"))
    body = F.concat(
        F.lit('{"schemaVersion":'), F.when(key % 17 == 0, F.lit("2")).otherwise(F.lit("1")),
        F.lit(',"experimentId":"e"'),
        F.when(key % 29 == 0, F.lit("")).otherwise(F.lit(',"computedAt":"2026-05-02T08:00:00Z"')),
        F.lit(',"metrics":{"conversion":{"type":"'), F.when(key % 13 == 0, F.lit("ratio")).otherwise(F.lit("binary")),
        F.lit('","agg":"once","data":{"control":{"n":'), one_n, F.lit(',"k":'), (key % 40).cast("string"),
        F.lit('},"treatment":{"n":'), n.cast("string"), F.lit(',"k":'), (key % 30).cast("string"),
        F.lit('}}},"revenue":{"type":"continuous","agg":"sum","data":{"control":'), two, F.lit("}}}}"),
    )
    return c.select(key.cast("string").alias("run_id"), F.when(key % 31 == 0, F.lit("null")).otherwise(body).alias("body"))


A11_BASE = """
base AS (SELECT c_custkey AS key, CAST(c_custkey AS VARCHAR) AS run_id, 100 + c_custkey % 50 AS n FROM customer),
err AS (SELECT *, CASE WHEN key % 31 = 0 THEN 'response is not a JSON object' WHEN key % 17 = 0 THEN 'unsupported schemaVersion: 2'
  WHEN key % 29 = 0 THEN 'computedAt missing' WHEN key % 13 = 0 THEN 'metrics["conversion"].type must be binary|continuous'
  WHEN key % 23 = 0 THEN 'metrics["conversion"].data["control"].n must be a finite number, got ten'
  WHEN key % 19 = 0 THEN 'metrics["revenue"].data["control"] missing required keys' END AS error FROM base)"""


@query("a11_documents", f"""WITH {A11_BASE},
x AS (
 SELECT run_id, 'conversion' AS metric, 'control' AS variant, n, key % 40 AS k, NULL::DOUBLE AS mean, NULL::DOUBLE AS variance FROM err WHERE error IS NULL
 UNION ALL SELECT run_id, 'conversion', 'treatment', n, key % 30, NULL, NULL FROM err WHERE error IS NULL
 UNION ALL SELECT run_id, 'revenue', 'control', n, NULL, CASE WHEN key % 2 = 0 THEN key % 90 + 0.5 ELSE (n * 5 + key % 7) / n END,
  CASE WHEN key % 2 = 0 THEN (1 + key % 9) * (1 + key % 9) ELSE (n * 40 - (n * 5 + key % 7) * (n * 5 + key % 7) / n) / (n - 1) END FROM err WHERE error IS NULL)
SELECT run_id, metric, variant, n::DOUBLE AS n, k::DOUBLE AS k, {r('mean', 6)} AS mean, {r('variance', 5)} AS variance FROM x""")
def a11(spark, d):
    good, _ = statistics.split_documents(statistics.normalise_documents(warehouse_documents(spark, d)))
    return good.select("run_id", "metric", "variant", "n", "k", rnd("mean", 6), rnd("variance", 5))


@query("a11_rejected_documents", f"WITH {A11_BASE} SELECT run_id, error FROM err WHERE error IS NOT NULL")
def a11_rejected(spark, d):
    return statistics.split_documents(statistics.normalise_documents(warehouse_documents(spark, d)))[1]


@query("a12_routed_metrics", f"""
WITH s AS (SELECT s_suppkey AS key, CAST(s_suppkey AS VARCHAR) AS run_id FROM supplier),
bad AS (SELECT run_id, CASE WHEN key % 7 = 0 THEN 'no route for metric "revenue"' WHEN key % 5 = 0 THEN 'no reply from p2|/rev' END AS error FROM s)
SELECT s.run_id, m.metric, m.ord AS metric_ord, m.variant, (m.n + key % 10)::DOUBLE AS n, m.k::DOUBLE AS k, {r('m.mean', 4)} AS mean, CAST(NULL AS VARCHAR) AS error
FROM s JOIN bad USING (run_id), (VALUES ('conversion', 0, 'control', 100.0, 10.0, NULL), ('conversion', 0, 'treatment', 110.0, 12.0, NULL),
 ('revenue', 1, 'control', 100.0, NULL, 5.5), ('clicks', 2, 'control', 50.0, 3.0, NULL)) m(metric, ord, variant, n, k, mean) WHERE bad.error IS NULL
UNION ALL SELECT run_id, NULL, NULL, NULL, NULL, NULL, NULL, error FROM bad WHERE error IS NOT NULL""")
def a12(spark, d):
    s = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_suppkey").cast("string").alias("run_id"))
    metrics = F.array(*[F.struct(F.lit(m).alias("event_name"), F.lit(i).alias("metric_ord")) for i, m in enumerate(["conversion", "revenue", "clicks"])])
    specs = s.select("run_id", F.inline(metrics))
    place = {"conversion": ("p1", "/stats"), "revenue": ("p2", "/rev"), "clicks": ("p1", "/stats")}
    routes = s.select("run_id", "key", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(p).alias("provider"), F.lit(q).alias("path")) for m, (p, q) in place.items()
    ]))).where(~((F.col("key") % 7 == 0) & (F.col("metric") == "revenue"))).drop("key")
    ten = F.col("key") % 10
    head = '{"schemaVersion":1,"experimentId":"e","computedAt":"t","metrics":{'
    first = F.format_string(
        head + '"conversion":{"type":"binary","agg":"once","data":{"control":{"n":%d,"k":10},"treatment":{"n":%d,"k":12}}},'
        '"clicks":{"type":"binary","agg":"once","data":{"control":{"n":%d,"k":3}}}}}', ten + 100, ten + 110, ten + 50)
    second = F.format_string(
        head + '"revenue":{"type":"continuous","agg":"sum","data":{"control":{"n":%d,"mean":5.5,"stddev":2}}}}}', ten + 100)
    documents = s.select("run_id", F.lit("p1").alias("provider"), F.lit("/stats").alias("path"), first.alias("body")).unionByName(
        s.where(F.col("key") % 5 != 0).select("run_id", F.lit("p2").alias("provider"), F.lit("/rev").alias("path"), second.alias("body"))
    )
    stats, failures = statistics.read_routed(statistics.route_metrics(specs, routes), documents)
    return stats.select("run_id", "metric", "metric_ord", "variant", "n", "k", rnd("mean", 4)).unionByName(
        failures, allowMissingColumns=True
    ).select("run_id", "metric", "metric_ord", "variant", "n", "k", "mean", "error")


def live_stats(spark, d):
    return at.to_stats(at.variant_stats(fx.evaluations(spark, d), fx.metric_events(spark, d), fx.design(spark, d)))


@query("a13_stored_statistics", W + f"""
SELECT run_id, metric_ord, metric, inverse, variant, users::DOUBLE AS n, CASE WHEN metric_type = 'binary' THEN conversions::DOUBLE END AS k,
 CASE WHEN metric_type <> 'binary' THEN {r('sum_val', 4)} END AS "sum", CASE WHEN metric_type <> 'binary' THEN {r('sum_sq', -2)} END AS sum_squares FROM vs""")
def a13(spark, d):
    s = statistics.stored_statistics(sinks.input_data_json(live_stats(spark, d)))
    return s.select("run_id", "metric_ord", "metric", F.coalesce("inverse", F.lit(False)).alias("inverse"), "variant", "n", "k", rnd("sum", 4), rnd("sum_squares", -2))


@query("a14_manual_rows", """
SELECT CAST(c_custkey AS VARCHAR) AS run_id, 'm' AS metric, 'v' || CAST(c_custkey % 3 AS VARCHAR) AS variant, (c_custkey % 90)::DOUBLE AS n,
 CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 7.0 ELSE 0.0 END END::DOUBLE AS k,
 CASE WHEN c_custkey % 2 = 1 THEN 3.5 END::DOUBLE AS "sum", CASE WHEN c_custkey % 2 = 1 THEN 0.0 END::DOUBLE AS sum_squares,
 c_custkey % 10 = 0 AS inverse
FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 90 > 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'm', 'v' || CAST(c_custkey % 3 AS VARCHAR), (c_custkey % 90)::DOUBLE,
 CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 7.0 ELSE 0.0 END END::DOUBLE, CASE WHEN c_custkey % 2 = 1 THEN 3.5 END::DOUBLE,
 CASE WHEN c_custkey % 2 = 1 THEN 0.0 END::DOUBLE, c_custkey % 10 = 0
FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 7 <> 0 AND c_custkey % 90 > 0""")
def a14(spark, d):
    key = F.col("c_custkey")
    rows = fx.table(spark, d, "customer").select(
        key.cast("string").alias("run_id"), F.lit(0).alias("metric_ord"), F.lit("m").alias("metric"),
        F.when(key % 2 == 0, F.lit("binary")).otherwise(F.lit("continuous")).alias("metric_type"),
        F.when((key % 5 == 0) & (key % 10 != 0), F.lit("  ")).otherwise(F.concat(F.lit(" v"), (key % 3).cast("string"), F.lit(" "))).alias("variant"),
        F.when(key % 7 == 0, F.lit("many")).otherwise((key % 90).cast("string")).alias("n"),
        F.when(key % 2 == 1, F.lit("3.5")).when(key % 4 == 0, F.lit("7")).alias("s"),
        F.lit("").alias("ss"),
        F.when(key % 10 == 0, F.lit(True)).alias("inverse"),
    )
    s = statistics.manual_statistics(rows)
    return s.select("run_id", "metric", "variant", "n", "k", "sum", "sum_squares", F.coalesce("inverse", F.lit(False)).alias("inverse"))


@query("a15_source_precedence", W + """
SELECT vs.run_id, vs.metric, vs.variant,
 CASE WHEN nk % 5 = 0 THEN users + 1000 WHEN nk % 3 = 0 THEN users ELSE users + 2000 END::DOUBLE AS n,
 CASE WHEN nk % 5 = 0 THEN 'customer' WHEN nk % 3 = 0 THEN 'live' ELSE 'stored' END AS data_source
FROM vs JOIN runs USING (run_id)""")
def a15(spark, d):
    runs = fx.runs(spark, d)
    nk = F.substring("run_id", 5, 2).cast("int")
    runs = runs.withColumn("data_source_mode", F.when(nk % 5 == 0, F.lit("customer-single")).otherwise(F.lit("managed")))
    base = live_stats(spark, d)
    live = base.where(nk % 3 == 0)
    customer = base.withColumn("n", F.col("n") + 1000)
    stored = base.withColumn("n", F.col("n") + 2000)
    return statistics.choose_source(runs, live, customer, stored).select("run_id", "metric", "variant", "n", "data_source")


@query("a16_result_sink", W + """
SELECT run_id, count(*) AS stat_rows, sum(users)::DOUBLE AS users, round(sum(CASE WHEN metric_type = 'binary' THEN conversions ELSE sum_val END), 1) AS total,
 0::BIGINT AS omitted FROM vs GROUP BY 1""")
def a16(spark, d):
    path = scratch_dir(spark, "results") + "/input_data"
    stats = live_stats(spark, d)
    first = sinks.input_data_json(stats.withColumn("n", F.lit(0.0)))
    sinks.write_results(first.where(F.substring("run_id", 5, 2).cast("int") % 2 == 0), path)
    sinks.write_results(sinks.input_data_json(stats), path)
    stored = spark.read.parquet(path)
    back = statistics.stored_statistics(stored)
    totals = back.groupBy("run_id").agg(
        F.count("*").alias("stat_rows"), F.sum("n").alias("users"), F.round(F.sum(F.coalesce("k", "sum")), 1).alias("total")
    )
    return totals.join(stored.select("run_id", "omitted"), "run_id")


@query("a16_bounded_documents", W + """, o AS (
SELECT *, row_number() OVER (PARTITION BY run_id, metric_ord ORDER BY users DESC, variant) AS place, count(*) OVER (PARTITION BY run_id) AS cells FROM vs)
SELECT run_id, string_agg(metric || '/' || variant, ',' ORDER BY metric, variant) AS listed, max(cells) - count(*) AS omitted FROM o WHERE place <= 2 GROUP BY 1""")
def a16_bounded(spark, d):
    """Of every metric the two variants with most users, and how many cells are left out, which are kept as rows."""
    stats = live_stats(spark, d)
    documents = sinks.input_data_json(stats, most=2)
    cells = statistics.stored_statistics(documents).groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("metric", F.lit("/"), "variant"))), ",").alias("listed")
    )
    rest = sinks.omitted_statistics(stats, most=2).groupBy("run_id").agg(F.count("*").alias("omitted"))
    return cells.join(rest, "run_id")


@query("a17_csv_exports", W + """
SELECT 'exposure' AS name, user_key, variant AS value, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS "timestamp" FROM evals
UNION ALL SELECT 'event', user_key, event_name, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') FROM mevents""")
def a17(spark, d):
    path = scratch_dir(spark, "csv")
    sinks.exposures_csv(fx.evaluations(spark, d), f"{path}/exposures")
    sinks.events_csv(fx.metric_events(spark, d), f"{path}/events")
    schema = "user_key string, value string, timestamp string"
    read = spark.read.schema(schema).option("header", True).option("enforceSchema", True)
    return read.csv(f"{path}/exposures").withColumn("name", F.lit("exposure")).unionByName(
        read.csv(f"{path}/events").withColumn("name", F.lit("event"))
    )
