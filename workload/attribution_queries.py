"""Filters, attribution and statistics queries (B1-B7, C1-C4, D1-D7, D12-D14)."""

from pyspark.sql import functions as F

from liftwise.functions.hashing import hash_bucket
from liftwise.functions.moments import moments
from liftwise.operators import attribution as at
from liftwise.operators import filters as fl
from workload import fixtures as fx
from workload.catalog import query, r, rnd, stamp

W = "WITH " + fx.CTE

BUCKET = (
    "CAST(list_reduce(list_prepend(0::UBIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::UBIGINT)),"
    " lambda a, x: (a * 31 + x) % 4294967296) % 100 AS BIGINT)"
)
KEYED = BUCKET.format("e.user_key || ':' || e.flag_key")


@query("b1_observation_window", """
SELECT event_type AS event_name, count(*) AS events, count(DISTINCT user_id) AS users
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-19' GROUP BY 1""")
def b1(spark, d):
    e = fx.raw_events(spark, d)
    inside = fl.in_window(F.col("ts"), F.lit("2024-01-05"), F.lit("2024-01-19"))
    return e.where(inside).groupBy(F.col("event_type").alias("event_name")).agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users")
    )


@query("b2_environment", W + """
SELECT env_id, event_name, count(*) AS events FROM mevents WHERE env_id = 'env-1' GROUP BY ALL""")
def b2(spark, d):
    scoped = fl.scan_environment(fx.metric_events(spark, d), "env-1", requested_env="env-1")
    return scoped.groupBy("env_id", "event_name").agg(F.count("*").alias("events"))


@query("b3_flag_and_event", W + """
SELECT 'flag-a' AS name, variant AS part, count(*) AS hits FROM evals WHERE flag_key = 'flag-a' GROUP BY ALL
UNION ALL SELECT 'purchase', env_id, count(*) FROM mevents WHERE event_name = 'purchase' GROUP BY ALL""")
def b3(spark, d):
    flag = fl.scan_flag(fx.evaluations(spark, d), "flag-a").groupBy(F.col("variant").alias("part"))
    event = fl.scan_event(fx.metric_events(spark, d), "purchase").groupBy(F.col("env_id").alias("part"))
    return (
        flag.agg(F.count("*").alias("hits")).withColumn("name", F.lit("flag-a"))
        .unionByName(event.agg(F.count("*").alias("hits")).withColumn("name", F.lit("purchase")))
    )


def _per_run(option):
    def fn(spark, d):
        paired = at.exposures_in_runs(fx.evaluations(spark, d), fx.design(spark, d), at.DesignFilters(**{option: True}))
        return paired.groupBy("run_id", "variant").agg(
            F.count("*").alias("evaluations"), F.count_distinct("user_key").alias("users")
        )

    return fn


PAIRED = """
SELECT r.run_id, e.variant, count(*) AS evaluations, count(DISTINCT e.user_key) AS users
FROM evals e JOIN runs r ON e.env_id = r.env_id AND e.flag_key = r.flag_key
 AND CAST(e.ts AS DATE) BETWEEN r.start_date AND r.end_date WHERE {0} GROUP BY ALL"""

query("b4_traffic_slice", W + PAIRED.format(
    f"(r.traffic_percent >= 100 OR ({KEYED} >= r.traffic_offset AND {KEYED} < r.traffic_offset + r.traffic_percent))"
))(_per_run("traffic"))
query("b5_layer_filter", W + PAIRED.format("(r.run_layer IS NULL OR e.layer_id = r.run_layer)"))(_per_run("layer"))
query("b6_audience_filter", W + PAIRED.format("""
 CASE r.nk % 3 WHEN 2 THEN coalesce(json_extract_string(e.user_properties, '$.k') NOT IN ('1', '2', '3'), true)
   WHEN 1 THEN coalesce(json_extract_string(e.user_properties, '$.k') <> '7', true) ELSE true END"""))(_per_run("audience"))


@query("b7_post_exposure", W + """
SELECT s.run_id, s.event_name, count(*) FILTER (m.ts >= fe.exposure_ts) AS after_exposure, count(*) FILTER (m.ts < fe.exposure_ts) AS before_exposure
FROM fe JOIN runs r ON r.run_id = fe.run_id JOIN specs s ON s.run_id = fe.run_id
JOIN mevents m ON m.env_id = fe.env_id AND m.user_key = fe.user_key AND m.event_name = s.event_name
 AND CAST(m.ts AS DATE) BETWEEN r.start_date AND r.end_date GROUP BY ALL""")
def b7(spark, d):
    design = fx.design(spark, d)
    fe = at.first_exposures(fx.evaluations(spark, d), design)
    # The same users, taken as exposed from the start of their run's window.
    starts = design.runs.select("run_id", "from_ts")
    early = fe.join(starts, "run_id").withColumn("first_ts", F.col("exposure_ts")).withColumn("exposure_ts", F.col("from_ts")).drop("from_ts")
    events = at.attributed_events(fx.metric_events(spark, d), early, design)
    after = F.col("event_ts") >= F.col("first_ts")
    return events.groupBy("run_id", "event_name").agg(
        F.count_if(after).alias("after_exposure"), F.count_if(~after).alias("before_exposure")
    )


@query("c1_attributed_events", W + """
SELECT s.run_id, s.event_name, fe.variant, count(*) AS events, count(DISTINCT m.user_key) AS users
FROM fe JOIN runs r ON r.run_id = fe.run_id JOIN specs s ON s.run_id = fe.run_id
JOIN mevents m ON m.env_id = fe.env_id AND m.user_key = fe.user_key AND m.event_name = s.event_name
 AND CAST(m.ts AS DATE) BETWEEN r.start_date AND r.end_date AND m.ts >= fe.exposure_ts GROUP BY ALL""")
def c1(spark, d):
    design = fx.design(spark, d)
    fe = at.first_exposures(fx.evaluations(spark, d), design)
    return at.attributed_events(fx.metric_events(spark, d), fe, design).groupBy("run_id", "event_name", "variant").agg(
        F.count("*").alias("events"), F.count_distinct("user_key").alias("users")
    )


@query("c2_all_exposed_users", W + f"""
SELECT run_id, user_key, variant, event_name, conv_count, {r('x', 4)} AS x FROM uc""")
def c2(spark, d):
    design = fx.design(spark, d)
    fe = at.first_exposures(fx.evaluations(spark, d), design)
    return at.user_contributions(fx.metric_events(spark, d), fe, design).select(
        "run_id", "user_key", "variant", "event_name", "conv_count", rnd("x", 4)
    )


@query("c3_many_runs", W + PAIRED.format("true"))
def c3(spark, d):
    paired = at.exposures_in_runs(fx.evaluations(spark, d), fx.design(spark, d))
    return paired.groupBy("run_id", "variant").agg(
        F.count("*").alias("evaluations"), F.count_distinct("user_key").alias("users")
    )


@query("c4_metric_fan_out", W + """
SELECT run_id, metric_ord, metric, role, sum(users)::BIGINT AS users, sum(conversions)::BIGINT AS conversions
FROM vs GROUP BY ALL""")
def c4(spark, d):
    s = at.variant_stats(fx.evaluations(spark, d), fx.metric_events(spark, d), fx.design(spark, d))
    return s.groupBy("run_id", "metric_ord", "metric", "role").agg(
        F.sum("users").alias("users"), F.sum("conversions").alias("conversions")
    )


@query("d1_first_exposure", W + """
SELECT run_id, user_key, variant, strftime(exposure_ts, '%Y-%m-%d %H:%M:%S.%g') AS exposure_ts FROM fe""")
def d1(spark, d):
    fe = at.first_exposures(fx.evaluations(spark, d), fx.design(spark, d))
    return fe.select("run_id", "user_key", "variant", stamp("exposure_ts"))


@query("d2_user_totals", W + f"""
SELECT run_id, user_key, metric_ord, conv_count, {r('user_sum', 4)} AS user_sum, {r('user_avg', 4)} AS user_avg FROM ut""")
def d2(spark, d):
    design = fx.design(spark, d)
    fe = at.first_exposures(fx.evaluations(spark, d), design)
    return at.user_totals(fx.metric_events(spark, d), fe, design).select(
        "run_id", "user_key", "metric_ord", "conv_count", rnd("user_sum", 4), rnd("user_avg", 4)
    )


@query("d3_contribution_by_agg", W + f"""
SELECT ut.run_id, ut.metric_ord, a.agg, count(*) AS users,
 {r("sum(CASE a.agg WHEN 'once' THEN 1.0 WHEN 'count' THEN ut.conv_count WHEN 'sum' THEN ut.user_sum ELSE ut.user_avg END)", 3)} AS total
FROM ut, (VALUES ('once'), ('count'), ('sum'), ('average')) a(agg) GROUP BY ALL""")
def d3(spark, d):
    design = fx.design(spark, d)
    fe = at.first_exposures(fx.evaluations(spark, d), design)
    totals = at.user_totals(fx.metric_events(spark, d), fe, design)
    each = totals.withColumn("agg", F.explode(F.array(*[F.lit(a) for a in ("once", "count", "sum", "average")])))
    x = at.contribution(F.col("agg"), F.col("conv_count"), F.col("user_sum"))
    return each.groupBy("run_id", "metric_ord", "agg").agg(F.count("*").alias("users"), rnd(F.sum(x), 3, "total"))


@query("d4_variant_stats", W + f"""
SELECT run_id, metric, variant, users, conversions, {r('sum_val', 4)} AS sum_val, {r('sum_sq', -2)} AS sum_sq
FROM vs""")
def d4(spark, d):
    s = at.variant_stats(fx.evaluations(spark, d), fx.metric_events(spark, d), fx.design(spark, d))
    return s.select("run_id", "metric", "variant", "users", "conversions", rnd("sum_val", 4), rnd("sum_sq", -2))


def _one_metric(env, flag, event, start, end, type_, agg):
    def fn(spark, d):
        q = at.query_experiment(
            fx.evaluations(spark, d), fx.metric_events(spark, d), env_id=env, flag_key=flag, metric_event=event,
            start=start, end=end, metric_type=type_, metric_agg=agg,
        )
        return q.select("variant", "users", "conversions", rnd("sum_val", 4), rnd("sum_sq", -2),
                        rnd("conversion_rate", 6), rnd("avg_value", 4))

    x = {"once": "(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE", "sum": "s", "average": "a"}["once" if type_ == "binary" else agg]
    sql = W + f""",
f AS (SELECT user_key, min({{'ts': ts, 'variant': variant}}) AS f FROM evals WHERE env_id = '{env}' AND flag_key = '{flag}'
  AND CAST(ts AS DATE) BETWEEN DATE '{start}' AND DATE '{end}' GROUP BY 1),
u AS (SELECT f.user_key, f.f.variant AS variant, count(m.ts) AS n, coalesce(sum(coalesce(m.numeric_value, 0)) FILTER (m.ts IS NOT NULL), 0) AS s,
  coalesce(avg(coalesce(m.numeric_value, 0)) FILTER (m.ts IS NOT NULL), 0) AS a
  FROM f LEFT JOIN mevents m ON m.env_id = '{env}' AND m.event_name = '{event}' AND m.user_key = f.user_key
  AND CAST(m.ts AS DATE) BETWEEN DATE '{start}' AND DATE '{end}' AND m.ts >= f.f.ts GROUP BY 1, 2),
g AS (SELECT variant, count(*) AS users, count(*) FILTER (n > 0) AS conversions, sum({x}) AS sv, sum({x} * {x}) AS sq FROM u GROUP BY 1)
SELECT variant, users, conversions, {r('sv', 4)} AS sum_val, {r('sq', -2)} AS sum_sq,
  {r('conversions / users', 6)} AS conversion_rate,
  {r('CASE WHEN conversions > 0 THEN sv / conversions ELSE 0 END', 4)} AS avg_value FROM g ORDER BY variant"""
    return fn, sql


for _name, _args in {
    "f1_query_experiment_sum": ("env-0", "flag-a", "purchase", "2024-01-05", "2024-01-07", "continuous", "sum"),
    "f1_query_experiment_once": ("env-1", "flag-b", "1-URGENT", "1996-01-01", "1998-12-31", "binary", "sum"),
    "f1_query_experiment_average": ("env-1", "flag-b", "1-URGENT", "1996-01-01", "1998-12-31", "continuous", "average"),
}.items():
    _fn, _sql = _one_metric(*_args)
    query(_name, _sql)(_fn)


@query("d5_derived_rates", W + f"""
SELECT run_id, metric, variant, {r('CASE WHEN users > 0 THEN conversions / users ELSE 0 END', 6)} AS conversion_rate,
 {r('CASE WHEN conversions > 0 THEN sum_val / conversions ELSE 0 END', 4)} AS avg_value FROM vs""")
def d5(spark, d):
    s = at.with_rates(at.variant_stats(fx.evaluations(spark, d), fx.metric_events(spark, d), fx.design(spark, d)))
    return s.select("run_id", "metric", "variant", rnd("conversion_rate", 6), rnd("avg_value", 4))


@query("d6_stat_shape", W + f"""
SELECT run_id, metric, variant, users::DOUBLE AS n, CASE WHEN metric_type = 'binary' THEN conversions::DOUBLE END AS k,
 CASE WHEN metric_type <> 'binary' THEN {r('sum_val', 4)} END AS "sum",
 CASE WHEN metric_type <> 'binary' THEN {r('sum_sq', -2)} END AS sum_squares FROM vs""")
def d6(spark, d):
    s = at.to_stats(at.variant_stats(fx.evaluations(spark, d), fx.metric_events(spark, d), fx.design(spark, d)))
    return s.select("run_id", "metric", "variant", "n", "k", rnd("sum", 4), rnd("sum_squares", -2))


MOMENTS = """
mo AS (SELECT vs.*, CASE WHEN metric_type = 'binary' THEN conversions / users ELSE sum_val / users END AS m_mean,
  CASE WHEN metric_type = 'binary' THEN (conversions / users) * (1 - conversions / users)
    WHEN users > 1 THEN (sum_sq - sum_val * sum_val / users) / (users - 1) ELSE 0 END AS m_var FROM vs)"""


@query("d7_moments", W + "," + MOMENTS + f"""
SELECT run_id, metric, variant, users AS m_n, {r('m_mean', 4)} AS m_mean,
 {r('CASE WHEN m_var > 1e6 THEN m_var / 1e6 ELSE m_var END', 3)} AS m_var_scaled FROM mo""")
def d7(spark, d):
    s = at.to_stats(at.variant_stats(fx.evaluations(spark, d), fx.metric_events(spark, d), fx.design(spark, d)))
    m = moments(*[F.col(c) for c in ("n", "k", "sum", "sum_squares", "mean", "variance")])
    v = F.when(m["m_var"] > 1e6, m["m_var"] / 1e6).otherwise(m["m_var"])
    return s.select("run_id", "metric", "variant", m["m_n"].alias("m_n"), rnd(m["m_mean"], 4, "m_mean"), rnd(v, 3, "m_var_scaled"))


@query("d12_balanced_sampling", W + """,
sz AS (SELECT run_id, variant, count(*) AS n FROM fe GROUP BY ALL), cap AS (SELECT run_id, min(n) AS cap FROM sz GROUP BY ALL),
rk AS (SELECT fe.run_id, fe.variant, fe.user_key, row_number() OVER (PARTITION BY fe.run_id, fe.variant ORDER BY md5(fe.user_key), fe.user_key) AS rn FROM fe)
SELECT rk.run_id, rk.variant, rk.user_key FROM rk JOIN cap USING (run_id) JOIN runs USING (run_id) WHERE rn <= cap OR method = 'bandit'""")
def d12(spark, d):
    design = fx.design(spark, d)
    fe = at.first_exposures(fx.evaluations(spark, d), design)
    return at.balance_exposures(fe, design).select("run_id", "variant", "user_key")


@query("d13_srm_denominators", W + f"""
SELECT r.run_id, e.variant, count(*) AS evaluations, count(DISTINCT e.user_key) AS users,
 {r('count(*) / count(DISTINCT e.user_key)', 6)} AS evaluations_per_user
FROM evals e JOIN runs r ON e.env_id = r.env_id AND e.flag_key = r.flag_key
 AND CAST(e.ts AS DATE) BETWEEN r.start_date AND r.end_date GROUP BY ALL""")
def d13(spark, d):
    s = at.srm_denominators(fx.evaluations(spark, d), fx.design(spark, d))
    return s.select("run_id", "variant", "evaluations", "users", rnd("evaluations_per_user", 6))


@query("d14_segment_stats", W + f""",
sg AS (SELECT uc.*, json_extract_string(user_properties, '$.k') AS segment FROM uc),
agg AS (SELECT run_id, metric_ord, variant, segment, 'segment' AS level, count(*) AS users, count(*) FILTER (conv_count > 0) AS conversions, sum(x) AS sv FROM sg GROUP BY ALL
 UNION ALL SELECT run_id, metric_ord, variant, NULL, 'total', count(*), count(*) FILTER (conv_count > 0), sum(x) FROM sg GROUP BY ALL)
SELECT run_id, metric_ord, variant, segment, level, users, conversions, {r('sv', 3)} AS sum_val FROM agg""")
def d14(spark, d):
    s = at.segment_stats(fx.evaluations(spark, d), fx.metric_events(spark, d), fx.design(spark, d), "k")
    return s.select("run_id", "metric_ord", "variant", "segment", "level", "users", "conversions", rnd("sum_val", 3))


@query("a6_hash_bucket", W + f"SELECT DISTINCT e.user_key, e.flag_key, {KEYED} AS bucket FROM evals e")
def a6(spark, d):
    e = fx.evaluations(spark, d).select("user_key", "flag_key").distinct()
    return e.select("user_key", "flag_key", hash_bucket(F.col("user_key"), F.col("flag_key")).cast("bigint").alias("bucket"))


ARGUMENTS = """
WITH a AS (SELECT o_orderkey AS request, CASE WHEN k = 1 THEN '' ELSE 'env-1' END AS caller_env, CASE k WHEN 2 THEN 'env-0' WHEN 3 THEN 'env-1' ELSE '' END AS env_id,
 CASE WHEN k = 4 THEN ' ' ELSE 'flag-b' END AS flag_key, CASE WHEN k = 5 THEN NULL ELSE o_orderpriority END AS metric_event,
 CASE k WHEN 6 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 7 THEN '2024-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS start,
 CASE k WHEN 8 THEN '1990-01-01' WHEN 9 THEN '' WHEN 10 THEN 'soon' ELSE strftime(o_orderdate + INTERVAL 5 DAY, '%Y-%m-%d') END AS end_,
 CASE k WHEN 11 THEN 'numeric' ELSE 'binary' END AS metric_type, CASE k WHEN 12 THEN 'last' ELSE 'once' END AS metric_agg
FROM (SELECT *, o_orderkey % 14 AS k FROM orders))"""


@query("b12_argument_checks", ARGUMENTS + """
SELECT request, CASE WHEN trim(flag_key) = '' OR coalesce(metric_event, '') = '' OR start = '' OR end_ = '' THEN 'flag_key, metric_event, start, end, metric_type, metric_agg are all required'
 WHEN metric_type <> 'binary' THEN 'metric_type must be one of binary, continuous' WHEN metric_agg <> 'once' THEN 'metric_agg must be one of once, count, sum, average'
 WHEN try_strptime(start, '%Y-%m-%d') IS NULL THEN 'start must be YYYY-MM-DD' WHEN try_strptime(end_, '%Y-%m-%d') IS NULL THEN 'end must be YYYY-MM-DD'
 WHEN end_ < start THEN 'end must not be before start' WHEN caller_env = '' THEN 'env_id is required'
 WHEN env_id <> '' AND env_id <> caller_env THEN 'requested env_id does not match the caller''s environment' END AS error FROM a""")
def b12(spark, d):
    """One request per order, some of them wrong in one way or another."""
    o, k = fx.table(spark, d, "orders"), F.col("o_orderkey") % 14
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        F.col("o_orderkey").alias("request"), F.when(k == 1, "").otherwise("env-1").alias("caller_env"),
        F.when(k == 2, "env-0").when(k == 3, "env-1").otherwise("").alias("env_id"), F.when(k == 4, " ").otherwise("flag-b").alias("flag_key"),
        F.when(k != 5, F.col("o_orderpriority")).alias("metric_event"),
        F.when(k == 6, F.date_format("o_orderdate", "dd.MM.yyyy")).when(k == 7, "2024-02-30").otherwise(text).alias("start"),
        F.when(k == 8, "1990-01-01").when(k == 9, "").when(k == 10, "soon").otherwise(F.date_format(F.date_add("o_orderdate", 5), "yyyy-MM-dd")).alias("end"),
        F.when(k == 11, "numeric").otherwise("binary").alias("metric_type"), F.when(k == 12, "last").otherwise("once").alias("metric_agg"),
    ).select("request", fl.argument_error().alias("error"))


@query("d4_growing_runs", W + """,
gr AS (SELECT 's-' || CAST(s_suppkey AS VARCHAR) AS run_id, DATE '1995-01-01' + CAST(s_suppkey * 37 % 2000 AS INTEGER) AS a, DATE '1995-01-01' + CAST(s_suppkey * 37 % 2000 AS INTEGER) + 60 AS b FROM supplier),
gf AS (SELECT run_id, a, b, user_key, min({'ts': ts, 'variant': variant}) AS f FROM evals JOIN gr ON env_id = 'env-1' AND CAST(ts AS DATE) BETWEEN a AND b GROUP BY ALL),
gu AS (SELECT run_id, gf.user_key, count(*) AS c FROM gf JOIN mevents m ON m.env_id = 'env-1' AND m.user_key = gf.user_key AND event_name = '1-URGENT'
  AND CAST(m.ts AS DATE) BETWEEN a AND b AND m.ts >= gf.f.ts GROUP BY ALL)
SELECT run_id, f.variant AS variant, count(*) AS users, count(c) AS conversions, coalesce(sum(c), 0)::DOUBLE AS sum_val FROM gf LEFT JOIN gu USING (run_id, user_key) GROUP BY ALL""")
def d4_growing(spark, d):
    """A run per supplier: the run side grows with the tables."""
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") * 37 % 2000).cast("int"))
    runs = fx.table(spark, d, "supplier").select(
        F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("run_id"), F.lit("env-1").alias("env_id"), F.lit("flag-b").alias("flag_key"),
        start.alias("start_date"), F.date_add(start, 60).alias("end_date"),
    )
    specs = runs.select(
        "run_id", "env_id", F.lit(0).alias("metric_ord"), F.lit("primary").alias("role"), F.lit("1-URGENT").alias("event_name"),
        F.lit("continuous").alias("metric_type"), F.lit("count").alias("metric_agg"), F.lit(False).alias("inverse"),
    )
    v = at.variant_stats(fx.evaluations(spark, d), fx.metric_events(spark, d), at.load_design(runs, specs))
    return v.select("run_id", "variant", "users", "conversions", "sum_val")
