"""Design-table, normaliser, rollup and holdout queries (B8-B16, C8, C9, D8-D11, E, F, G, I14)."""

from pyspark.sql import functions as F

from liftwise.operators import attribution as at
from liftwise.operators import design, normalize, rollups
from liftwise.operators import runs as run_lists
from liftwise.plans import bayes, decision, holdout
from workload import fixtures as fx
from workload.analysis_queries import BAYES
from workload.catalog import query, r, rnd

W = "WITH " + fx.CTE

# ---------------------------------------------------------------- experiments and runs from the part table

CONSTRAINTS = ["New users only, accounts created lately", "All users on a plan", "Enterprise accounts", "Free tier and pricing page", "", None]


def _case(column, values):
    c = F.when(column == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], 1):
        c = c.when(column == i, F.lit(v))
    return c


def _sql_case(expr, values):
    arms = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


STAGES = ["learning", "measuring", "implementing", "intent"]
STATUSES = ["draft", "collecting", "analyzing", "decided", "running"]


def experiments(spark, d):
    p = fx.table(spark, d, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("experiment_id"), F.when(key % 7 != 0, F.lit("env-0")).alias("env_id"),
        F.when(key % 9 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("flag_key"),
        F.concat("p_type", F.lit(" — share of "), "p_name").alias("primary_metric"),
        _case(F.col("p_size") % 6, CONSTRAINTS).alias("constraints"), _case(key % 4, STAGES).alias("stage"),
        F.timestamp_seconds(F.lit(1704067200) + (key * 7919) % 100000).alias("updated_at"),
    )


def part_runs(spark, d):
    p = fx.table(spark, d, "part")
    key = F.col("p_partkey")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (key % 60).cast("int"))
    return p.select(
        key.alias("run_id"), (key / 2).cast("bigint").alias("experiment_id"),
        F.concat(F.lit("env-"), (key % 2).cast("string")).alias("env_id"), F.when(key % 17 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("flag_key"),
        _case(key % 5, STATUSES).alias("status"),
        F.when(key % 11 != 0, start.cast("timestamp")).alias("observation_start"),
        F.when(F.col("p_size") % 5 != 0, F.date_add(start, F.col("p_size")).cast("timestamp")).alias("observation_end"),
        ((F.col("p_size") % 4) * 25).alias("traffic_offset"),
        (F.lit(10) + F.col("p_size") % 40).cast("double").alias("traffic_percent"),
        F.when(key % 13 != 0, F.concat(F.lit("layer-"), (F.col("p_size") % 3).cast("string"))).alias("layer_id"),
        F.timestamp_seconds(F.lit(1704067200) + (key * 104729) % 1000).alias("created_at"),
        F.timestamp_seconds(F.lit(1704067200) + (key * 7919) % 100000).alias("updated_at"),
    )


PARTS = f"""
ex AS (SELECT p_partkey AS experiment_id, CASE WHEN p_partkey % 7 <> 0 THEN 'env-0' END AS env_id,
  CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS flag, p_type AS metric,
  {_sql_case('p_size % 6', CONSTRAINTS)} AS constraints, {_sql_case('p_partkey % 4', STAGES)} AS stage,
  to_timestamp(1704067200 + (p_partkey * 7919) % 100000) AS updated_at,
  CASE p_size % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 + 4 WHEN 2 THEN 16 WHEN 3 THEN 4 + 8 ELSE 0 END AS mask FROM part),
pr AS (SELECT p_partkey AS run_id, p_partkey // 2 AS experiment_id, 'env-' || (p_partkey % 2) AS env_id, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_brand END AS flag_key, {_sql_case('p_partkey % 5', STATUSES)} AS status,
  CASE WHEN p_partkey % 11 <> 0 THEN DATE '2024-01-01' + CAST(p_partkey % 60 AS INTEGER) END AS s,
  CASE WHEN p_size % 5 <> 0 THEN DATE '2024-01-01' + CAST(p_partkey % 60 AS INTEGER) + p_size END AS e,
  (p_size % 4) * 25 AS off, (10 + p_size % 40)::DOUBLE AS pct, coalesce(CASE WHEN p_partkey % 13 <> 0 THEN 'layer-' || CAST(p_size % 3 AS VARCHAR) END, 'default') AS layer,
  (p_partkey * 104729) % 1000 AS created, (p_partkey * 7919) % 100000 AS updated FROM part)"""


@query("c8_conflict_counts", "WITH " + PARTS + """,
p AS (SELECT a.experiment_id, coalesce(a.flag = b.flag, false) AS f, coalesce(a.metric = b.metric, false) AS m, (a.mask & b.mask) <> 0 AS s
  FROM ex a JOIN ex b ON a.experiment_id <> b.experiment_id AND b.stage <> 'learning')
SELECT experiment_id, count(*) FILTER (f) AS same_flag, count(*) FILTER (m) AS same_metric, count(*) FILTER (s) AS same_audience,
 count(*) FILTER (f AND m) AS high, count(*) FILTER (f <> m) AS medium, count(*) FILTER (s AND NOT f AND NOT m) AS low,
 count(*) FILTER (f OR m OR s) > 0 AS has_conflicts FROM p GROUP BY 1""")
def c8(spark, d):
    return design.conflict_counts(experiments(spark, d))


@query("c8_conflicts_of_one", "WITH " + PARTS + """,
p AS (SELECT b.experiment_id, b.stage, coalesce(a.flag = b.flag, false) AS f, coalesce(a.metric = b.metric, false) AS m, (a.mask & b.mask) <> 0 AS s
  FROM (SELECT * FROM ex WHERE experiment_id = (SELECT max(experiment_id) FROM ex)) a JOIN ex b ON a.experiment_id <> b.experiment_id AND b.stage <> 'learning')
SELECT experiment_id, stage, concat_ws(',', CASE WHEN f THEN 'flag_key' END, CASE WHEN m THEN 'metric' END, CASE WHEN s THEN 'audience' END) AS dimensions,
 CASE WHEN f AND m THEN 'high' WHEN f OR m THEN 'medium' ELSE 'low' END AS severity FROM p WHERE f OR m OR s""")
def c8_one(spark, d):
    e = experiments(spark, d)
    c = design.conflicts_of(e, e.agg(F.max("experiment_id").alias("experiment_id")))
    return c.select("experiment_id", "stage", F.concat_ws(",", "dimensions").alias("dimensions"), "severity")


OVERLAP = """a.s <= coalesce(b.e, DATE '2099-12-31') AND b.s <= coalesce(a.e, DATE '2099-12-31')
  AND a.experiment_id <> b.experiment_id AND b.status IN ('draft', 'collecting', 'analyzing')"""


NOT_OVER = "b.experiment_id NOT IN (SELECT experiment_id FROM ex WHERE stage = 'learning')"


@query("c9_overlap_counts", "WITH " + PARTS + f"""
SELECT a.run_id, count(b.run_id) AS overlapping_runs FROM pr a LEFT JOIN pr b ON a.flag_key = b.flag_key AND {OVERLAP} AND {NOT_OVER}
WHERE a.s IS NOT NULL AND a.flag_key <> '' AND a.status <> 'decided' GROUP BY 1""")
def c9(spark, d):
    return design.overlap_counts(part_runs(spark, d), experiments(spark, d))


@query("c9_overlaps_of_one", "WITH " + PARTS + f"""
SELECT a.run_id AS focus_run, b.run_id, b.flag_key, 'Run "' || a.run_id || '" of ' || a.s || ' to ' || coalesce(a.e, DATE '2099-12-31')
 || ' runs beside "' || b.run_id || '" of ' || b.s || ' to ' || coalesce(b.e, DATE '2099-12-31') AS detail
FROM pr a JOIN pr b ON a.flag_key = b.flag_key AND {OVERLAP} AND {NOT_OVER}
WHERE a.flag_key <> '' AND a.experiment_id = (SELECT max(experiment_id) FROM pr WHERE s IS NOT NULL AND status <> 'decided') AND a.status <> 'decided'""")
def c9_one(spark, d):
    runs = part_runs(spark, d)
    open_runs = runs.where(F.col("observation_start").isNotNull() & (F.col("status") != "decided"))
    return design.overlaps_of(runs, open_runs.agg(F.max("experiment_id").alias("experiment_id")), experiments(spark, d))


@query("g3_audience_signals", "WITH " + PARTS + """
SELECT experiment_id, CASE mask WHEN 1 THEN 'new_users' WHEN 6 THEN 'all_users,pricing_users' WHEN 16 THEN 'enterprise' WHEN 12 THEN 'pricing_users,free_tier' ELSE '' END AS signals,
 CASE WHEN mask IN (6, 12) THEN 'pricing_users' ELSE '' END AS shared FROM ex""")
def g3(spark, d):
    c = F.coalesce("constraints", F.lit(""))
    return experiments(spark, d).select(
        "experiment_id", F.concat_ws(",", design.audience_signals(c)).alias("signals"),
        F.concat_ws(",", design.shared_signals(c, F.lit("the pricing page"))).alias("shared"),
    )


@query("e1_latest_run", "WITH " + PARTS + """
SELECT DISTINCT ON (experiment_id) experiment_id, run_id, status FROM pr ORDER BY experiment_id, created DESC, run_id""")
def e1(spark, d):
    return run_lists.latest_runs(part_runs(spark, d)).select("experiment_id", "run_id", "status")


SLICES = """
sl AS (SELECT *, least(off + pct, 100.0) AS fin, lag(least(off + pct, 100.0)) OVER o AS prev, max(least(off + pct, 100.0)) OVER (PARTITION BY env_id, flag_key, layer ORDER BY off, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
  row_number() OVER (PARTITION BY env_id, flag_key, layer ORDER BY off DESC, run_id DESC) AS lastness FROM pr WINDOW o AS (PARTITION BY env_id, flag_key, layer ORDER BY off, run_id))"""


@query("e3_traffic_allocation", "WITH " + PARTS + "," + SLICES + """
SELECT env_id, flag_key, layer, 'run' AS kind, run_id, off::DOUBLE AS "start", fin AS "end" FROM sl
UNION ALL SELECT env_id, flag_key, layer, 'gap', NULL, coalesce(prev, 0), off FROM sl WHERE off > coalesce(prev, 0)
UNION ALL SELECT env_id, flag_key, layer, 'gap', NULL, fin, 100.0 FROM sl WHERE lastness = 1 AND fin < 100""")
def e3(spark, d):
    a = design.traffic_allocation(part_runs(spark, d))
    return a.withColumn("run_id", F.col("run_id").cast("bigint"))


@query("e4_traffic_conflicts", "WITH " + PARTS + "," + SLICES + """
SELECT env_id, flag_key, layer, run_id, coalesce(off < reach, false) AS overlaps, off + pct > 100 AS past_end FROM sl WHERE coalesce(off < reach, false) OR off + pct > 100""")
def e4(spark, d):
    return design.traffic_conflicts(part_runs(spark, d)).select("env_id", "flag_key", "layer", "run_id", "overlaps", "past_end")


@query("e5_timeline", "WITH " + PARTS + f""",
t AS (SELECT run_id, flag_key, s, e, epoch(s) AS a, epoch(coalesce(e, DATE '2024-02-01')) AS b FROM pr WHERE s IS NOT NULL),
g AS (SELECT *, min(a) OVER (PARTITION BY flag_key) AS lo, max(b) OVER (PARTITION BY flag_key) AS hi,
  row_number() OVER (PARTITION BY flag_key ORDER BY a, run_id) AS phase FROM t)
SELECT run_id, flag_key, {r('(a - lo) / (hi - lo) * 100', 5)} AS left_pct, {r('(b - a) / (hi - lo) * 100', 5)} AS width_pct, e IS NULL AS ongoing, phase FROM g""")
def e5(spark, d):
    t = design.observation_timeline(part_runs(spark, d), fx.AS_OF, group="flag_key")
    return t.select("run_id", "flag_key", rnd("left_pct", 5), rnd("width_pct", 5), "ongoing", "phase")


@query("f2_experiments_by_env", "WITH " + PARTS + " SELECT experiment_id, stage FROM ex WHERE env_id = 'env-0' ORDER BY updated_at DESC, experiment_id")
def f2(spark, d):
    return run_lists.experiments_of(experiments(spark, d), "env-0").select("experiment_id", "stage")


@query("f3_latest_activities", """
SELECT experiment_id, activity_id, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id AS experiment_id, event_id AS activity_id,
 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= 20""")
def f3(spark, d):
    activities = fx.raw_events(spark, d).select(
        F.col("user_id").alias("experiment_id"), F.col("event_id").alias("activity_id"), F.col("ts").alias("created_at"),
        F.col("event_type").alias("type"),
    )
    return run_lists.latest_activities(activities).select("experiment_id", "activity_id", "rank")


@query("b16_active_runs", "WITH " + PARTS + """
SELECT pr.run_id, pr.experiment_id, ex.env_id AS experiment_env FROM pr JOIN ex USING (experiment_id)
WHERE status IN ('draft', 'collecting', 'analyzing') ORDER BY updated DESC, run_id""")
def b16(spark, d):
    return run_lists.active_runs(part_runs(spark, d), experiments(spark, d)).select("run_id", "experiment_id", "experiment_env")


# ---------------------------------------------------------------- normalisers

TYPES = ["binary", "continuous", "numeric", "ratio", None]
AGGS = ["once", "count", "sum", "average", "last", None]


@query("b8_metric_vocabulary", f"""
WITH p AS (SELECT p_partkey AS id, {_sql_case('p_partkey % 5', TYPES)} AS t, {_sql_case('p_size % 6', AGGS)} AS a FROM part)
SELECT id, CASE WHEN t IN ('continuous', 'numeric') THEN 'continuous' ELSE 'binary' END AS metric_type,
 CASE WHEN a IN ('count', 'sum', 'average') THEN a ELSE 'once' END AS agg_read,
 CASE WHEN coalesce(t NOT IN ('continuous', 'numeric'), true) THEN 'once' WHEN a IN ('count', 'sum', 'average') THEN a ELSE 'sum' END AS agg_write,
 CASE WHEN t = 'binary' THEN 'once' ELSE a END AS agg_query FROM p""")
def b8(spark, d):
    t, a = _case(F.col("p_partkey") % 5, TYPES), _case(F.col("p_size") % 6, AGGS)
    return fx.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), normalize.metric_type(t).alias("metric_type"), normalize.metric_agg_read(a).alias("agg_read"),
        normalize.metric_agg_write(a, t).alias("agg_write"), normalize.canonical_agg(t, a).alias("agg_query"),
    )


GUARDS = [
    '["page_bounce","latency"]',
    '[{"event":"bounce","metricType":"numeric","metricAgg":"sum","direction":"increase_bad"},"exit"]',
    '[{"event":"err","inverse":false,"direction":"increase_bad"},{"metricAgg":"sum"},""]',
    '{"event":"x"}',
    "not json",
    None,
]
GUARDS_OUT = [
    "page_bounce/binary/once/false;latency/binary/once/false",
    "bounce/continuous/sum/true;exit/binary/once/false",
    "err/binary/once/false",
    "", "", "",
]


@query("b9_guardrail_definitions", f"SELECT p_partkey AS id, {_sql_case('p_partkey % 6', GUARDS_OUT)} AS guardrails FROM part")
def b9(spark, d):
    g = normalize.guardrail_definitions(_case(F.col("p_partkey") % 6, GUARDS))
    text = F.transform(g, lambda x: F.concat_ws("/", x["event"], x["metric_type"], x["metric_agg"], x["inverse"].cast("string")))
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(";", text).alias("guardrails"))


PRIMARIES = [
    '{"name":"Buy","event":"buy","metricType":"numeric","metricAgg":"average","description":"d"}',
    '{"event":"view","metricType":"ratio","metricAgg":"last"}', '{"name":"no event"}', "plain text — more", "broken {", None,
]


@query("b10_primary_metric", f"""
SELECT p_partkey AS id, {_sql_case('p_partkey % 6', ['buy/continuous/average', 'view/binary/once', None, None, None, None])} AS primary_metric,
 {_sql_case('p_partkey % 6', [PRIMARIES[0], PRIMARIES[1], PRIMARIES[2], 'plain text', 'broken {', None])} AS title FROM part""")
def b10(spark, d):
    raw = _case(F.col("p_partkey") % 6, PRIMARIES)
    p = normalize.primary_metric(raw)
    return fx.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(p.isNotNull(), F.concat_ws("/", p["event"], p["metric_type"], p["metric_agg"])).alias("primary_metric"),
        normalize.metric_title(raw).alias("title"),
    )


METHOD_CASES = [None, "bandit", "bayesian_ab"]
TREATMENTS = [None, " a ,, b", "v1", "v1,v2,v3", ""]
TREATMENTS_OUT = ["true", "a|b", "v1", "v1|v2|v3", ""]


def sparse_runs(spark, d):
    """Run definitions from the part table with all kinds of gaps."""
    p = fx.table(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (key % 60).cast("int"))
    return p.select(
        key.alias("run_id"), F.lit("env-0").alias("env_id"), F.col("p_brand").alias("flag_key"),
        _case(key % 3, METHOD_CASES).alias("method"),
        F.when(key % 4 != 0, F.lit("v0")).alias("control_variant"),
        _case(key % 5, TREATMENTS).alias("treatment_variant"),
        F.when(key % 11 != 0, start.cast("timestamp")).alias("observation_start"),
        F.when(size % 5 != 0, F.date_add(start, size).cast("timestamp")).alias("observation_end"),
        F.when(key % 2 == 0, F.lit(True)).alias("prior_proper"),
        F.when(key % 7 == 0, F.lit(0.1)).alias("prior_stddev"),
        F.when(key % 3 != 0, size).alias("minimum_sample"),
        F.col("p_type").alias("primary_metric_event"), _case(key % 5, TYPES).alias("primary_metric_type"),
        _case(size % 6, AGGS).alias("primary_metric_agg"), _case(key % 6, GUARDS).alias("guardrail_events"),
    )


@query("b11_run_defaults", f"""
SELECT p_partkey AS run_id, coalesce({_sql_case('p_partkey % 3', METHOD_CASES)}, 'bayesian_ab') AS method,
 CASE WHEN p_partkey % 4 <> 0 THEN 'v0' ELSE 'false' END AS control, {_sql_case('p_partkey % 5', TREATMENTS_OUT)} AS treatments,
 CAST(CASE WHEN p_partkey % 11 <> 0 THEN DATE '2024-01-01' + CAST(p_partkey % 60 AS INTEGER) ELSE DATE '2024-01-02' END AS VARCHAR) AS start_date,
 CAST(CASE WHEN p_size % 5 <> 0 THEN DATE '2024-01-01' + CAST(p_partkey % 60 AS INTEGER) + p_size ELSE DATE '2024-02-01' END AS VARCHAR) AS end_date,
 p_partkey % 2 = 0 AS prior_proper, 0.0::DOUBLE AS prior_mean, CASE WHEN p_partkey % 7 = 0 THEN 0.1 ELSE 0.3 END::DOUBLE AS prior_stddev,
 CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE 0 END AS minimum_sample FROM part""")
def b11(spark, d):
    x = normalize.run_defaults(sparse_runs(spark, d), fx.AS_OF)
    return x.select(
        "run_id", "method", "control", F.concat_ws("|", "treatments").alias("treatments"),
        F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"),
        "prior_proper", "prior_mean", "prior_stddev", "minimum_sample",
    )


@query("i18_arm_thresholds", f"""
WITH a AS (SELECT p_partkey AS run_id, CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 1 END AS arms FROM part)
SELECT run_id, arms, {r('1 - 0.05 / arms', 6)} AS p_win_threshold, {r('1 - 0.95 ** arms', 6)} AS family_error FROM a""")
def i18(spark, d):
    t = decision.thresholds(normalize.run_defaults(sparse_runs(spark, d), fx.AS_OF))
    return t.select("run_id", "arms", rnd("p_win_threshold", 6), rnd("family_error", 6))


@query("b13_run_violations", "WITH " + PARTS + """
SELECT run_id, 'Invalid status "running". Valid: draft | collecting | analyzing | decided | archived' ||
 CASE WHEN run_id % 3 = 0 THEN '; Invalid decision "SHIP". Valid: CONTINUE | PAUSE | ROLLBACK | INCONCLUSIVE' ELSE '' END AS violations
FROM pr WHERE status = 'running' UNION ALL
SELECT run_id, 'Invalid decision "SHIP". Valid: CONTINUE | PAUSE | ROLLBACK | INCONCLUSIVE' FROM pr WHERE status <> 'running' AND run_id % 3 = 0""")
def b13(spark, d):
    runs = part_runs(spark, d).withColumn("decision", F.when(F.col("run_id") % 3 == 0, F.lit("SHIP")).when(F.col("run_id") % 3 == 1, F.lit("PAUSE")))
    bad = normalize.run_violations(runs).where(F.size("violations") > 0)
    return bad.select("run_id", F.concat_ws("; ", "violations").alias("violations"))


DEFS = [
    '[{"name":"a","event":"b","metricType":"binary","metricAgg":"once","direction":"increase_bad"}]',
    '[{"name":"a","event":"b","metricType":"ratio","metricAgg":"once"},"bare"]', "[]", "x",
]
DEFS_OUT = [
    "", "guardrail[0].metricType must be one of: binary | continuous|guardrail[0].direction must be one of: increase_bad | decrease_bad|guardrail[1] must be a JSON object.",
    "", "guardrails must be a JSON array.",
]
PRIMARY_OUT = [
    "",
    "primaryMetric.name is required (non-empty string).|primaryMetric.metricType must be one of: binary | continuous|primaryMetric.metricAgg must be one of: once | count | sum | average",
    "primaryMetric.event is required (non-empty string).|primaryMetric.metricType must be one of: binary | continuous|primaryMetric.metricAgg must be one of: once | count | sum | average",
    "primaryMetric must be a JSON object.", "primaryMetric must be a JSON object.", "primaryMetric must be a JSON object.",
]


PRIMARIES_STRICT = ['{"name":"Buy","event":"buy","metricType":"continuous","metricAgg":"average","description":"d"}', *PRIMARIES[1:]]


@query("b14_definition_violations", f"""
SELECT p_partkey AS id, {_sql_case('p_partkey % 6', PRIMARY_OUT)} AS primary_errors, {_sql_case('p_partkey % 4', DEFS_OUT)} AS guardrail_errors FROM part""")
def b14(spark, d):
    return fx.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat_ws("|", normalize.primary_definition_violations(_case(F.col("p_partkey") % 6, PRIMARIES_STRICT))).alias("primary_errors"),
        F.concat_ws("|", normalize.guardrail_definition_violations(_case(F.col("p_partkey") % 4, DEFS))).alias("guardrail_errors"),
    )


OLD_GUARDS = ['[{"name":"Bounce","metricType":"numeric","metricAgg":"last","direction":"increase_bad"},"exit"]', "oops", None]
NEW_GUARDS = [
    '[{"name":"Bounce","metricType":"continuous","metricAgg":"sum","inverse":true,"direction":"increase_bad"},{"event":"exit","metricType":"binary","metricAgg":"once","inverse":false}]',
    "oops", None,
]
RUN_GUARDS = ['[{"event":"Bounce","metricType":"continuous","metricAgg":"sum","inverse":true},{"event":"exit","metricType":"binary","metricAgg":"once","inverse":false}]', None, None]
NEW_PRIMARIES = [
    '{"name":"Buy","event":"buy","metricType":"continuous","metricAgg":"average","description":"d"}',
    '{"event":"view","metricType":"binary","metricAgg":"once"}',
    '{"name":"no event","metricType":"binary","metricAgg":"once"}', "plain text — more", "broken {", None,
]


@query("b15_migrated_definitions", f"""
WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 3 THEN 'hypothesis' ELSE {_sql_case('p_partkey % 4', STAGES)} END AS new_stage,
 {_sql_case('p_partkey % 6', NEW_PRIMARIES)} AS new_primary_metric, {_sql_case('p_partkey % 3', NEW_GUARDS)} AS new_guardrails,
 {_sql_case('p_partkey % 3', RUN_GUARDS)} AS run_guardrail_events FROM part)
SELECT *, id % 4 = 3 OR id % 6 IN (0, 1, 2) OR id % 3 = 0 AS changed FROM p""")
def b15(spark, d):
    old = fx.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), _case(F.col("p_partkey") % 4, STAGES).alias("stage"),
        _case(F.col("p_partkey") % 6, PRIMARIES).alias("primary_metric"), _case(F.col("p_partkey") % 3, OLD_GUARDS).alias("guardrails"),
    )
    m = normalize.migrate_definitions(old)
    return m.select("id", "new_stage", "new_primary_metric", "new_guardrails", "run_guardrail_events", "changed")


@query("g1_union_of_specs", """
SELECT p_partkey AS run_id, 0 AS ord, p_type AS event_name, 'primary' AS role FROM part
UNION ALL SELECT p_partkey, g.ord, g.event, 'guardrail' FROM part, (VALUES (0, 1, 'page_bounce'), (0, 2, 'latency'), (1, 1, 'bounce'), (1, 2, 'exit'), (2, 1, 'err')) g(kind, ord, event)
WHERE g.kind = p_partkey % 6""")
def g1(spark, d):
    s = normalize.metric_specs(normalize.run_defaults(sparse_runs(spark, d), fx.AS_OF))
    primary = s.where(F.col("role") == "primary").drop("metric_ord")
    guards = s.where(F.col("role") == "guardrail").withColumn("metric_ord", F.col("metric_ord") - 1)
    return normalize.union_specs(primary, guards).select("run_id", "ord", "event_name", "role")


@query("g4_distinct_events", """
SELECT p_partkey AS id, CASE WHEN p_type = p_brand THEN p_type ELSE p_type || ',' || p_brand END AS events FROM part""")
def g4(spark, d):
    listed = F.array("p_type", F.lit(""), "p_brand", "p_type", F.lit(None).cast("string"), "p_brand")
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(",", normalize.distinct_events(listed)).alias("events"))


# ---------------------------------------------------------------- rollups

@query("d8_exposure_daily", W + """
SELECT env_id, flag_key, variant, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(DISTINCT user_key) AS users FROM evals GROUP BY ALL""")
def d8(spark, d):
    return rollups.exposure_daily(fx.evaluations(spark, d)).withColumn("date", F.col("date").cast("string"))


@query("d9_event_daily", W + f"""
SELECT env_id, event_name, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(DISTINCT user_key) AS users, count(*) AS events,
 {r('coalesce(sum(numeric_value), 0)', 3)} AS value_sum, {r('coalesce(sum(numeric_value * numeric_value), 0)', -2)} AS value_sum_sq FROM mevents GROUP BY ALL""")
def d9(spark, d):
    e = rollups.event_daily(fx.metric_events(spark, d))
    return e.select("env_id", "event_name", F.col("date").cast("string").alias("date"), "users", "events", rnd("value_sum", 3), rnd("value_sum_sq", -2))


@query("d10_sketch_rollup", W + """
SELECT env_id, event_name, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS events, true AS estimate_ok FROM mevents GROUP BY ALL""")
def d10(spark, d):
    e = fx.metric_events(spark, d)
    exact = rollups.event_daily(e).select("env_id", "event_name", "date", "users")
    s = rollups.event_daily_sketch(e).join(exact, ["env_id", "event_name", "date"])
    estimate = F.hll_sketch_estimate("users_sketch")
    ok = F.abs(estimate - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 0.04)
    return s.select("env_id", "event_name", F.col("date").cast("string").alias("date"), "events", ok.alias("estimate_ok"))


@query("d11_merged_exposures", W + """
SELECT env_id, flag_key, variant, count(DISTINCT user_key) AS users, true AS estimate_ok FROM evals
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ALL""")
def d11(spark, d):
    e = fx.evaluations(spark, d)
    exact = rollups.merge_exposures(rollups.exposure_user_days(e), "2024-01-05", "2024-01-20")
    rough = rollups.merge_exposure_sketches(rollups.exposure_daily_sketch(e), "2024-01-05", "2024-01-20")
    both = exact.join(rough.withColumnRenamed("users", "estimate"), ["env_id", "flag_key", "variant"])
    ok = F.abs(F.col("estimate") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 0.04)
    return both.select("env_id", "flag_key", "variant", "users", ok.alias("estimate_ok"))


@query("d11_merged_events", W + f"""
SELECT env_id, event_name, count(DISTINCT user_key) AS users, count(*) AS events, {r('sum(numeric_value)', 3)} AS value_sum FROM mevents
WHERE CAST(ts AS DATE) BETWEEN DATE '1996-01-05' AND DATE '1999-01-20' GROUP BY ALL""")
def d11_events(spark, d):
    days = rollups.event_user_days(fx.metric_events(spark, d))
    m = rollups.merge_events(days, "1996-01-05", "1999-01-20")
    return m.select("env_id", "event_name", "users", "events", rnd("value_sum", 3))


# ---------------------------------------------------------------- holdout

_SHIFTED = fx.CTE.replace("\nruns AS (", "\nbase_runs AS (", 1)
_HEAD, _TAIL = _SHIFTED.split("\narms AS (", 1)
HOLDOUT = _HEAD.rstrip().rstrip(",") + """,
runs AS (SELECT b.* REPLACE (b.run_id || '@' || c.day AS run_id, b.end_date + 1 + c.day - 29 AS start_date, b.end_date + 1 + c.day AS end_date), b.run_id AS parent_run, c.day AS checkpoint_day
  FROM base_runs b, (VALUES (30), (60), (90)) c(day)),
arms AS (""" + _TAIL


def _checkpoints(spark, d):
    runs = holdout.checkpoint_runs(fx.runs(spark, d))
    design_ = at.load_design(runs, normalize.metric_specs(runs))
    stats = at.to_stats(at.variant_stats(fx.evaluations(spark, d), fx.metric_events(spark, d), design_))
    c = bayes.section_rows(bayes.compare(stats, runs)).where(F.col("arm_idx") > 0)
    parts = F.split("run_id", "@")
    return c.withColumn("parent_run", parts[0]).withColumn("checkpoint_day", parts[1].cast("int"))


CHECKS = "WITH " + HOLDOUT + "," + BAYES + """,
hp AS (SELECT runs.parent_run, metric, variant, checkpoint_day, CASE WHEN error IS NULL THEN floor(mu * 1e6 + 0.5) / 1e6 END AS d FROM cmp JOIN runs USING (run_id))"""


@query("i14_holdout", CHECKS + f""",
en AS (SELECT parent_run, metric, variant, count(*) AS checkpoints, min_by(d, checkpoint_day) AS f, max_by(d, checkpoint_day) AS l FROM hp WHERE d IS NOT NULL GROUP BY ALL)
SELECT parent_run, metric, variant, checkpoints, CASE WHEN f <= 0 THEN 'unclassified' WHEN l / f < 0.5 THEN 'decays' WHEN l / f > 1.25 THEN 'improves' ELSE 'holds' END AS pattern FROM en""")
def i14(spark, d):
    return holdout.classify(_checkpoints(spark, d)).select("parent_run", "metric", "variant", "checkpoints", "pattern")


@query("e8_checkpoint_change", CHECKS + f"""
SELECT parent_run, metric, variant, checkpoint_day::INTEGER AS checkpoint_day, {r('d - lag(d) OVER w', 4)} AS change, {r('first_value(d) OVER w', 4)} AS first_delta
FROM hp WINDOW w AS (PARTITION BY parent_run, metric, variant ORDER BY checkpoint_day)""")
def e8(spark, d):
    t = holdout.trend(_checkpoints(spark, d))
    return t.select("parent_run", "metric", "variant", "checkpoint_day", rnd("change", 4), rnd("first_delta", 4))
