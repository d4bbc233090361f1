import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from liftwise.operators import attribution as at
from liftwise.operators import filters as fl
from liftwise.operators.normalize import metric_specs
from tests.helpers import UTC, runs
from workload import fixtures as fx

EVALS = "env_id string, flag_key string, user_key string, variant string, layer_id string, timestamp timestamp, user_properties string"
EVENTS = "env_id string, event_name string, user_key string, numeric_value double, timestamp timestamp"
START = dt.datetime(2024, 1, 1, tzinfo=UTC)


def made_up(seed, users=40, hot=None, hot_events=0):
    rng = random.Random(seed)

    def when():
        return START + dt.timedelta(seconds=rng.randrange(10 * 86400))

    def who():
        return f"u{rng.randrange(users)}"

    evals = [("e", rng.choice("fg"), who(), rng.choice("ab"), rng.choice([None, "L"]), when(), '{"plan":"%s"}' % rng.choice("xyz"))
             for _ in range(300)]
    evals += [(*e[:3], "a" if e[3] == "b" else "b", *e[4:]) for e in evals[:20]]  # equal instants, other variant
    events = [("e", rng.choice(["buy", "view"]), who(), rng.choice([None, 1.0, 2.5, -3.0]), when()) for _ in range(900)]
    events += [("e", "buy", hot, 1.0, when()) for _ in range(hot_events)]
    if hot:
        evals += [("e", "f", hot, "a", None, START, "{}")]
    return evals, events


RUNS = [
    {"run_id": "r1", "env_id": "e", "flag_key": "f", "observation_start": START, "observation_end": START + dt.timedelta(days=4),
     "primary_metric_event": "buy", "primary_metric_type": "continuous", "primary_metric_agg": "sum", "guardrail_events": '["view"]'},
    {"run_id": "r2", "env_id": "e", "flag_key": "f", "observation_start": START + dt.timedelta(days=2),
     "observation_end": START + dt.timedelta(days=8), "primary_metric_event": "view", "primary_metric_type": "continuous",
     "primary_metric_agg": "average", "guardrail_events": '[{"event":"buy","metricType":"continuous","metricAgg":"count"}]'},
    {"run_id": "r3", "env_id": "e", "flag_key": "g", "observation_start": START, "observation_end": START + dt.timedelta(days=9),
     "primary_metric_event": "buy", "primary_metric_type": "binary", "primary_metric_agg": "sum"},
]
METRICS = {"r1": [("buy", "sum"), ("view", "once")], "r2": [("view", "average"), ("buy", "count")], "r3": [("buy", "once")]}


def expected(evals, events):
    out = {}
    for r in RUNS:
        lo, hi = r["observation_start"].date(), r["observation_end"].date()
        first = {}
        for e in evals:
            if e[1] == r["flag_key"] and lo <= e[5].date() <= hi:
                first[e[2]] = min(first.get(e[2], (e[5], e[3])), (e[5], e[3]))
        for event, agg in METRICS[r["run_id"]]:
            for user, (ts, variant) in first.items():
                values = [x[3] or 0.0 for x in events if x[1] == event and x[2] == user and lo <= x[4].date() <= hi and x[4] >= ts]
                x = 0.0
                if values:
                    x = {"once": 1.0, "count": float(len(values)), "sum": sum(values), "average": sum(values) / len(values)}[agg]
                cell = out.setdefault((r["run_id"], event, variant), [0, 0, 0.0, 0.0])
                cell[0] += 1
                cell[1] += bool(values)
                cell[2] += x
                cell[3] += x * x
    return out


def computed(spark, evals, events, small=True, **kw):
    design_runs = F.broadcast(runs(spark, RUNS)) if small else runs(spark, RUNS)
    design = at.load_design(design_runs, metric_specs(design_runs))
    df = at.variant_stats(spark.createDataFrame(evals, EVALS), spark.createDataFrame(events, EVENTS), design, **kw)
    return df, {(r.run_id, r.metric, r.variant): [r.users, r.conversions, r.sum_val, r.sum_sq] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    evals, events = made_up(seed)
    _, got = computed(spark, evals, events)
    want = expected(evals, events)
    assert set(got) == set(want)
    for key, cell in want.items():
        assert got[key] == pytest.approx(cell), key


def test_large_design_is_joined_by_shuffle(spark):
    """A design too large to broadcast gives the same results."""
    evals, events = made_up(4)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        _, got = computed(spark, evals, events, small=False)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = expected(evals, events)
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_runs_that_share_windows_are_laid_out_by_window(spark):
    """Forty copies of three runs, and one run given twice: the same statistics as run by run, and no row per run and user is shuffled."""
    evals, events = made_up(8)
    copies = [{**r, "run_id": f"{r['run_id']}-{i}"} for r in RUNS for i in range(40)]
    twice = {**RUNS[0], "run_id": "twice", "observation_end": START + dt.timedelta(days=6)}
    table = runs(spark, [*copies, RUNS[0] | {"run_id": "twice"}, twice])
    design = at.load_design(table, metric_specs(table))
    tables = spark.createDataFrame(evals, EVALS), spark.createDataFrame(events, EVENTS)
    df = at.variant_stats(*tables, design)
    columns = ["run_id", "metric_ord", "metric", "metric_agg", "variant", "users", "conversions", "sum_val", "sum_sq"]
    got, by_run = (sorted(map(tuple, d.select(columns).collect())) for d in (df, at.variant_stats(*tables, replace(design, shared=0))))
    assert [r[:7] for r in got] == [r[:7] for r in by_run] and [r[7:] for r in got] == [pytest.approx(r[7:]) for r in by_run]
    cells = {(r[0], r[2], r[4]): list(r[5:]) for r in got if r[0] != "twice"}
    assert cells == {(f"{run}-{i}", *k): pytest.approx(v) for (run, *k), v in expected(evals, events).items() for i in range(40)}
    plain = at.load_design(runs(spark, copies), metric_specs(runs(spark, copies)))
    plan = at.variant_stats(*tables, plain)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert design.shared == 4 and plain.shared == 3 and not any("hashpartitioning(run_id" in line and "user_key" in line for line in plan)


def test_hot_user_is_split(spark):
    """One user with most of the events: the user join is split and stays exact."""
    evals, events = made_up(5, users=4000, hot="bot", hot_events=40000)
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "60KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df, got = computed(spark, evals, events)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan
    want = expected(evals, events)
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_users_add_up(spark):
    evals, events = made_up(6)
    design_runs = runs(spark, RUNS)
    design = at.load_design(design_runs, metric_specs(design_runs))
    e = spark.createDataFrame(evals, EVALS)
    exposures = at.first_exposures(e, design)
    assert exposures.count() == exposures.select("run_id", "user_key").distinct().count()
    sliced = at.segment_stats(e, spark.createDataFrame(events, EVENTS), design, "plan")
    sums = sliced.groupBy("run_id", "metric", "variant", "level").agg(F.sum("users").alias("u"), F.sum("sum_val").alias("s"))
    both = sums.groupBy("run_id", "metric", "variant").pivot("level", ["segment", "total"]).agg(F.first("u").alias("u"), F.first("s").alias("s"))
    for r in both.collect():
        assert r.segment_u == r.total_u and r.segment_s == pytest.approx(r.total_s)


def test_balanced_sampling(spark):
    evals, _ = made_up(7, users=200)
    design_runs = runs(spark, RUNS)
    design = at.load_design(design_runs, metric_specs(design_runs))
    exposures = at.first_exposures(spark.createDataFrame(evals, EVALS), design)
    before = {(r.run_id, r.variant): r["count"] for r in exposures.groupBy("run_id", "variant").count().collect()}
    after = {(r.run_id, r.variant): r["count"] for r in at.balance_exposures(exposures, design).groupBy("run_id", "variant").count().collect()}
    for (run, variant), n in after.items():
        assert n == min(c for (r, _), c in before.items() if r == run)
    assert len(after) == len(before)


FIXTURE = {
    ("env-0", "flag-a", "purchase", "2024-01-05", "2024-01-07"): {
        "v0": (32, 19, 1251.28, 157948.19), "v1": (33, 18, 536.22, 48493.97), "v2": (32, 17, 1563.87, 228655.87)},
    ("env-0", "flag-a", "purchase", "2024-01-03", "2024-01-25"): {
        "v0": (55, 55, 21210.09, 9788189.10), "v1": (48, 48, 17153.54, 7381256.06), "v2": (47, 47, 17656.24, 8153437.25)},
    ("env-1", "flag-b", "1-URGENT", "1996-01-01", "1998-12-31"): {
        "arm-0": (204, 58, 16741022.08, 6987067555369.53), "arm-1": (217, 76, 26911989.72, 12859964112336.97),
        "arm-2": (228, 78, 26108588.91, 11962315438190.04), "arm-3": (236, 79, 23966887.41, 10975998907235.92)},
}


@pytest.mark.parametrize("key", list(FIXTURE))
def test_known_statistics(spark, key):
    env, flag, event, start, end = key
    d = "/root/testdata/sf0.01"
    q = at.query_experiment(fx.evaluations(spark, d), fx.metric_events(spark, d), env_id=env, flag_key=flag, metric_event=event,
                            start=start, end=end, metric_type="continuous", metric_agg="sum")
    got = {r.variant: (r.users, r.conversions, r.sum_val, r.sum_sq) for r in q.collect()}
    assert got == {v: pytest.approx(x, rel=1e-9, abs=0.006) for v, x in FIXTURE[key].items()}


@pytest.mark.parametrize("change,message", [
    ({"flag_key": " "}, "required"), ({"metric_type": "ratio"}, "metric_type"), ({"metric_agg": "last"}, "metric_agg"),
    ({"start": "2024-1-x"}, "YYYY-MM-DD"), ({"end": "2023-01-01"}, "before"),
])
def test_query_arguments_are_checked(change, message):
    args = dict(flag_key="f", metric_event="m", start="2024-01-01", end="2024-01-02", metric_type="binary", metric_agg="once")
    with pytest.raises(ValueError, match=message):
        fl.validate_query(**{**args, **change})


def test_other_environment_is_refused(spark):
    df = spark.createDataFrame([("a",)], "env_id string")
    with pytest.raises(ValueError):
        fl.scan_environment(df, "a", requested_env="b")
    assert fl.scan_environment(df, "a", requested_env="a").count() == 1


def test_audience_rules(spark):
    rows = [('[{"property":"p","op":"eq","value":" x "}]', True, False, False), ('[{"property":"p","op":"neq","value":"x"}]', False, True, True),
            ('[{"property":"p","op":"in","values":["x","z"]}]', True, False, False), ('[{"property":"p","op":"nin","values":["x"]}]', False, True, True),
            ('[{"property":"p","op":"huh","value":"x"}]', True, False, False), ('[{"property":"  "}]', True, True, True), ("broken", True, True, True),
            (None, True, True, True)]
    df = spark.createDataFrame(rows, "f string, x boolean, y boolean, none boolean")
    props = {"x": '{"p":"x"}', "y": '{"p":"y"}', "none": "{}"}
    got = df.select("f", *[fl.in_audience(F.lit(v), fl.audience_rules(F.col("f"))).alias(k) for k, v in props.items()]).collect()
    assert [(r.f, r.x, r.y, r.none) for r in got] == rows


def test_traffic_slice_clamps(spark):
    rows = [(5, 100.0, 50, True), (49, 10.0, 50, False), (50, 10.0, 50, True), (60, 10.0, 50, False), (0, 0.0, -3, True), (1, 0.0, -3, False), (7, None, None, True)]
    df = spark.createDataFrame(rows, "b int, p double, o int, want boolean")
    assert df.where(fl.in_traffic_slice(F.col("b"), F.col("p"), F.col("o")) != F.col("want")).count() == 0
