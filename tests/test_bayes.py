import json

import pytest
from pyspark.sql import functions as F

from liftwise.plans import bayes, decision
from tests.helpers import runs, stats

# control, treatment, inverse, prior -> mu, low, high, win, risk_ctrl, risk_trt
CASES = {
    "rate": ({"n": 5000, "k": 300}, {"n": 5050, "k": 350}, False, False, (0.155116, -0.017192, 0.327423, 0.9612, 0.156487, 0.001372)),
    "prior": ({"n": 5000, "k": 300}, {"n": 5050, "k": 350}, False, True, (0.142848, -0.022506, 0.308202, 0.9548, 0.144417, 0.001569)),
    "sums": ({"n": 5000, "sum": 45000, "sum_squares": 820000}, {"n": 5050, "sum": 48020, "sum_squares": 901000}, False, False,
             (0.056546, 0.015247, 0.097844, 0.9964, 0.056569, 0.000024)),
    "inverse": ({"n": 5000, "k": 90}, {"n": 5050, "k": 70}, True, False, (-0.229923, -0.468562, 0.008716, 0.9705, 0.231310, 0.001387)),
    "arm-a": ({"n": 3300, "k": 198}, {"n": 3350, "k": 228}, False, False, (0.134328, -0.074644, 0.343301, 0.8961, 0.139612, 0.005283)),
    "arm-b": ({"n": 3300, "k": 198}, {"n": 3300, "k": 215}, False, False, (0.085859, -0.117114, 0.288831, 0.7965, 0.097682, 0.011823)),
    "seed": ({"n": 612, "k": 110}, {"n": 588, "k": 148}, False, False, (0.400371, 0.093347, 0.707395, 0.9947, 0.400635, 0.000264)),
    "means": ({"n": 612, "mean": 247.3, "variance": 7992.36}, {"n": 588, "mean": 251.8, "variance": 8317.44}, False, False,
              (0.018197, -0.023504, 0.059897, 0.8038, 0.020514, 0.002318)),
    "small": ({"n": 243, "k": 51}, {"n": 247, "k": 67}, False, False, (0.292451, -0.118900, 0.703801, 0.9183, 0.300258, 0.007808)),
    "latency": ({"n": 12340, "mean": 1499.19, "variance": 412.50**2}, {"n": 12198, "mean": 1438.76, "variance": 388.91**2}, True, False,
                (-0.040308, -0.046858, -0.033759, 1.0, 0.040308, 0.0)),
}


@pytest.fixture(scope="module")
def compared(spark):
    rows, designs = [], []
    for name, (control, treatment, inverse, prior, _) in CASES.items():
        rows += [(name, 0, "m", "primary", inverse, "c", control), (name, 0, "m", "primary", inverse, "t", treatment)]
        designs.append({"run_id": name, "control_variant": "c", "treatment_variant": "t", "prior_proper": prior})
    return bayes.compare(stats(spark, rows), runs(spark, designs)).cache()


def test_known_comparisons(compared):
    got = {r.run_id: r for r in bayes.comparisons(compared).collect()}
    assert set(got) == set(CASES)
    for name, (*_, want) in CASES.items():
        r = got[name]
        values = (r.relative_change, r.ci_lower, r.ci_upper, r.chance_to_win, r.risk_ctrl, r.risk_trt)
        for value, expected, tolerance in zip(values, want, (1e-6, 2e-6, 2e-6, 6e-5, 2e-6, 2e-6)):
            assert value == pytest.approx(expected, abs=tolerance), name
        assert r.error is None and r.prior_applied == CASES[name][3]
        sign = -1 if CASES[name][2] else 1
        assert r.risk_ctrl - r.risk_trt == pytest.approx(sign * r.relative_change, abs=1e-6)


def test_comparison_errors(spark):
    cases = {
        "empty": ({"n": 0, "k": 0}, {"n": 10, "k": 5}, bayes.ERROR_NO_USERS),
        "zero": ({"n": 10, "k": 0}, {"n": 10, "k": 5}, bayes.ERROR_ZERO_MEAN),
        "flat": ({"n": 10, "k": 10}, {"n": 10, "k": 10}, bayes.ERROR_ZERO_SE),
    }
    rows = [(name, 0, "m", "primary", False, v, x) for name, (c, t, _) in cases.items() for v, x in (("c", c), ("t", t))]
    designs = [{"run_id": n, "control_variant": "c", "treatment_variant": "t"} for n in cases]
    got = bayes.section_rows(bayes.compare(stats(spark, rows), runs(spark, designs))).where("arm_idx = 1").collect()
    for r in got:
        assert r.error == cases[r.run_id][2]
        assert r.rel_delta is None and r.p_win is None and r.rate is not None


@pytest.mark.parametrize("counts,p", [
    ((5000, 5050), 0.6180), ((5000, 4750), 0.0113), ((3300, 3350, 3300), 0.7778), ((612, 588), 0.4884),
    ((387, 371, 342), 0.2419), ((212, 287, 181), 0.0), ((0, 0), 1.0), ((10,), 1.0),
])
def test_sample_ratio(spark, counts, p):
    df = spark.createDataFrame([("r", c) for c in counts], "run_id string, observed long")
    r = bayes.srm_p_value(df, ["run_id"]).first()
    assert r.p == pytest.approx(p, abs=5e-5)
    assert r.ok == (p >= 0.01)


def test_sample_ratio_with_weights(spark):
    df = spark.createDataFrame([("r", 900, 9.0), ("r", 100, 1.0)], "run_id string, observed long, w double")
    assert bayes.srm_p_value(df, ["run_id"], weight="w").first().p == pytest.approx(1.0, abs=1e-6)


def test_inverse_twice_is_identity(spark):
    a, b = {"n": 500, "k": 40}, {"n": 510, "k": 55}
    rows = [("x", 0, "m", "primary", i, v, s) for i in (False,) for v, s in (("c", a), ("t", b))]
    rows += [("y", 0, "m", "primary", True, v, s) for v, s in (("c", a), ("t", b))]
    designs = [{"run_id": n, "control_variant": "c", "treatment_variant": "t"} for n in "xy"]
    got = {r.run_id: r for r in bayes.comparisons(bayes.compare(stats(spark, rows), runs(spark, designs))).collect()}
    assert got["x"].chance_to_win == pytest.approx(1 - got["y"].chance_to_win)
    assert (got["x"].risk_ctrl, got["x"].risk_trt) == (got["y"].risk_trt, got["y"].risk_ctrl)


def document(spark):
    g = json.dumps([{"event": "bounce", "metricType": "binary", "direction": "increase_bad"}, "absent"])
    designs = runs(spark, [{
        "run_id": "r", "slug": "s", "control_variant": "c", "treatment_variant": "t,u", "guardrail_events": g,
        "primary_metric_event": "buy", "minimum_sample": 400, "prior_proper": True,
    }])
    rows = stats(spark, [
        ("r", 0, "buy", "primary", False, "c", {"n": 500, "k": 40}), ("r", 0, "buy", "primary", False, "t", {"n": 510, "k": 80}),
        ("r", 0, "buy", "primary", False, "u", {"n": 0, "k": 0}), ("r", 0, "buy", "primary", False, "stranger", {"n": 5, "k": 1}),
        ("r", 1, "bounce", "guardrail", True, "c", {"n": 500, "k": 100}), ("r", 1, "bounce", "guardrail", True, "t", {"n": 510, "k": 180}),
    ])
    c = bayes.compare(rows, designs)
    return c, designs


def test_result_document(spark):
    c, designs = document(spark)
    doc = json.loads(bayes.bayesian_results(c, designs, "now").first().analysis_result)
    assert doc["type"] == "bayesian" and doc["experiment"] == "s" and doc["treatments"] == ["t", "u"]
    assert doc["prior"] == "Gaussian(μ=0, σ=0.3)"
    assert doc["srm"]["observed"] == {"c": 500, "t": 510, "u": 0} and not doc["srm"]["ok"]
    assert doc["sample_check"] == {"minimum_per_variant": 400, "ok": False, "variants": {"c": 500, "t": 510, "u": 0}}
    primary = doc["primary_metric"]
    assert [r["variant"] for r in primary["rows"]] == ["c", "t", "u"]
    assert primary["metric_type"] == "proportion" and "inverse" not in primary
    assert primary["verdict"] == "t: strong signal → adopt treatment"
    assert set(primary["rows"][2]) == {"variant", "n", "is_control", "conversions", "rate"}
    (guard,) = doc["guardrails"]
    assert guard["event"] == "bounce" and guard["inverse"] and guard["verdict"] == "t: guardrail ALARM — possible regression"
    assert guard["rows"][1]["p_harm"] > 0.99 and "p_win" not in guard["rows"][1]


def test_decision_needs_a_sound_split(spark):
    c, designs = document(spark)
    got = decision.decisions(bayes.comparisons(c), bayes.run_health(c, designs)).collect()
    assert {(r.variant, r.category, r.gate_passed) for r in got} == {("t", "PAUSE", False), ("u", "PAUSE", False)}


@pytest.mark.parametrize("p,risk,guard,want", [
    (0.97, 0.001, None, "CONTINUE"), (0.97, 0.001, 0.5, "CONTINUE"), (0.97, 0.015, 0.5, "PAUSE"), (0.97, 0.001, 0.15, "PAUSE"),
    (0.97, 0.001, 0.04, "ROLLBACK"), (0.85, 0.001, 0.5, "PAUSE"), (0.5, 0.001, 0.5, "INCONCLUSIVE"), (0.1, 0.001, 0.5, "INCONCLUSIVE"),
    (0.03, 0.001, 0.5, "ROLLBACK"), (0.97, 0.05, 0.5, "INCONCLUSIVE"),
])
def test_decision_rules(spark, p, risk, guard, want):
    rows = [("r", 1, "t", "primary", p, 0.05, risk)] + ([("r", 1, "t", "guardrail", guard, 0.0, 0.0)] if guard is not None else [])
    c = spark.createDataFrame(rows, "run_id string, arm_idx int, variant string, role string, chance_to_win double, risk_ctrl double, risk_trt double")
    h = spark.createDataFrame([("r", True, True)], "run_id string, srm_ok boolean, sample_ok boolean")
    assert decision.decisions(c, h).first().category == want


def test_density_curve(spark, compared):
    curve = bayes.density_curve(bayes.section_rows(compared)).where("run_id = 'rate'")
    row = curve.agg(F.count("*").alias("n"), F.count_if("in_interval").alias("inside"), F.max("density").alias("top")).first()
    assert row.n == 81 and 40 < row.inside < 50
    assert row.top == pytest.approx(0.398942 / ((0.327423 + 0.017192) / 3.92), rel=1e-4)
