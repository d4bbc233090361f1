"""Analysis queries (C5-C7, C10, E2, E6-E8, I)."""

from pyspark.sql import functions as F

from liftwise.functions.distributions import (
    chi2_sf, erf, normal_cdf, normal_pdf, normal_quantile, normal_sf, truncated_normal_mean,
)
from liftwise.functions.moments import arm_posterior, effect_se, expected_losses
from liftwise.functions.random import standard_normal, uniform
from liftwise.functions.rounding import round_half_up
from liftwise.operators import attribution as at
from liftwise.operators import variants
from liftwise.plans import analyze, bandit, bayes, decision, holdout
from liftwise.session import materialize
from workload import fixtures as fx
from workload.attribution_queries import MOMENTS
from workload.catalog import query, r, rnd
from workload.source_queries import live_stats

W = "WITH " + fx.CTE
NOW = "2024-02-01T00:00:00Z"


def macro_erf(x):
    """A&S 7.1.26 written out for the comparison engine."""
    t = f"(1.0 / (1.0 + 0.3275911 * abs({x})))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"((CASE WHEN {x} >= 0 THEN 1 ELSE -1 END) * (1.0 - {poly} * exp(-({x}) * ({x}))))"


def sql_cdf(z):
    return f"(0.5 * (1.0 + {macro_erf(f'(({z}) / sqrt(2.0::DOUBLE))')}))"


def sql_pdf(z):
    return f"(exp(-0.5 * ({z}) * ({z})) / sqrt(2 * pi()))"


# Comparison of each treatment with its control, from the moments view.
BAYES = MOMENTS + f""",
pairs AS (SELECT c.run_id, c.metric_ord, c.metric, c.role, c.metric_type, c.inverse, a.idx AS arm_idx, t.variant, a.nk,
  c.m_mean AS ma, c.m_var AS va, c.users AS na, t.m_mean AS mb, t.m_var AS vb, t.users AS nb, t.conversions AS kb,
  (rr.prior_proper AND c.role <> 'guardrail') AS pp
  FROM mo t JOIN arms a ON a.run_id = t.run_id AND a.arm = t.variant AND a.idx > 0
  JOIN arms a0 ON a0.run_id = t.run_id AND a0.idx = 0
  JOIN mo c ON c.run_id = t.run_id AND c.metric_ord = t.metric_ord AND c.variant = a0.arm
  JOIN runs rr ON rr.run_id = t.run_id),
e1 AS (SELECT *, CASE WHEN ma = 0 THEN 0 ELSE sqrt(vb / (nb * ma ** 2) + va * mb ** 2 / (na * ma ** 4)) END AS se FROM pairs),
e2 AS (SELECT *, CASE WHEN na = 0 OR nb = 0 THEN 'zero sample size'
   WHEN ma = 0 THEN 'control mean is zero — cannot compute relative effect'
   WHEN se = 0 THEN 'zero standard error (no variance in data)' END AS error FROM e1),
e3 AS (SELECT *, CASE WHEN error IS NULL THEN (mb - ma) / ma END AS d, CASE WHEN error IS NULL THEN se END AS s FROM e2),
e4 AS (SELECT *, CASE WHEN pp THEN (d / s ** 2) / (1 / s ** 2 + 1 / 0.09) ELSE d END AS mu,
   CASE WHEN pp THEN sqrt(1 / (1 / s ** 2 + 1 / 0.09)) ELSE s END AS sd FROM e3),
e5 AS (SELECT *, {sql_cdf('mu / sd')} AS up, {sql_pdf('mu / sd')} AS ph FROM e4),
cmp AS (SELECT *, CASE WHEN inverse THEN 1 - up ELSE up END AS win, mu - 1.959963986120195 * sd AS lo, mu + 1.959963986120195 * sd AS hi,
   CASE WHEN inverse THEN sd * ph - mu * (1 - up) ELSE mu * up + sd * ph END AS risk_ctrl,
   CASE WHEN inverse THEN mu * up + sd * ph ELSE sd * ph - mu * (1 - up) END AS risk_trt FROM e5)"""

# Sample-ratio test from the primary metric's users; 3 arms have 2 degrees of
# freedom, 4 arms have 3.
SRM = f""",
srm0 AS (SELECT vs.run_id, count(*) AS arms, sum(users) AS total, min(users) AS smallest,
   sum((users - tot / k) ** 2 / (tot / k)) AS chi2
  FROM vs JOIN (SELECT run_id, sum(users) AS tot, count(*) AS k FROM vs WHERE metric_ord = 0 GROUP BY 1) t USING (run_id)
  WHERE metric_ord = 0 GROUP BY 1),
srm AS (SELECT *, CASE arms WHEN 3 THEN exp(-chi2 / 2)
   WHEN 4 THEN 1 - {macro_erf('sqrt(chi2 / 2)')} + sqrt(2 * chi2 / pi()) * exp(-chi2 / 2) END AS p FROM srm0)"""


def compared(spark, d):
    return bayes.compare(live_stats(spark, d), fx.runs(spark, d))


def health(spark, d):
    return bayes.run_health(compared(spark, d), fx.runs(spark, d))


@query("h1_h4_normal_functions", f"""
WITH p AS (SELECT event_id, value, (event_id % 801 - 400) / 100.0::DOUBLE AS x FROM events)
SELECT event_id, {r(macro_erf('x'), 7)} AS erf, {r(sql_pdf('(x - 0.5) / 2.0') + ' / 2.0', 7)} AS pdf,
 {r(sql_cdf('(x - 0.5) / 2.0'), 7)} AS cdf, {r('1 - ' + sql_cdf('(x - 0.5) / 2.0'), 7)} AS sf,
 {r('x + 1.5 * ' + sql_pdf('-x / 1.5') + ' / (1 - ' + sql_cdf('-x / 1.5') + ')', 5)} AS trunc_pos FROM p""")
def h1(spark, d):
    x = ((F.col("event_id") % 801 - 400) / F.lit(100.0)).alias("x")
    p = fx.raw_events(spark, d).select("event_id", x)
    return p.select(
        "event_id", rnd(erf(F.col("x")), 7, "erf"), rnd(normal_pdf(F.col("x"), 0.5, 2.0), 7, "pdf"),
        rnd(normal_cdf(F.col("x"), 0.5, 2.0), 7, "cdf"), rnd(normal_sf(F.col("x"), 0.5, 2.0), 7, "sf"),
        rnd(truncated_normal_mean(F.col("x"), 1.5, F.lit(0.0), None), 5, "trunc_pos"),
    )


@query("h3_normal_quantile", f"""
WITH p AS (SELECT event_id, 0.025 + (event_id % 951) / 1000.0::DOUBLE AS p FROM events),
q AS (SELECT *, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS s FROM p)
SELECT event_id, {r('''CASE WHEN p = 0.5 THEN 0 ELSE
 (((((-39.69683028665376 * s + 220.9460984245205) * s - 275.9285104469687) * s + 138.3577518672690) * s - 30.66479806614716) * s + 2.506628277459239) * q
 / (((((-54.47609879822406 * s + 161.5858368580409) * s - 155.6989798598866) * s + 66.80131188771972) * s - 13.28068155288572) * s + 1) END''', 7)} AS z FROM q""")
def h3(spark, d):
    p = F.lit(0.025) + (F.col("event_id") % 951) / F.lit(1000.0)
    return fx.raw_events(spark, d).select("event_id", p.alias("p")).select("event_id", rnd(normal_quantile(F.col("p")), 7, "z"))


@query("h5_chi2_survival", f"""
WITH p AS (SELECT o_orderkey AS id, (o_orderkey % 400) / 10.0::DOUBLE AS x, o_orderkey % 3 AS m FROM orders)
SELECT id, 2 * (m + 1) AS df, {r('''CASE m WHEN 0 THEN exp(-x / 2) WHEN 1 THEN exp(-x / 2) * (1 + x / 2)
 ELSE exp(-x / 2) * (1 + x / 2 + x * x / 8) END''', 6)} AS p FROM p""")
def h5(spark, d):
    o = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 400) / F.lit(10.0)).alias("x"),
        ((F.col("o_orderkey") % 3 + 1) * 2).alias("df"),
    )
    return o.select("id", "df", rnd(chi2_sf(F.col("x"), F.col("df")), 6, "p"))


@query("h6_effect_se", W + "," + BAYES + f"""
SELECT run_id, metric, variant, {r('se', 6)} AS se_rel, {r('sqrt(vb / nb + va / na)', 4)} AS se_abs FROM e1""")
def h6(spark, d):
    c = bayes.comparisons(compared(spark, d))
    six = [F.col(x) for x in ("a_mean", "a_var", "a_n", "b_mean", "b_var", "b_n")]
    return c.select(
        "run_id", "metric", "variant", rnd(effect_se(*six, relative=True), 6, "se_rel"), rnd(effect_se(*six, relative=False), 4, "se_abs")
    )


@query("h7_expected_losses", f"""
WITH p AS (SELECT event_id, (value - 50) / 100.0 AS mu, 0.05 + (event_id % 20) / 100.0::DOUBLE AS s FROM events)
SELECT event_id, {r('mu * ' + sql_cdf('mu / s') + ' + s * ' + sql_pdf('mu / s'), 6)} AS risk_ctrl,
 {r('s * ' + sql_pdf('mu / s') + ' - mu * ' + sql_cdf('-mu / s'), 6)} AS risk_trt FROM p""")
def h7(spark, d):
    p = fx.raw_events(spark, d).select(
        "event_id", ((F.col("value") - 50) / 100).alias("mu"), (F.lit(0.05) + (F.col("event_id") % 20) / F.lit(100.0)).alias("s")
    )
    gain, loss = expected_losses(F.col("mu"), F.col("s"))
    return p.select("event_id", rnd(gain, 6, "risk_ctrl"), rnd(loss, 6, "risk_trt"))


@query("h8_round_half_up", "SELECT event_id, floor((value - 50) * 10 + 0.5) / 10 AS v FROM events")
def h8(spark, d):
    return fx.raw_events(spark, d).select("event_id", round_half_up(F.col("value") - 50, 1).alias("v"))


def sql_random(source, seed, keys):
    """Subqueries that carry one uniform number per k in ``keys`` through the generator's steps."""
    steps = source
    for name, k in keys.items():
        steps = f"(SELECT *, ((({seed}) + ({k}) * 1831565813::HUGEINT) % 4294967296)::BIGINT AS t_{name} FROM {steps})"
        steps = f"(SELECT *, ((xor(t_{name}, t_{name} >> 15)::HUGEINT * (t_{name} | 1)) % 4294967296)::BIGINT AS x_{name} FROM {steps})"
        steps = f"(SELECT *, ((xor(x_{name}, x_{name} >> 7)::HUGEINT * (x_{name} | 61)) % 4294967296)::BIGINT AS y_{name} FROM {steps})"
        steps = f"(SELECT *, xor(x_{name}, (x_{name} + y_{name}) % 4294967296) AS z_{name} FROM {steps})"
        steps = f"(SELECT *, xor(z_{name}, z_{name} >> 14) / 4294967296.0::DOUBLE AS {name} FROM {steps})"
    return steps


@query("h9_h10_random_numbers", f"""
SELECT event_id, {r('u1', 9)} AS u1, {r('sqrt(-2 * ln(greatest(u1, 1e-12))) * cos(2 * pi() * u2)', 8)} AS z
FROM {sql_random('events', 'event_id * 7919', {'u1': 'user_id * 2 + 1', 'u2': 'user_id * 2 + 2'})}""")
def h9(spark, d):
    seed, k = F.col("event_id") * 7919, F.col("user_id") * 2
    e = fx.raw_events(spark, d).select("event_id", uniform(seed, k + 1).alias("u1"), uniform(seed, k + 2).alias("u2"))
    return e.select("event_id", rnd("u1", 9), rnd(standard_normal(F.col("u1"), F.col("u2")), 8, "z"))


POSTERIOR = """
 CASE WHEN m_n = 0 OR v = 0 THEN 0 WHEN NOT prior_proper THEN m ELSE (m * m_n / v) / (m_n / v + 1 / 0.09) END AS mu,
 CASE WHEN m_n = 0 OR v = 0 THEN 0.09 WHEN NOT prior_proper THEN v / m_n ELSE 1 / (m_n / v + 1 / 0.09) END AS var"""


@query("h11_arm_posterior", W + "," + MOMENTS + f"""
, post AS (SELECT mo.run_id, metric, variant, {POSTERIOR} FROM (SELECT *, users AS m_n, m_mean AS m, m_var AS v FROM mo) mo JOIN runs USING (run_id))
SELECT run_id, metric, variant, {r('mu', 4)} AS mu, {r('CASE WHEN var > 1e6 THEN var / 1e6 ELSE var END', 5)} AS var_scaled FROM post""")
def h11(spark, d):
    from liftwise.functions.moments import moments

    s = live_stats(spark, d)
    m = moments(*[F.col(c) for c in ("n", "k", "sum", "sum_squares", "mean", "variance")])
    joined = s.withColumns(m).join(fx.runs(spark, d).select("run_id", "prior_proper", "prior_mean", "prior_stddev"), "run_id")
    mu, var = arm_posterior(*[F.col(c) for c in ("m_mean", "m_var", "m_n", "prior_proper", "prior_mean", "prior_stddev")])
    return joined.select("run_id", "metric", "variant", mu.alias("mu"), var.alias("var")).select(
        "run_id", "metric", "variant", rnd("mu", 4),
        rnd(F.when(F.col("var") > 1e6, F.col("var") / 1e6).otherwise(F.col("var")), 5, "var_scaled"),
    )


@query("c5_treatment_pairs", W + "," + BAYES + " SELECT run_id, metric, arm_idx, variant, na::BIGINT AS a_n, nb::BIGINT AS b_n FROM pairs")
def c5(spark, d):
    return bayes.comparisons(compared(spark, d)).select(
        "run_id", "metric", F.col("arm_idx"), "variant", "a_n", "b_n"
    )


@query("i1_bayesian_comparison", W + "," + BAYES + f"""
SELECT run_id, metric, variant, error, {r('win', 6)} AS chance_to_win, {r('mu', 6)} AS relative_change,
 CASE WHEN error IS NULL THEN {r('mb - ma', 3)} END AS absolute_change, {r('lo', 6)} AS ci_lower, {r('hi', 6)} AS ci_upper,
 {r('risk_ctrl', 6)} AS risk_ctrl, {r('risk_trt', 6)} AS risk_trt, CASE WHEN error IS NULL THEN pp END AS prior_applied FROM cmp""")
def i1(spark, d):
    c = bayes.comparisons(compared(spark, d))
    return c.select(
        "run_id", "metric", "variant", "error", rnd("chance_to_win", 6), rnd("relative_change", 6), rnd("absolute_change", 3),
        rnd("ci_lower", 6), rnd("ci_upper", 6), rnd("risk_ctrl", 6), rnd("risk_trt", 6), "prior_applied",
    )


SECTIONS = BAYES + """,
sec AS (SELECT run_id, metric_ord, metric, role, inverse, arm_idx, variant, nk, nb AS n, metric_type, kb, mb, error, mu, lo, hi, win, risk_ctrl, risk_trt FROM cmp
 UNION ALL SELECT mo.run_id, metric_ord, metric, role, inverse, 0, variant, a.nk, users, metric_type, conversions, m_mean, NULL, NULL, NULL, NULL, NULL, NULL, NULL
 FROM mo JOIN arms a ON a.run_id = mo.run_id AND a.arm = mo.variant AND a.idx = 0)"""


def sql_half_up(x, digits):
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


@query("i2_metric_sections", W + "," + SECTIONS + f"""
SELECT run_id, metric, variant, arm_idx = 0 AS is_control, n::BIGINT AS n,
 CASE WHEN metric_type = 'binary' THEN kb::BIGINT END AS conversions, CASE WHEN metric_type = 'binary' THEN {sql_half_up('mb', 6)} END AS rate,
 CASE WHEN metric_type <> 'binary' THEN {r(sql_half_up('mb', 4), 3)} END AS mean, {r(sql_half_up('mu', 6), 5)} AS rel_delta,
 CASE WHEN role <> 'guardrail' THEN {sql_half_up('win', 4)} END AS p_win, CASE WHEN role = 'guardrail' THEN {sql_half_up('1 - win', 4)} END AS p_harm,
 {r(sql_half_up('risk_ctrl', 6), 5)} AS risk_ctrl, {r(sql_half_up('risk_trt', 6), 5)} AS risk_trt FROM sec""")
def i2(spark, d):
    s = bayes.section_rows(compared(spark, d))
    return s.select(
        "run_id", "metric", "variant", "is_control", "n", "conversions", "rate", rnd("mean", 3), rnd("rel_delta", 5),
        rnd("p_win", 4), rnd("p_harm", 4), rnd("risk_ctrl", 5), rnd("risk_trt", 5),
    )


VERDICT = """variant || ': ' || CASE WHEN role = 'guardrail' THEN CASE WHEN 1 - win < 0.1 THEN 'guardrail healthy'
 WHEN 1 - win < 0.3 THEN 'guardrail borderline — monitor' ELSE 'guardrail ALARM — possible regression' END
 ELSE CASE WHEN win >= 0.95 THEN 'strong signal → adopt treatment' WHEN win >= 0.8 THEN 'leaning treatment'
 WHEN win <= 0.05 THEN 'treatment appears harmful' WHEN win <= 0.2 THEN 'leaning control' ELSE 'inconclusive' END END"""


@query("i3_verdicts", W + "," + BAYES + f"""
SELECT run_id, metric, role, coalesce(string_agg({VERDICT}, '; ' ORDER BY arm_idx) FILTER (error IS NULL), 'no data') AS verdict
FROM cmp GROUP BY ALL""")
def i3(spark, d):
    return bayes.section_verdicts(bayes.section_rows(compared(spark, d))).select("run_id", "metric", "role", "verdict")


@query("i4_sample_ratio", W + SRM + f" SELECT run_id, arms, total::BIGINT AS total, {r('chi2', 5)} AS chi2, {r('p', 5)} AS p, p >= 0.01 AS ok FROM srm")
def i4(spark, d):
    s = live_stats(spark, d).where(F.col("metric_ord") == 0)
    return bayes.srm_p_value(s, ["run_id"], "n").select("run_id", "arms", "total", rnd("chi2", 5), rnd("p", 5), "ok")


@query("i10_sample_check", W + SRM + """
SELECT run_id, minimum_sample, smallest, minimum_sample = 0 OR smallest >= minimum_sample AS sample_ok FROM srm JOIN runs USING (run_id)""")
def i10(spark, d):
    return health(spark, d).select("run_id", "minimum_sample", "smallest", "sample_ok")


def _bandit(spark, d):
    runs = fx.runs(spark, d).withColumn("method", F.lit("bandit"))
    arms = materialize(bandit.bandit_arms(live_stats(spark, d), runs), "arms")
    return arms.withColumn("seed", F.substring("run_id", 5, 2).cast("bigint") * 101 + 7)


BANDIT = MOMENTS + f""",
ba AS (SELECT a.run_id, a.nk, a.idx AS arm_idx, a.arm, coalesce(mo.users, 0) AS m_n, coalesce(mo.m_mean, 0) AS m, coalesce(mo.m_var, 0) AS v,
  rr.prior_proper FROM arms a JOIN runs rr ON rr.run_id = a.run_id LEFT JOIN mo ON mo.run_id = a.run_id AND mo.variant = a.arm AND mo.metric_ord = 0),
bp AS (SELECT ba.*, {POSTERIOR}, min(m_n) OVER (PARTITION BY run_id) AS smallest, count(*) OVER (PARTITION BY run_id) AS arms FROM ba),
src AS (SELECT bp.run_id, bp.arm_idx, mu, var, nk * 101 + 7 AS seed, d.draw, (d.draw * arms + arm_idx) * 2 AS k0
  FROM bp, (SELECT unnest(range(10000)) AS draw) d WHERE smallest >= 100),
samples AS (SELECT run_id, draw, arm_idx, mu + sqrt(greatest(var, 1e-12)) * sqrt(-2 * ln(greatest(u1, 1e-12))) * cos(2 * pi() * u2) AS value
  FROM {sql_random('src', 'seed', {'u1': 'k0 + 1', 'u2': 'k0 + 2'})}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, draw ORDER BY value DESC, arm_idx) AS rk FROM samples),
cnt AS (SELECT run_id, arm_idx, count(*) FILTER (rk = 1) AS firsts, count(*) AS tops FROM ranked WHERE rk <= 2 GROUP BY ALL),
w0 AS (SELECT bp.*, smallest >= 100 AS enough, CASE WHEN smallest >= 100 THEN coalesce(firsts, 0) / 10000.0 END AS p_best,
  CASE WHEN smallest >= 100 THEN greatest(coalesce(tops, 0) / 20000.0, 0.01) END AS w FROM bp LEFT JOIN cnt USING (run_id, arm_idx)),
bw AS (SELECT *, w / sum(w) OVER (PARTITION BY run_id) AS weight FROM w0),
best AS (SELECT DISTINCT ON (run_id) run_id, arm AS best_arm, coalesce(p_best, 0) AS p_best, enough, smallest FROM bw ORDER BY run_id, coalesce(p_best, 0) DESC, arm_idx)"""


@query("i5_bandit_weights", W + "," + BANDIT + f"""
SELECT run_id, arm, enough AS enough_units, CASE WHEN enough THEN 'successfully updated'
 ELSE 'burn-in: need >= 100 users per arm before dynamic weighting (current minimum: ' || smallest || ')' END AS update_message,
 {r('p_best', 4)} AS p_best, {r('weight', 6)} AS weight FROM bw""")
def i5(spark, d):
    w = bandit.bandit_weights(_bandit(spark, d))
    return w.select("run_id", "arm", "enough_units", "update_message", rnd("p_best", 4), rnd("weight", 6))


# One draw per order, one arm per line: a sample matrix made of order lines.
SAMPLES = """
sm AS (SELECT 'all' AS run_id, l_orderkey AS draw, l_linenumber - 1 AS arm_idx, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY run_id, draw ORDER BY value DESC, arm_idx) AS rank FROM sm)"""


def _samples(spark, d):
    li = fx.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("draw"), (F.col("l_linenumber") - 1).alias("arm_idx")).agg(
        F.max("l_extendedprice").alias("value")
    ).select(F.lit("all").alias("run_id"), "draw", "arm_idx", "value", F.lit(False).alias("inverse"))


@query("e2_rank_arms", "WITH " + SAMPLES + " SELECT draw, arm_idx, CAST(rank AS INTEGER) AS rank FROM rk")
def e2(spark, d):
    return bandit.rank_draws(_samples(spark, d)).select("draw", "arm_idx", "rank")


@query("i6_weights_from_samples", "WITH " + SAMPLES + f""",
c AS (SELECT arm_idx, count(*) FILTER (rank = 1) AS f, count(*) FILTER (rank <= 2) AS t FROM rk GROUP BY 1),
w AS (SELECT arm_idx, f / sum(f) OVER () AS p_best, greatest(t / sum(t) OVER (), 0.01) AS w FROM c)
SELECT arm_idx, {r('p_best', 6)} AS p_best, {r('w / sum(w) OVER ()', 6)} AS weight FROM w""")
def i6(spark, d):
    return bandit.weights_from_samples(_samples(spark, d)).select("arm_idx", rnd("p_best", 6), rnd("weight", 6))


@query("e6_rollout_ranges", W + "," + BANDIT + f"""
SELECT run_id, arm, {r('sum(weight) OVER (PARTITION BY run_id ORDER BY arm_idx ROWS UNBOUNDED PRECEDING) - weight', 5)} AS range_start,
 {r('sum(weight) OVER (PARTITION BY run_id ORDER BY arm_idx ROWS UNBOUNDED PRECEDING)', 5)} AS range_end FROM bw WHERE enough""")
def e6(spark, d):
    w = bandit.bandit_weights(_bandit(spark, d)).where(F.col("enough_units"))
    return bandit.rollout_ranges(w).select("run_id", "arm", rnd("range_start", 5), rnd("range_end", 5))


@query("e7_best_arm", W + "," + BANDIT + f" SELECT run_id, best_arm, {r('p_best', 4)} AS p_best FROM best")
def e7(spark, d):
    return bandit.best_arms(bandit.bandit_weights(_bandit(spark, d))).select("run_id", "best_arm", rnd("p_best", 4))


@query("i7_stopping_rule", W + "," + BANDIT + """
SELECT run_id, enough AND p_best >= 0.95 AS met, CASE WHEN enough AND p_best >= 0.95 THEN best_arm || ' reached P(best)=' || printf('%.4f', p_best) || ' >= 0.95'
 WHEN enough THEN 'best arm ' || best_arm || ' currently at P(best)=' || printf('%.4f', p_best) || ', threshold=0.95'
 ELSE 'burn-in: need >= 100 users per arm before dynamic weighting (current minimum: ' || smallest || ')' END AS message FROM best""")
def i7(spark, d):
    s = bandit.stopping(bandit.best_arms(bandit.bandit_weights(_bandit(spark, d))))
    return s.select("run_id", "met", "message")


@query("i8_bandit_result", W + "," + BANDIT + SRM + f"""
SELECT bw.run_id, 'bandit' AS type, arm, m_n::BIGINT AS n, {r('coalesce(weight, 0)', 5)} AS weight, {r('srm.p', 3)} AS srm_p, best_arm
FROM bw JOIN srm USING (run_id) JOIN best USING (run_id)""")
def i8(spark, d):
    j = bandit.bandit_results(bandit.bandit_weights(_bandit(spark, d)), NOW)
    schema = ("struct<type:string,arms:array<struct<arm:string,n:bigint>>,srm:struct<chi2_p_value:double>,"
              "stopping:struct<best_arm:string>,thompson_sampling:struct<results:array<struct<arm:string,recommended_weight:double>>>>")
    doc = j.select("run_id", F.from_json("analysis_result", schema).alias("r"))
    both = F.arrays_zip(F.col("r.arms").alias("a"), F.col("r.thompson_sampling.results").alias("t"))
    return doc.select("run_id", "r", F.explode(both).alias("z")).select(
        "run_id", F.col("r.type").alias("type"), F.col("z.a.arm").alias("arm"), F.col("z.a.n").alias("n"),
        rnd(F.col("z.t.recommended_weight"), 5, "weight"), rnd(F.col("r.srm.chi2_p_value"), 3, "srm_p"),
        F.col("r.stopping.best_arm").alias("best_arm"),
    )


@query("i9_bayesian_result", W + "," + BAYES + SRM + f"""
, v AS (SELECT run_id, metric_ord, coalesce(string_agg({VERDICT}, '; ' ORDER BY arm_idx) FILTER (error IS NULL), 'no data') AS verdict FROM cmp GROUP BY ALL)
SELECT runs.run_id, slug AS experiment, CASE WHEN prior_proper THEN 'Gaussian(μ=0, σ=0.3)' ELSE 'flat (improper)' END AS prior,
 {r('srm.p', 3)} AS srm_p, p >= 0.01 AS srm_ok, minimum_sample = 0 OR smallest >= minimum_sample AS sample_ok,
 (SELECT verdict FROM v WHERE v.run_id = runs.run_id AND metric_ord = 0) AS primary_verdict,
 (SELECT string_agg(verdict, ' / ' ORDER BY metric_ord) FROM v WHERE v.run_id = runs.run_id AND metric_ord > 0) AS guardrail_verdicts
FROM runs JOIN srm USING (run_id)""")
def i9(spark, d):
    runs = fx.runs(spark, d)
    j = bayes.bayesian_results(compared(spark, d), runs, NOW)
    schema = ("struct<experiment:string,prior:string,srm:struct<chi2_p_value:double,ok:boolean>,sample_check:struct<ok:boolean>,"
              "primary_metric:struct<verdict:string>,guardrails:array<struct<verdict:string>>>")
    doc = j.select("run_id", F.from_json("analysis_result", schema).alias("r"))
    return doc.select(
        "run_id", F.col("r.experiment").alias("experiment"), F.col("r.prior").alias("prior"),
        rnd(F.col("r.srm.chi2_p_value"), 3, "srm_p"), F.col("r.srm.ok").alias("srm_ok"), F.col("r.sample_check.ok").alias("sample_ok"),
        F.col("r.primary_metric.verdict").alias("primary_verdict"),
        F.concat_ws(" / ", F.transform("r.guardrails", lambda g: g["verdict"])).alias("guardrail_verdicts"),
    )


@query("i11_data_status", W + """
SELECT run_id, CASE WHEN nk % 4 = 1 THEN 'no_primary_metric_rows' WHEN nk % 4 = 2 THEN 'zero_users' ELSE 'ok' END AS status,
 CASE WHEN method = 'bandit' THEN 'bandit' ELSE 'bayesian' END AS analysis FROM runs""")
def i11(spark, d):
    nk = F.substring("run_id", 5, 2).cast("int")
    s = live_stats(spark, d).where(~((nk % 4 == 1) & (F.col("role") == "primary")))
    s = s.withColumn("n", F.when(nk % 4 == 2, F.lit(0.0)).otherwise(F.col("n")))
    return decision.data_status(s, fx.runs(spark, d)).select("run_id", "status", "analysis")


@query("i11_failed_sources", W + """
SELECT run_id, CASE WHEN nk % 4 = 1 THEN 'customer_source_failed' WHEN nk % 4 = 2 THEN 'no_primary_metric_rows' ELSE 'ok' END AS status,
 CASE WHEN nk % 4 = 1 THEN 'Customer endpoint fetch failed: no reply from p|' || nk END AS reason FROM runs""")
def i11_failed(spark, d):
    """A customer run whose source failed ends with the reason, though live data of its flag exists; one without data ends without."""
    nk = F.substring("run_id", 5, 2).cast("int")
    runs = fx.raw_runs(spark, d).withColumn("data_source_mode", F.when(nk % 4 == 1, "customer-single").when(nk % 4 == 2, "customer-per-metric").otherwise("managed"))
    failures = runs.select("run_id", F.concat(F.lit("no reply from p|"), nk.cast("string")).alias("error")).where(nk % 4 != 2)
    _, results = analyze.analyze(fx.evaluations(spark, d), fx.metric_events(spark, d), runs, fx.AS_OF, failures=failures)
    return results.select("run_id", "status", "reason")


@query("i11_analyze_all_runs", W + """
SELECT run_id, 'ok' AS status, CASE WHEN method = 'bandit' THEN 'bandit' ELSE 'bayesian' END AS analysis, false AS variants_corrected,
 CASE WHEN method = 'bandit' THEN 'bandit' ELSE 'bayesian' END AS document_type, slug FROM runs""")
def i11_all(spark, d):
    _, results = analyze.analyze(fx.evaluations(spark, d), fx.metric_events(spark, d), fx.raw_runs(spark, d), fx.AS_OF)
    return results.select(
        "run_id", "status", "analysis", "variants_corrected",
        F.get_json_object("analysis_result", "$.type").alias("document_type"),
        F.get_json_object("analysis_result", "$.experiment").alias("slug"),
    )


def _renamed(spark, d):
    """Statistics under other variant names for some runs: all renamed, or all but one."""
    nk = F.substring("run_id", 5, 2).cast("int")
    whole = F.concat(F.lit("value "), F.col("variant"))
    part = F.when(F.col("variant").isin("v0", "arm-0"), F.lit("zero")).otherwise(F.col("variant"))
    return live_stats(spark, d).withColumn("variant", F.when(nk % 3 == 0, whole).when(nk % 3 == 1, part).otherwise(F.col("variant")))


@query("c6_variant_correction", W + "SELECT run_id, idx AS arm_idx, arm, 'value ' || arm AS new_arm FROM arms WHERE nk % 3 = 0")
def c6(spark, d):
    return variants.corrected_variants(_renamed(spark, d), fx.runs(spark, d)).select("run_id", "arm_idx", "arm", "new_arm")


@query("c7_variant_mismatch", W + """,
x AS (SELECT run_id, nk, string_agg(arm, ', ' ORDER BY idx) AS expected, string_agg(CASE WHEN nk % 3 = 0 THEN 'value ' || arm ELSE arm END, ', ' ORDER BY idx)
 FILTER (nk % 3 = 0 OR idx > 0) AS others FROM arms WHERE nk % 3 < 2 GROUP BY ALL)
SELECT run_id, 'The run is set up for [' || expected || '], its data holds [' || others || CASE WHEN nk % 3 = 1 THEN ', zero' ELSE '' END ||
 ']. Set the run''s variants to those of its data.' AS warning FROM x""")
def c7(spark, d):
    return variants.variant_mismatches(_renamed(spark, d), fx.runs(spark, d)).select("run_id", "warning")


@query("c10_incomplete_metrics", W + """
SELECT s.run_id, s.event_name AS metric, a.arm AS variant FROM specs s JOIN arms a USING (run_id)
WHERE (s.nk % 3 = 0) OR (s.nk % 3 = 1 AND a.idx = 0)""")
def c10(spark, d):
    return variants.incomplete_metrics(_renamed(spark, d), fx.specs(spark, d), fx.runs(spark, d)).select("run_id", "metric", "variant")


@query("g2_missing_variants", W + """
SELECT run_id, string_agg(arm, ',' ORDER BY arm) AS missing FROM arms WHERE nk % 3 = 0 OR (nk % 3 = 1 AND idx = 0) GROUP BY 1""")
def g2(spark, d):
    m = variants.variant_mismatches(_renamed(spark, d), fx.runs(spark, d))
    return m.select("run_id", F.concat_ws(",", "missing").alias("missing"))


@query("i12_input_violations", W + """
SELECT run_id, metric, variant, CASE WHEN nk % 5 = 0 AND conversions > 0 AND metric_type = 'binary' THEN 'n must be positive,k exceeds n'
  WHEN nk % 5 = 0 THEN 'n must be positive' ELSE 'unknown variant' END AS violations
FROM (SELECT vs.*, nk FROM vs JOIN runs USING (run_id)) WHERE nk % 5 = 0 OR (nk % 7 = 1 AND variant IN ('v1', 'arm-1'))""")
def i12(spark, d):
    nk = F.substring("run_id", 5, 2).cast("int")
    s = live_stats(spark, d).withColumn("n", F.when(nk % 5 == 0, F.lit(0.0)).otherwise(F.col("n")))
    other = (nk % 5 != 0) & (nk % 7 == 1) & F.col("variant").isin("v1", "arm-1")
    bad = decision.input_violations(s.withColumn("variant", F.when(other, F.lit("stranger")).otherwise(F.col("variant"))), fx.runs(spark, d))
    named = F.when(F.col("variant") != "stranger", F.col("variant")).when(nk % 2 == 0, F.lit("v1")).otherwise(F.lit("arm-1"))
    return bad.select("run_id", "metric", named.alias("variant"), F.concat_ws(",", "violations").alias("violations"))


DECISION = BAYES + SRM + """,
fold AS (SELECT run_id, variant, max(win) FILTER (role = 'primary') AS p, max(risk_ctrl) FILTER (role = 'primary') AS rc,
  max(risk_trt) FILTER (role = 'primary') AS rt, min(win) FILTER (role = 'guardrail') AS g FROM cmp GROUP BY ALL),
de AS (SELECT fold.*, srm.p >= 0.01 AS srm_ok, minimum_sample = 0 OR smallest >= minimum_sample AS sample_ok, coalesce(rc > 0.02 AND rt > 0.02, false) AS wide
  FROM fold JOIN srm USING (run_id) JOIN runs USING (run_id))"""


@query("i13_decisions", W + "," + DECISION + """
SELECT run_id, variant, srm_ok AND sample_ok AND NOT wide AS gate_passed, CASE WHEN NOT srm_ok THEN 'PAUSE' WHEN NOT sample_ok OR wide THEN 'INCONCLUSIVE'
 WHEN coalesce(g, 1) <= 0.05 OR p <= 0.05 THEN 'ROLLBACK' WHEN coalesce(g, 1) <= 0.2 THEN 'PAUSE' WHEN p >= 0.95 AND rt < 0.01 THEN 'CONTINUE'
 WHEN p >= 0.8 THEN 'PAUSE' ELSE 'INCONCLUSIVE' END AS category FROM de""")
def i13(spark, d):
    c = compared(spark, d)
    x = decision.decisions(bayes.comparisons(c), bayes.run_health(c, fx.runs(spark, d)))
    return x.select("run_id", "variant", "gate_passed", "category")


@query("i15_minimum_sample", W + f"""
SELECT runs.run_id, {r('conversions / users', 6)} AS baseline_rate, coalesce(ceil(30.0 * users / nullif(conversions, 0)), 1000)::BIGINT AS minimum_sample
FROM runs LEFT JOIN (SELECT * FROM vs WHERE metric_ord = 0 AND metric_type = 'binary' AND variant = 'arm-0') c USING (run_id)""")
def i15(spark, d):
    m = decision.minimum_sample(live_stats(spark, d), fx.runs(spark, d))
    return m.select("run_id", rnd("baseline_rate", 6), "minimum_sample")


@query("i16_conversion_floor", W + """
SELECT run_id, metric, variant, conversions::DOUBLE AS k, conversions < 30 AS below_floor FROM vs WHERE metric_type = 'binary'""")
def i16(spark, d):
    return decision.conversion_floor(live_stats(spark, d)).select("run_id", "metric", "variant", "k", "below_floor")


def _past(spark, d):
    c = bayes.comparisons(compared(spark, d)).where(F.col("error").isNull())
    return c.join(fx.runs(spark, d).select("run_id", "experiment_id", "start_date", "end_date"), "run_id").withColumn("rel_delta", F.col("relative_change"))


@query("i17_pilot_priors", W + "," + BAYES + f"""
SELECT m.run_id, metric, count(*) AS past_runs, {r('avg(mu)', 5)} AS prior_mean, {r('CASE WHEN count(*) > 1 THEN stddev_samp(mu) ELSE max(hi - lo) / 3.92 END', 5)} AS prior_stddev
FROM runs m JOIN runs p ON p.experiment_id = m.experiment_id AND p.end_date < m.start_date JOIN cmp ON cmp.run_id = p.run_id WHERE error IS NULL GROUP BY ALL""")
def i17_pilot(spark, d):
    """A run's prior from the earlier runs of its experiment, none of whose windows shares a day with its own."""
    past = _past(spark, d)
    keys = ["experiment_id", "metric"]
    mains = fx.runs(spark, d).select("run_id", "experiment_id", "start_date").join(past.select(*keys).distinct(), "experiment_id")
    p = decision.priors_before(past, mains, keys)
    return p.select("run_id", "metric", "past_runs", rnd("prior_mean", 5), rnd("prior_stddev", 5))


@query("i17_history_priors", W + "," + BAYES + f"""
SELECT experiment_id, metric, count(*) AS past_runs, {r('avg(mu)', 5)} AS prior_mean,
 {r('CASE WHEN count(*) > 1 THEN stddev_samp(mu) ELSE max(hi - lo) / 3.92 END', 5)} AS prior_stddev
FROM cmp JOIN runs USING (run_id) WHERE error IS NULL GROUP BY ALL""")
def i17(spark, d):
    past = _past(spark, d)
    p = decision.priors_from_history(past, ["experiment_id", "metric"])
    return p.select("experiment_id", "metric", "past_runs", rnd("prior_mean", 5), rnd("prior_stddev", 5))


@query("i19_reading_bands", W + "," + BAYES + """
SELECT run_id, metric, variant, CASE WHEN risk_trt < 0.001 THEN 'negligible' WHEN risk_trt <= 0.01 THEN 'acceptable' ELSE 'meaningful' END AS risk_band,
 CASE WHEN role = 'guardrail' THEN CASE WHEN win <= 0.05 THEN 'strong harm signal' WHEN win <= 0.2 THEN 'possible harm' WHEN win < 0.8 THEN 'no detectable effect' ELSE 'likely lift' END END AS guardrail_band
FROM cmp WHERE error IS NULL""")
def i19(spark, d):
    b = decision.reading_bands(bayes.comparisons(compared(spark, d)))
    return b.select("run_id", "metric", "variant", "risk_band", "guardrail_band")


@query("i20_suspicious_directions", W + "," + BAYES + f"""
SELECT run_id, metric, variant, {r('mu', 5)} AS relative_change FROM cmp
WHERE role = 'guardrail' AND error IS NULL AND 1 - win < 0.1 AND abs(mu) >= 0.1""")
def i20(spark, d):
    s = decision.suspicious_directions(bayes.comparisons(compared(spark, d)), jump=0.1)
    return s.select("run_id", "metric", "variant", rnd("relative_change", 5))


@query("i21_density_curve", W + "," + BAYES + f"""
, c AS (SELECT run_id, metric, variant, {sql_half_up('mu', 6)} AS m, {sql_half_up('lo', 6)} AS l, {sql_half_up('hi', 6)} AS h FROM cmp WHERE error IS NULL),
p AS (SELECT *, (h - l) / 3.92 AS s, unnest(range(81)) AS i FROM c WHERE h > l)
SELECT run_id, metric, variant, i::INTEGER AS i, {r('m - 3.5 * s + 7 * s * i / 80', 4)} AS x, {r(sql_pdf('(7.0 * i / 80 - 3.5)') + ' / s', 2)} AS density FROM p""")
def i21(spark, d):
    c = bayes.density_curve(bayes.section_rows(compared(spark, d)))
    return c.select("run_id", "metric", "variant", "i", rnd("x", 4), rnd("density", 2))
