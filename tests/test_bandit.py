import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from liftwise.plans import bandit
from tests.helpers import runs, stats

ARMS = (
    "run_id string, slug string, arm_idx int, arm string, metric string, mean double, variance double, n long, conversions double, rate double,"
    " inverse boolean, prior_proper boolean, prior_mean double, prior_stddev double, seed long, start_date date, end_date date"
)
# run: seed, inverse, prior stddev, (mean, variance, n) of each arm
CASES = {
    "two": (11, False, None, [(0.20, 0.16, 2000), (0.235, 0.179775, 2000)]),
    "three": (12, False, 0.4, [(0.300, 0.21, 1500), (0.308, 0.2131, 1500), (0.316, 0.2161, 1500)]),
    "inverse": (13, True, None, [(7.5, 9.0, 300), (6.9, 8.0, 350), (7.2, 10.0, 320)]),
    # Shrinkage toward 0 pulls arms by their precision: the calmest arm wins.
    "four": (14, False, 0.1, [(5.0, 6.0, 400), (5.4, 9.0, 420), (4.9, 4.0, 410), (5.6, 12.0, 390)]),
    "early": (15, False, None, [(0.4, 0.24, 60), (0.5, 0.25, 75)]),
}


def shares(draws):
    """P(best) and weight of each column: half of first and second places, at least 0.01, as shares of 1."""
    order = np.argsort(-draws, axis=1, kind="stable")
    first, second = (np.bincount(order[:, k], minlength=draws.shape[1]) / len(draws) for k in (0, 1))
    raw = np.maximum((first + second) / 2, 0.01)
    return first, raw / raw.sum()


def sampled(name, n=400_000):
    _, inverse, stddev, arms = CASES[name]
    mean, variance = np.array([a[0] for a in arms]), np.array([a[1] / a[2] for a in arms])
    if stddev is not None:
        mean, variance = mean / variance / (1 / variance + 1 / stddev**2), 1 / (1 / variance + 1 / stddev**2)
    draws = np.random.default_rng(3).normal(mean, np.sqrt(variance), (n, len(arms)))
    return shares(-draws if inverse else draws)


@pytest.fixture(scope="module")
def weighted(spark):
    rows = []
    for name, (seed, inverse, stddev, arms) in CASES.items():
        for i, (mean, variance, n) in enumerate(arms):
            rows.append((name, name, i, f"a{i}", "m", mean, variance, n, 0.0, mean, inverse, stddev is not None, 0.0, stddev or 0.3, seed, None, None))
    return bandit.bandit_weights(spark.createDataFrame(rows, ARMS)).cache()


@pytest.mark.parametrize("name", list(CASES))
def test_weights_match_a_sampler(weighted, name):
    got = weighted.where(F.col("run_id") == name).orderBy("arm_idx").collect()
    if name == "early":
        assert all(r.p_best is None and r.weight is None and r.seed is None for r in got)
        assert got[0].update_message.endswith("(current minimum: 60)")
    else:
        p_best, weights = sampled(name)
        assert [r.p_best for r in got] == pytest.approx(p_best, abs=0.02)
        assert [r.weight for r in got] == pytest.approx(weights, abs=0.02)
        assert sum(r.weight for r in got) == pytest.approx(1.0)


def test_stopping_messages(weighted):
    got = {r.run_id: r for r in bandit.stopping(bandit.best_arms(weighted)).collect()}
    assert got["two"].met and got["two"].message.startswith("a1 reached P(best)=0.99") and got["two"].message.endswith(">= 0.95")
    assert not got["three"].met and got["three"].message.startswith("best arm a2 currently at P(best)=0.")
    assert got["early"].best_arm == "a0" and got["early"].p_best == 0 and got["early"].message.startswith("burn-in")


def test_rollout_ranges_tile_the_unit(weighted):
    got = bandit.rollout_ranges(weighted.where("run_id = 'four'")).orderBy("arm_idx").collect()
    assert got[0].range_start == pytest.approx(0) and got[-1].range_end == pytest.approx(1)
    assert all(a.range_end == pytest.approx(b.range_start) for a, b in zip(got, got[1:]))


def matrix(seed, draws, arms):
    return np.random.default_rng(seed).integers(0, 9, (draws, arms)) / 4


MATRICES = {"clear": (False, matrix(1, 6, 2)), "mixed": (False, matrix(2, 9, 4)), "inverse": (True, matrix(3, 7, 3)), "tie": (False, np.ones((2, 3)))}


def test_sample_matrices(spark):
    rows = [(n, d, a, float(v), inv) for n, (inv, m) in MATRICES.items() for d, draw in enumerate(m) for a, v in enumerate(draw)]
    samples = spark.createDataFrame(rows, "run_id string, draw int, arm_idx int, value double, inverse boolean")
    got = bandit.weights_from_samples(samples).orderBy("run_id", "arm_idx").collect()
    for name, (inverse, m) in MATRICES.items():
        mine = [r for r in got if r.run_id == name]
        p, w = shares(-m if inverse else m)
        assert [r.p_best for r in mine] == pytest.approx(p)
        assert [r.weight for r in mine] == pytest.approx(w, abs=1e-4)


def test_missing_arm_counts_as_empty(spark):
    design = runs(spark, [{"run_id": "r", "method": "bandit", "control_variant": "c", "treatment_variant": "t,gone", "slug": "s"}])
    s = stats(spark, [("r", 0, "m", "primary", False, "c", {"n": 500, "k": 50}), ("r", 0, "m", "primary", False, "t", {"n": 500, "k": 60})])
    doc = json.loads(bandit.bandit_results(bandit.bandit_weights(bandit.bandit_arms(s, design)), "now").first().analysis_result)
    assert [a["n"] for a in doc["arms"]] == [500, 500, 0]
    assert doc["thompson_sampling"]["enough_units"] is False and "seed" not in doc["thompson_sampling"]
    assert [x["recommended_weight"] for x in doc["thompson_sampling"]["results"]] == [0, 0, 0]
    assert doc["srm"]["chi2_p_value"] == 0.0 and doc["stopping"]["best_arm"] == "c"
