import math

import pytest
from pyspark.sql import functions as F

from liftwise.functions import distributions as D
from liftwise.functions.hashing import hash_bucket
from liftwise.functions.moments import expected_losses
from liftwise.functions.random import uniform, with_uniforms
from liftwise.functions.rounding import round_half_up


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_hash_buckets(spark):
    cases = [("user-123", "new-checkout", 17), ("rat-user-000001", "run-active-test", 76), ("", "x", 18), ("ü", "f", 72), ("😀", "f", 39)]
    df = spark.createDataFrame(cases, "u string, f string, b int")
    assert [r.got for r in df.select(hash_bucket(F.col("u"), F.col("f")).alias("got")).collect()] == [c[2] for c in cases]


def test_random_sequence(spark):
    want = [0.6011037519201636, 0.44829055899754167, 0.8524657934904099]
    got = spark.range(1, 4).select(uniform(F.lit(42), F.col("id")).alias("u")).collect()
    assert [r.u for r in got] == want
    bulk = with_uniforms(spark.range(1, 4), F.lit(42), {"u": F.col("id")}).collect()
    assert [r.u for r in bulk] == want


@pytest.mark.parametrize("x", [-3.0, -0.7, 0.0, 0.4, 2.5])
def test_normal_functions(spark, x):
    assert one(spark, D.erf(x)) == pytest.approx(math.erf(x), abs=2e-7)
    assert one(spark, D.normal_cdf(x, 0.5, 2.0)) == pytest.approx(0.5 * math.erfc((0.5 - x) / 2 / math.sqrt(2)), abs=2e-7)
    assert one(spark, D.normal_pdf(x)) == pytest.approx(math.exp(-x * x / 2) / math.sqrt(2 * math.pi), abs=1e-12)


def test_normal_quantile(spark):
    assert one(spark, D.normal_quantile(0.975)) == pytest.approx(1.959964, abs=1e-6)
    assert one(spark, D.normal_quantile(0.01)) == pytest.approx(-2.326348, abs=1e-6)
    assert one(spark, D.normal_quantile(0.99)) == pytest.approx(2.326348, abs=1e-6)
    assert one(spark, D.normal_quantile(0.5)) == 0.0
    assert one(spark, D.normal_quantile(0.0)) == -math.inf
    assert one(spark, D.normal_quantile(1.0)) == math.inf


def test_truncated_mean_falls_back_to_mu(spark):
    assert one(spark, D.truncated_normal_mean(0.0, 1.0, F.lit(0.0), None)) == pytest.approx(0.797885, abs=1e-6)
    assert one(spark, D.truncated_normal_mean(-50.0, 1.0, F.lit(0.0), None)) == -50.0


@pytest.mark.parametrize("x,df,want", [
    (5.991464547, 2, 0.05), (3.841458821, 1, 0.05), (9.487729037, 4, 0.05), (7.814727903, 3, 0.05),
    (0.0, 3, 1.0), (2.0, 0, 1.0), (1e6, 1, 0.0), (2000.0, 1900, 0.0542067),
])
def test_chi2_survival(spark, x, df, want):
    assert one(spark, D.chi2_sf(F.lit(x), F.lit(df))) == pytest.approx(want, abs=1e-7)


def test_losses_differ_by_the_effect(spark):
    gain, loss = expected_losses(F.lit(-0.13), F.lit(0.4))
    row = spark.range(1).select(gain.alias("g"), loss.alias("l")).first()
    assert row.g > 0 and row.l > 0
    assert row.g - row.l == pytest.approx(-0.13, abs=1e-9)


def test_round_half_up(spark):
    assert one(spark, round_half_up(F.lit(-2.5), 0)) == -2.0
    assert one(spark, round_half_up(F.lit(2.5), 0)) == 3.0
    assert one(spark, round_half_up(F.lit(0.12345), 4)) == pytest.approx(0.1235)
