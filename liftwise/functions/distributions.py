"""Probability functions as column expressions.

Spark has no error function, normal or gamma distribution; these stay inside
the generated code instead of going through Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftwise.functions.binding import let

# Abramowitz & Stegun 7.1.26, constant term first.
_ERF_P = 0.3275911
_ERF_A = (0.0, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Acklam's rational approximation of the normal quantile,
# highest power first.
_Q_CENTRAL_NUM = (
    -3.969683028665376e01,
    2.209460984245205e02,
    -2.759285104469687e02,
    1.383577518672690e02,
    -3.066479806614716e01,
    2.506628277459239e00,
)
_Q_CENTRAL_DEN = (
    -5.447609879822406e01,
    1.615858368580409e02,
    -1.556989798598866e02,
    6.680131188771972e01,
    -1.328068155288572e01,
    1.0,
)
_Q_TAIL_NUM = (
    -7.784894002430293e-03,
    -3.223964580411365e-01,
    -2.400758277161838e00,
    -2.549732539343734e00,
    4.374664141464968e00,
    2.938163982698783e00,
)
_Q_TAIL_DEN = (
    7.784695709041462e-03,
    3.224671290700398e-01,
    2.445134137142996e00,
    3.754408661907416e00,
    1.0,
)
_Q_TAIL = 0.02425


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _poly(x: Column, highest_first: Sequence[float]) -> Column:
    value = F.lit(highest_first[0])
    for coefficient in highest_first[1:]:
        value = value * x + F.lit(coefficient)
    return value


def erf(x: Column | float) -> Column:
    """Error function, absolute error below 1.5e-7."""

    def at(x: Column) -> Column:
        tail = let(
            F.lit(1.0) / (F.lit(1.0) + F.lit(_ERF_P) * F.abs(x)), lambda t: _poly(t, _ERF_A[::-1])
        ) * F.exp(-x * x)
        return F.when(x >= 0, F.lit(1.0) - tail).otherwise(tail - F.lit(1.0))

    return let(_c(x), at)


def normal_pdf(x: Column | float, mu: Column | float = 0.0, sigma: Column | float = 1.0) -> Column:
    z = (_c(x) - _c(mu)) / _c(sigma)
    return F.exp(F.lit(-0.5) * F.pow(z, F.lit(2.0))) / (_c(sigma) * F.lit(math.sqrt(2 * math.pi)))


def normal_cdf(x: Column | float, mu: Column | float = 0.0, sigma: Column | float = 1.0) -> Column:
    z = (_c(x) - _c(mu)) / (_c(sigma) * F.lit(math.sqrt(2.0)))
    return F.lit(0.5) * (F.lit(1.0) + erf(z))


def normal_sf(x: Column | float, mu: Column | float = 0.0, sigma: Column | float = 1.0) -> Column:
    return F.lit(1.0) - normal_cdf(x, mu, sigma)


def normal_quantile(p: Column | float) -> Column:
    """Inverse of the standard normal distribution function."""
    p = _c(p)
    inner = p - F.lit(0.5)
    square = inner * inner
    central = _poly(square, _Q_CENTRAL_NUM) * inner / _poly(square, _Q_CENTRAL_DEN)

    def tail(q: Column) -> Column:
        z = F.sqrt(F.lit(-2.0) * F.log(q))
        return _poly(z, _Q_TAIL_NUM) / _poly(z, _Q_TAIL_DEN)

    return (
        F.when(p <= 0, F.lit(float("-inf")))
        .when(p >= 1, F.lit(float("inf")))
        .when(p == 0.5, F.lit(0.0))
        .when(p < _Q_TAIL, tail(p))
        .when(p <= 1 - _Q_TAIL, central)
        .otherwise(-tail(F.lit(1.0) - p))
    )


# The one quantile the interval columns need, evaluated once by the optimizer.
def z_95() -> Column:
    return normal_quantile(0.975)


def truncated_normal_mean(
    mu: Column | float, sigma: Column | float, lower: Column | None, upper: Column | None
) -> Column:
    """Mean of N(mu, sigma^2) given lower < X <= upper; ``None`` means unbounded."""
    mu, sigma = _c(mu), _c(sigma)
    zero, one = F.lit(0.0), F.lit(1.0)
    a = None if lower is None else (_c(lower) - mu) / sigma
    b = None if upper is None else (_c(upper) - mu) / sigma
    density = (zero if a is None else normal_pdf(a)) - (zero if b is None else normal_pdf(b))
    mass = (one if b is None else normal_cdf(b)) - (zero if a is None else normal_cdf(a))
    return F.when(mass <= 0, mu).otherwise(mu + sigma * density / F.when(mass > 0, mass))


def chi2_sf(x: Column, df: Column) -> Column:
    """P(X > x) for a chi-squared variable with whole ``df`` degrees of freedom.

    One minus the power series of the lower incomplete gamma function,
    P(a, y) = sum over m >= 0 of exp((a+m) ln y - y - ln Gamma(a+m+1)), with
    a = df/2 and y = x/2. All terms are positive, so nothing cancels, and terms
    are carried as logarithms, so nothing overflows. Beyond 30 standard
    deviations plus 300 above the mean the tail is below 1e-60 and taken as 0.
    """
    a = df.cast("double") / 2
    y = x.cast("double") / 2
    reach = a + F.sqrt(a) * 30 + 300
    # ln Gamma(a + 1) for half-integers: product of the factors above 1 or 1/2.
    log_gamma = F.aggregate(
        F.sequence(F.lit(0), F.floor(a).cast("int")),
        F.when(df % 2 == 0, F.lit(0.0)).otherwise(F.lit(0.5 * math.log(math.pi))),
        lambda acc, i: acc + F.when(a - i > 0, F.log(F.greatest(a - i, F.lit(1e-300)))).otherwise(F.lit(0.0)),
    )
    terms = F.ceil(y + F.sqrt(y) * 12 + 60).cast("int")
    state = F.struct(
        (a * F.log(y) - y - log_gamma).alias("term"),
        F.lit(0.0).alias("total"),
    )
    lower = F.aggregate(
        F.sequence(F.lit(1), terms),
        state,
        lambda acc, m: F.struct(
            (acc["term"] + F.log(y / (a + m))).alias("term"),
            (acc["total"] + F.exp(acc["term"])).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return (
        F.when((x <= 0) | (df <= 0), F.lit(1.0))
        .when(y > reach, F.lit(0.0))
        .otherwise(F.greatest(F.lit(1.0) - lower, F.lit(0.0)))
    )
