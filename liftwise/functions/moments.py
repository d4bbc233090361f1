"""Moments, effect sizes and expected losses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from liftwise.functions.binding import let
from liftwise.functions.distributions import normal_cdf, normal_pdf


def moments(
    n: Column, k: Column, total: Column, sum_squares: Column, mean: Column, variance: Column
) -> dict[str, Column]:
    """(mean, variance, n) from whichever statistics are present.

    A success count wins over a sum, a sum over a given mean; without any of
    them, or without users, everything is zero.
    """
    size = F.floor(F.coalesce(n.cast("double"), F.lit(0.0)))
    users = F.when(size > 0, size)
    rate = k.cast("double") / users
    average = total / users
    spread = F.when(
        size > 1, (F.coalesce(sum_squares, F.lit(0.0)) - total * total / users) / F.when(size > 1, size - 1)
    ).otherwise(F.lit(0.0))
    zero = F.lit(0.0)
    none = (size == 0) | (k.isNull() & total.isNull() & mean.isNull())
    return {
        "m_n": F.when(none, F.lit(0)).otherwise(size).cast("bigint"),
        "m_mean": F.when(none, zero).when(k.isNotNull(), rate).when(total.isNotNull(), average).otherwise(mean),
        "m_var": F.when(none, zero)
        .when(k.isNotNull(), rate * (F.lit(1.0) - rate))
        .when(total.isNotNull(), spread)
        .otherwise(F.coalesce(variance, zero)),
    }


def effect_se(
    mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column, relative: bool
) -> Column:
    """Delta-method standard error of the relative or absolute effect.

    The relative form is 0 for a zero control mean; null when a side is empty.
    """
    share_a = var_a / F.when(n_a > 0, n_a)
    share_b = var_b / F.when(n_b > 0, n_b)
    if not relative:
        return F.sqrt(share_b + share_a)
    base = F.when(mean_a != 0, mean_a)
    ratio = mean_b / base
    return F.when(mean_a == 0, F.lit(0.0)).otherwise(
        F.sqrt(share_b / (base * base) + share_a * ratio * ratio / (base * base))
    )


def expected_losses(mu: Column, sigma: Column) -> tuple[Column, Column]:
    """(E[max(0, d)], E[max(0, -d)]) for an effect d ~ N(mu, sigma^2), sigma > 0."""

    def gain(m: Column, s: Column) -> Column:
        return let(m / s, lambda z: m * normal_cdf(z) + s * normal_pdf(z))

    return gain(mu, sigma), gain(-mu, sigma)


def arm_posterior(
    mean: Column, variance: Column, n: Column, prior_proper: Column, prior_mean: Column, prior_stddev: Column
) -> tuple[Column, Column]:
    """(mean, variance) of an arm's posterior.

    The prior when there is no information, the data under a flat prior, the
    precision-weighted mixture otherwise.
    """
    prior_var = prior_stddev * prior_stddev
    data_var = variance / F.when(n > 0, n)
    precision = F.lit(1.0) / F.when(data_var != 0, data_var)
    prior_precision = F.lit(1.0) / F.when(prior_var != 0, prior_var)
    total = precision + prior_precision
    uninformed = (n == 0) | (variance == 0)
    return (
        F.when(uninformed, prior_mean)
        .when(~prior_proper, mean)
        .otherwise((mean * precision + prior_mean * prior_precision) / total),
        F.when(uninformed, prior_var).when(~prior_proper, data_var).otherwise(F.lit(1.0) / total),
    )
