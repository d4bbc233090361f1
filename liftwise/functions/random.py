"""Counter-based random numbers: the k-th output of a seed, without state.

The generator's state after k steps is ``seed + k * step`` modulo 2^32, so each
output is a closed expression of (seed, k) and draws can be made in any task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftwise.functions.binding import let

_MASK = 0xFFFFFFFF
_STEP = 0x6D2B79F5  # fixed value


def _mul32(a: Column, b: Column) -> Column:
    # Two half-width products: a full 64-bit product would overflow under ANSI.
    low = a * b.bitwiseAND(F.lit(0xFFFF))
    high = (a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)) * 65536
    return (low + high).bitwiseAND(F.lit(_MASK))


def _shifted(x: Column, bits: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, bits))


def _state(seed: Column, k: Column) -> Column:
    step = (k.cast("bigint") % F.lit(1 << 32)) * F.lit(_STEP)
    return (seed.cast("bigint").bitwiseAND(F.lit(_MASK)) + step).bitwiseAND(F.lit(_MASK))


def _first(t: Column) -> Column:
    return _mul32(_shifted(t, 15), t.bitwiseOR(F.lit(1)))


def _second(x: Column) -> Column:
    return x.bitwiseXOR((x + _mul32(_shifted(x, 7), x.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_MASK)))


def _last(z: Column) -> Column:
    return _shifted(z, 14).cast("double") / F.lit(4294967296.0)


def uniform(seed: Column, k: Column) -> Column:
    """k-th (from 1) output in [0, 1) of the 32-bit generator seeded by ``seed``."""
    return let(let(let(_state(seed, k), _first), _second), _last)


def with_uniforms(df: DataFrame, seed: Column, draws: dict[str, Column]) -> DataFrame:
    """Add one ``uniform`` column per entry, step by step.

    For bulk use: every step is a projection of its own, so that all of them stay
    in generated code and no step is computed twice.
    """
    df = df.withColumns({name: _state(seed, k) for name, k in draws.items()})
    for step in (_first, _second, _last):
        df = df.withColumns({name: step(F.col(name)) for name in draws})
    return df


def standard_normal(u1: Column, u2: Column) -> Column:
    """Normal deviate from two uniforms (cosine branch, first floored at 1e-12)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.greatest(u1, F.lit(1e-12))))
    return radius * F.cos(F.lit(2.0) * F.pi() * u2)
