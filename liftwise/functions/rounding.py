"""Rounding rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, decimals: int) -> Column:
    """Round at ``decimals`` places, halves toward positive infinity."""
    scale = F.lit(10.0**decimals)
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def to_fixed(x: Column, decimals: int) -> Column:
    """Text with exactly ``decimals`` places."""
    return F.format_string(f"%.{decimals}f", x.cast("double"))


def number_text(x: Column) -> Column:
    """Shortest plain text of a number: no trailing ``.0``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")
