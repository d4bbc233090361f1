"""Name a sub-expression inside a column expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    An expression that uses an operand many times would otherwise carry that
    many copies of it, and nesting multiplies them.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)
