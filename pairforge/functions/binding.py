"""Evaluate a Column once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    An expression named inside a higher-order function is computed again for every element; as the
    variable of a one-element ``transform`` it is computed before.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
