"""Naming the value of an expression inside another one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use refers to it; keeps nested expressions small."""
    return F.transform(F.array(value), lambda v: use(v))[0]
