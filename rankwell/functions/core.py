"""Small building blocks shared by the expression modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once per row however often the body uses it.

    Without it a large expression is repeated at every use, also when a filter is pushed below it.
    """
    return F.transform(F.array(value), body)[0]
