"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(body: Callable[..., Column], /, **values: Column) -> Column:
    """``body`` over values that are computed once per row.

    Spark evaluates what a lambda refers to anew for each array element, unless it
    is a column or a lambda variable.  A one-element transform makes it one.

    ``body`` must not refer to the values inside a lambda of its own: Spark cannot
    pass a result with such a nested reference on to a Python UDF.
    """
    bound = F.struct(*[value.alias(name) for name, value in values.items()])
    return F.element_at(
        F.transform(F.array(bound), lambda v: body(**{name: v[name] for name in values})), 1
    )
