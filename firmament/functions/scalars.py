"""Column expressions shared by the panel and array operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_EPS = 1e-3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row.

    Without the binding, Catalyst may inline the value at each use: into every
    branch of a predicate, or into a lambda that runs per array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def log_eps(x: Column) -> Column:
    return F.log(x + F.lit(LOG_EPS))


def array_sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v)


def array_quantile(sorted_xs: Column, q: float) -> Column:
    """Linear-interpolated quantile of an already sorted array."""
    h = (F.size(sorted_xs) - 1) * F.lit(float(q))
    lo = F.floor(h).cast("int")
    a = F.element_at(sorted_xs, lo + 1)
    b = F.element_at(sorted_xs, F.least(lo + 2, F.size(sorted_xs)))
    return a + (b - a) * (h - lo)


def clip_array(xs: Column, lo: Column, hi: Column) -> Column:
    return F.transform(xs, lambda v: F.when(v.isNotNull(), F.least(F.greatest(v, lo), hi)))


def verdict(stat: Column, p: Column, a_better: str = "model_a better", b_better: str = "model_b better") -> Column:
    """Sign of a loss differential read at the 5 % level."""
    return (
        F.when((stat < 0) & (p < 0.05), a_better)
        .when((stat > 0) & (p < 0.05), b_better)
        .otherwise("no significant difference")
    )
