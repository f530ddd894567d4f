"""Aggregates and columns for guarded statistics: what is undefined is null, never zero or NaN."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: A sample is constant if its range is within this share of its largest size.
TOLERANCE = 1e-12
MIN_POINTS = 3


def constant(x: Column) -> Column:
    return F.max(x) - F.min(x) <= TOLERANCE * F.greatest(F.lit(1.0), F.max(F.abs(x)))


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r of the rows where both are there, from moments; null below three points or for a constant side."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    r = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
    return F.when((F.count(x) >= MIN_POINTS) & ~constant(x) & ~constant(y), r)


def average_rank(x: Column | str, *by: str | Column) -> Column:
    """Ranks from 1, ties at their mean, within ``by``."""
    x = F.col(x) if isinstance(x, str) else x
    one: WindowSpec = Window.partitionBy(*by)
    return F.rank().over(one.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2.0


def slope(x: Column, y: Column) -> Column:
    """The least-squares slope through the origin; 1 if nothing can be fitted."""
    return F.coalesce(F.try_divide(F.sum(x * y), F.sum(x * x)), F.lit(1.0))


def sse_gain(prior: Column, post: Column, truth: Column) -> Column:
    """The share of the prior's squared error that is gone; null if it had none."""
    return 1.0 - F.try_divide(F.sum(F.pow(post - truth, 2)), F.sum(F.pow(prior - truth, 2)))


def partial(xy: Column, xz: Column, yz: Column) -> Column:
    """The correlation of x and y without z; that of x and y alone where z says nothing."""
    left = F.sqrt((1.0 - xz * xz) * (1.0 - yz * yz))
    return F.when(xz.isNull() | yz.isNull(), xy).otherwise(F.try_divide(xy - xz * yz, left))


def fisher_z_mean(r: Column) -> Column:
    c = 1.0 - 1e-12
    return F.tanh(F.avg(F.atanh(F.least(F.greatest(r, F.lit(-c)), F.lit(c)))))


def minmax(x: str) -> Column:
    """Scaled to 0..1 over all rows; 0 if they are equal."""
    everything = Window.partitionBy()
    low, high = F.min(x).over(everything), F.max(x).over(everything)
    return F.coalesce(F.try_divide(F.col(x) - low, high - low), F.lit(0.0))


def soft_threshold(z: Column, gamma: Column) -> Column:
    return F.signum(z) * F.greatest(F.abs(z) - gamma, F.lit(0.0))


def trainable(x: Column) -> Column:
    """Whether ``log1p`` of a label is defined and finite."""
    return F.coalesce((x > -1.0) & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
