"""Resampled intervals. Draws come from SHA-256, so that any engine repeats them; they aren't those of NumPy's generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def numbered(rows: DataFrame, order: str, *by: str) -> DataFrame:
    """``rows`` with idx, their number from 0 in their group."""
    return rows.withColumn("idx", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("long"))


def _drawn(seed: str, *parts: str) -> Column:
    """A whole number from the SHA-256 of a seed and what it is drawn for."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), *parts), 256), 1, 12), 16, 10).cast("long")


def draws(rows: DataFrame, replicates: int, seed: str, *by: str) -> DataFrame:
    """(by, rep, idx): for each replicate as many draws with replacement, of row numbers from 0, as the group has rows.

    ``rows`` is numbered: each row's own number is the slot that it draws for, so no group is written out in one place.
    """
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    slots = rows.select(*by, F.col("idx").alias("slot"))
    slots = (slots.join(sizes, list(by)) if by else slots.crossJoin(F.broadcast(sizes))).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return slots.select(*by, "rep", F.pmod(_drawn(seed, *by, "rep", "slot"), F.col("n")).alias("idx"))


def replicate(rows: DataFrame, order: str, replicates: int, seed: str, statistics: dict[str, Column], *by: str) -> DataFrame:
    """(by, rep, statistics): each statistic over each resample; one resample feeds them all, which pairs them."""
    known = numbered(rows, order, *by)
    return draws(known, replicates, seed, *by).join(known, [*by, "idx"]).groupBy(*by, "rep").agg(*[F.round(c, 9).alias(name) for name, c in statistics.items()])


def interval(reps: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, n_valid, lo, hi): the middle 95 per cent of the replicates that are defined; null for fewer than three."""
    enough = F.count(value) >= 3
    q = F.expr(f"percentile({value}, array(0.025, 0.975))")
    out = reps.groupBy(*by).agg(F.count(value).alias("n_valid"), F.when(enough, q).alias("q"))
    return out.select(*by, "n_valid", F.round(F.col("q")[0], 6).alias("lo"), F.round(F.col("q")[1], 6).alias("hi"))


def joint_interval(reps: DataFrame, values: list[str], *by: str) -> DataFrame:
    """``interval`` of several statistics of the same replicates: by, then n_<value>, <value>_lo and <value>_hi of each."""
    q = lambda c: F.when(F.count(c) >= 3, F.expr(f"percentile({c}, array(0.025, 0.975))"))
    out = reps.groupBy(*by).agg(*[x for c in values for x in (F.count(c).alias(f"n_{c}"), q(c).alias(f"{c}_q"))])
    return out.select(*by, *[x for c in values for x in (f"n_{c}", F.round(F.col(f"{c}_q")[0], 6).alias(f"{c}_lo"), F.round(F.col(f"{c}_q")[1], 6).alias(f"{c}_hi"))])


def correlation_interval(rows: DataFrame, x: str, y: str, order: str, replicates: int, seed: str, *by: str) -> DataFrame:
    """The percentile interval of Pearson's r; for Spearman's, give ranks."""
    return interval(replicate(rows, order, replicates, seed, {"r": stats.pearson(F.col(x), F.col(y))}, *by), "r", *by)


def hierarchical(rows: DataFrame, group: str, value: str, order: str, replicates: int, seed: str) -> DataFrame:
    """n_valid, lo, hi of a mean of means: groups are drawn with replacement, then rows anew within each drawn group."""
    groups, known = numbered(rows.select(group).distinct(), group), numbered(rows, order, group)
    outer = draws(groups, replicates, seed).join(groups, "idx").withColumn("turn", F.row_number().over(Window.partitionBy("rep").orderBy("idx", group)))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    slots = outer.select("rep", "turn", group).join(sizes, group).join(known.select(group, F.col("idx").alias("slot")), group)
    inner = slots.select("rep", "turn", group, F.pmod(_drawn(seed, "rep", "turn", group, "slot"), F.col("n")).alias("idx")).join(known, [group, "idx"])
    means = inner.groupBy("rep", "turn").agg(F.avg(value).alias("m")).groupBy("rep").agg(F.round(F.avg("m"), 9).alias("mean"))
    return interval(means, "mean")
