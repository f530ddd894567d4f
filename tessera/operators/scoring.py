"""A scoring plan: every candidate is scored in its own context and in contexts with other dimensions masked.

Many candidates ask for the same masked context, so the plan's rows are made unique, scored once, and joined
back to those who asked. The spread over the masked passes is the score's variance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.landscapes import dimensions

MASK = "*"


def _pattern(digits: list[Column]) -> Column:
    return F.concat_ws(",", *digits)


def plan(pool: DataFrame, passes: int, seed: str) -> DataFrame:
    """cell_code, pass, dim, pattern (the context with the dimension at its level) and base (at the reference).

    Pass 0 masks nothing; in the others every dimension that the cell leaves alone is masked or not by a hash.
    """
    n = dimensions(pool)
    rows = pool.select("cell_code", "ident", *[f"d{k}" for k in range(n)], F.explode(F.sequence(F.lit(0), F.lit(passes))).alias("pass"))
    coin = lambda k: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "ident", "pass", F.lit(k)), 256), 1, 8), 16, 10).cast("long") % 2 == 1
    shown = [F.when((F.col(f"d{k}") == 0) & (F.col("pass") > 0) & coin(k), MASK).otherwise(F.col(f"d{k}").cast("string")) for k in range(n)]
    rows = rows.select("cell_code", "pass", *[f"d{k}" for k in range(n)], *[c.alias(f"s{k}") for k, c in enumerate(shown)])
    asks = F.array(*[F.when(F.col(f"d{k}") > 0, F.struct(F.lit(k).alias("dim"), _pattern([F.col(f"s{j}") for j in range(n)]).alias("pattern"), _pattern([F.lit("0") if j == k else F.col(f"s{j}") for j in range(n)]).alias("base"))) for k in range(n)])
    return rows.select("cell_code", "pass", F.explode(F.array_compact(asks)).alias("a")).select("cell_code", "pass", "a.dim", "a.pattern", "a.base")


def marginals(cells: DataFrame, value: str) -> DataFrame:
    """pattern, mean: the mean of a value over all cells that a pattern matches, for every pattern that matches one."""
    n = dimensions(cells)
    masks = cells.select(*[f"d{k}" for k in range(n)], F.col(value).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(2**n - 1))).alias("m"))
    digit = lambda k: F.when(F.shiftright("m", k).bitwiseAND(F.lit(1)) == 1, F.lit(MASK)).otherwise(F.col(f"d{k}").cast("string"))
    return masks.groupBy(_pattern([digit(k) for k in range(n)]).alias("pattern")).agg(F.round(F.avg("x"), 9).alias("mean"))


def unique(planned: DataFrame) -> DataFrame:
    """pattern, base: what has to be scored, once each."""
    return planned.select("pattern", "base").distinct()


def score(asked: DataFrame, means: DataFrame) -> DataFrame:
    """``asked`` (pattern, base) with what the level adds to its reference in that context."""
    return asked.join(means.withColumnRenamed("mean", "there"), "pattern").join(means.select(F.col("pattern").alias("base"), F.col("mean").alias("here")), "base").select("pattern", "base", F.round(F.col("there") - F.col("here"), 9).alias("gain"))


def finalize(planned: DataFrame, scored: DataFrame) -> DataFrame:
    """cell_code, score (the sum of pass 0) and variance (of the sums of the other passes, over their number)."""
    sums = planned.join(scored, ["pattern", "base"]).groupBy("cell_code", "pass").agg(F.round(F.sum("gain"), 9).alias("total"))
    return sums.groupBy("cell_code").agg(F.round(F.max(F.when(F.col("pass") == 0, F.col("total"))), 6).alias("score"), F.round(F.coalesce(F.var_pop(F.when(F.col("pass") > 0, F.col("total"))), F.lit(0.0)), 6).alias("variance"))
