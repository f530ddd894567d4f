"""Scores of candidates and budgeted selections. Nothing here reads the measure of a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import stats
from ..sources.landscapes import dimensions
from .lattice import coverage

SEED = "tie-1"
#: What a selection may read of a landscape.
BLIND = ("cell_code", "ord", "prior", "prior_var")


def scored(cells: DataFrame, max_order: int = 3) -> DataFrame:
    """Candidates with ident, prior, prior_var, loops, info (variance times loops) and structural (loops alone)."""
    n = dimensions(cells)
    pool = cells.where(F.col("ord").between(1, max_order)).select(
        *BLIND, *[f"d{k}" for k in range(n)], *[f"r{k}" for k in range(n)], C.canonical_id(C.assignments(n)).alias("ident")
    )
    loops = coverage(cells, max_order).withColumnRenamed("member", "cell_code")
    out = pool.join(loops, "cell_code", "left").withColumn("loops", F.coalesce("loops", F.lit(0)))
    return out.withColumn("info", F.round(F.col("prior_var") * F.col("loops"), 9)).withColumn("structural", F.col("loops").cast("double"))


def _order(score: str, seed: str) -> list[Column]:
    return [F.col(score).desc(), C.stable_order(seed, F.col("ident")), F.col("ident")]


def top(pool: DataFrame, score: str, budget: int, seed: str = SEED) -> DataFrame:
    """The ``budget`` candidates of the highest score with ``rank``; equal scores in a seeded order of their ids."""
    if budget < 1:
        raise ValueError(f"a budget of at least 1, not {budget}")
    best = pool.orderBy(*_order(score, seed)).limit(budget)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*_order(score, seed))))


def tops(pool: DataFrame, scores: tuple[str, ...], budget: int, seed: str = SEED) -> DataFrame:
    """``top`` by each of several scores at once, with ``method``, the score's name: one pass over the pool and one window."""
    told = F.array(*[F.struct(F.lit(s).alias("method"), F.col(s).cast("double").alias("by")) for s in scores])
    rows = pool.withColumn("m", F.explode(told)).select("*", "m.*").drop("m")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("method").orderBy(*_order("by", seed)))).where(F.col("rank") <= budget).drop("by")


def varied(pool: DataFrame, score: str) -> DataFrame:
    """``pool``, or an error if its score is the same everywhere and so orders nothing."""
    spread = pool.agg((F.max(F.round(score, 12)) > F.min(F.round(score, 12))).alias("ok"))
    return pool.crossJoin(spread).where(F.assert_true("ok", F.lit(f"{score} is constant: it orders nothing")).isNull()).drop("ok")


def blended(pool: DataFrame, weight: float) -> DataFrame:
    """``pool`` with ``blend``: information and prior, each scaled to 0..1, the latter with ``weight``."""
    if not 0.0 <= weight <= 1.0:
        raise ValueError(f"a weight from 0 to 1, not {weight}")
    if weight in (0.0, 1.0):
        return pool.withColumn("blend", F.col("prior" if weight else "info"))
    return pool.withColumn("blend", F.round((1.0 - weight) * stats.minmax("info") + weight * stats.minmax("prior"), 9))


def random_by_hash(pool: DataFrame, budget: int, seed: str) -> DataFrame:
    """A uniform sample without replacement that any engine repeats: the first in the seeded order of ids."""
    return top(pool.withColumn("even", F.lit(0)), "even", budget, seed)


def practice(pool: DataFrame, budget: int) -> DataFrame:
    """The best pairs of the best singles: as few top singles as give ``budget`` pairs of different dimensions.

    A pair becomes possible when the later of its two singles does, so one running count finds the cut.
    """
    n = dimensions(pool)
    singles = pool.where("ord = 1").select(F.col("cell_code").alias("single"), F.row_number().over(Window.orderBy(F.desc("prior"), "cell_code")).alias("place"))
    digits = F.filter(F.array(*[F.when(F.col(f"d{k}") > 0, F.col(f"d{k}") * F.col(f"r{k}")) for k in range(n)]), lambda x: x.isNotNull())
    pairs = pool.where("ord = 2").select("cell_code", "ident", "prior", F.explode(digits).alias("single"))
    entered = pairs.join(singles, "single").groupBy("cell_code", "ident", "prior").agg(F.max("place").alias("enters"))
    counts = entered.groupBy("enters").agg(F.count(F.lit(1)).alias("c")).withColumn("total", F.sum("c").over(Window.orderBy("enters")))
    cut = counts.agg(F.coalesce(F.min(F.when(F.col("total") >= budget, F.col("enters"))), F.max("enters")).alias("cut"))
    able = entered.crossJoin(cut).where("enters <= cut")
    rank = F.row_number().over(Window.orderBy(F.desc("prior"), "cell_code"))
    return able.orderBy(F.desc("prior"), "cell_code").limit(budget).select("cell_code", "ident", "prior", rank.alias("rank"))


def ties_at_cut(pool: DataFrame, score: str, budgets: list[int]) -> DataFrame:
    """budget, boundary score, the number of equals there, how many of them are taken, and whether the cut parts them."""
    strata = pool.groupBy(F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    after = F.sum("n").over(Window.orderBy(F.desc("score")))
    strata = strata.withColumn("before", after - F.col("n"))
    cuts = strata.select("score", "n", "before", F.explode(F.array(*map(F.lit, budgets))).alias("budget")).where("before < budget and budget <= before + n")
    return cuts.select("budget", F.col("score").alias("boundary_score"), F.col("n").alias("stratum_size"), (F.col("budget") - F.col("before")).alias("n_taken"), (F.col("budget") < F.col("before") + F.col("n")).alias("crosses"))


def require_untied(pool: DataFrame, score: str, budgets: list[int]) -> DataFrame:
    """``ties_at_cut``, or an error if the cut of a budget parts equals."""
    cuts = ties_at_cut(pool, score, budgets)
    message = F.concat(F.lit("equals at the cut of a budget of "), F.col("budget").cast("string"))
    return cuts.where(F.assert_true(~F.col("crosses"), message).isNull())


def stable_prefix(rows: DataFrame, score: str, order: str, k: int, *by: str) -> DataFrame:
    """``rows`` with place, the first ``k`` of each group: best score first, equal ones in the order that they have."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
