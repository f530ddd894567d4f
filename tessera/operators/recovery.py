"""Reveal the measure of a selection, infer the contrasts, and score the inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import stats
from .lattice import closure


def reveal(selected: DataFrame, cells: DataFrame) -> DataFrame:
    """The measured value of each selected cell that has one: the only place where a measure meets a selection."""
    return selected.select("cell_code").join(cells.select("cell_code", "prior", "dg"), "cell_code").where(F.col("dg").isNotNull())


def slope(revealed: DataFrame) -> DataFrame:
    """One row: the slope of measure on prior through the origin."""
    return revealed.agg(F.round(stats.slope(F.col("prior"), F.col("dg")), 9).alias("slope"), F.count(F.lit(1)).alias("n"))


def posterior(pool: DataFrame, revealed: DataFrame) -> DataFrame:
    """``pool`` with measured, slope, base (the scaled prior) and mu: measured cells pinned, the rest at the scaled prior."""
    told = pool.join(revealed.select("cell_code", F.col("dg").alias("measured")), "cell_code", "left").crossJoin(slope(revealed).select("slope"))
    base = F.round(F.col("slope") * F.col("prior"), 9)
    return told.withColumn("base", base).withColumn("mu", F.coalesce("measured", base))


def fold(ident: Column | None, n_dims: int, folds: int) -> Column:
    return F.pmod(C.cell_hash(n_dims), F.lit(folds))


def crossfit_slopes(revealed: DataFrame) -> DataFrame:
    """fold, slope: fitted on all rows outside the fold, as totals less the fold's own sums; one pass for all folds."""
    own = revealed.groupBy("fold").agg(F.sum(F.col("prior") * F.col("dg")).alias("xy"), F.sum(F.col("prior") * F.col("prior")).alias("xx"), F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy()
    xy, xx = F.sum("xy").over(all_) - F.col("xy"), F.sum("xx").over(all_) - F.col("xx")
    return own.select("fold", F.round(F.coalesce(F.try_divide(xy, xx), F.lit(1.0)), 9).alias("slope"), (F.sum("n").over(all_) - F.col("n")).alias("n_fit"))


def term_table(cells: DataFrame, told: DataFrame, max_order: int = 3) -> DataFrame:
    """One row per term: its true, prior and posterior contrast, its measured skeleton, and how much of it was measured."""
    values = told.select("cell_code", "measured", "base", "mu").join(cells.select("cell_code", "dg"), "cell_code")
    rows = closure(cells.where(F.col("ord").between(2, max_order))).join(values.withColumnRenamed("cell_code", "member"), "member")
    signed = lambda c: F.round(F.sum(F.col("sign") * F.col(c)), 9)
    out = rows.groupBy("term", "t_ord").agg(
        F.count(F.lit(1)).alias("n_members"), F.count("measured").alias("n_measured"), signed("dg").alias("truth"), signed("base").alias("prior_eps"), signed("mu").alias("post_eps"),
        F.coalesce(signed("measured"), F.lit(0.0)).alias("skeleton"),
    )
    informed, pinned = F.col("n_measured") > 0, F.col("n_measured") == F.col("n_members")
    return out.withColumn("informed", informed).withColumn("pinned", pinned).withColumn("state", F.when(pinned, "pinned").when(informed, "informed").otherwise("uninformed"))


def ranked(terms: DataFrame, *columns: str, by: list[Column] | None = None) -> DataFrame:
    """``terms`` once for its order and once pooled (order 0), with average ranks ``<column>_rank`` within each."""
    twice = terms.withColumn("grp", F.explode(F.array(F.col("t_ord"), F.lit(0))))
    for c in columns:
        twice = twice.withColumn(f"{c}_rank", stats.average_rank(c, "grp", *(by or [])))
    return twice


def by_order(terms: DataFrame) -> DataFrame:
    """Per order, and pooled as order 0: correlations over all terms and over those predicted, counts, error gain."""
    all_ = ranked(terms, "post_eps", "truth")
    guessed = ranked(terms.where("informed and not pinned"), "post_eps", "truth")
    predicted = guessed.groupBy("grp").agg(
        F.round(stats.pearson(F.col("post_eps"), F.col("truth")), 6).alias("pearson_predicted"), F.round(stats.pearson(F.col("post_eps_rank"), F.col("truth_rank")), 6).alias("spearman_predicted")
    )
    return all_.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_terms"), F.count_if("informed").alias("n_informed"), F.count_if("pinned").alias("n_pinned"),
        F.round(F.count_if("informed") / F.count(F.lit(1)), 6).alias("coverage_fraction"),
        F.round(stats.pearson(F.col("post_eps"), F.col("truth")), 6).alias("pearson"), F.round(stats.pearson(F.col("post_eps_rank"), F.col("truth_rank")), 6).alias("spearman"),
        F.round(stats.sse_gain(F.col("prior_eps"), F.col("post_eps"), F.col("truth")), 6).alias("sse_gain"),
    ).join(predicted, "grp", "left").withColumnRenamed("grp", "t_ord")


def partial_by_order(terms: DataFrame) -> DataFrame:
    """Per order: the correlation of inferred and true contrasts, and what is left of it without the skeleton, both kinds."""
    rows = ranked(terms, "post_eps", "truth", "skeleton")
    columns = []
    for kind, end in (("pearson", ""), ("spearman", "_rank")):
        x, y, z = (F.col(c + end) for c in ("post_eps", "truth", "skeleton"))
        xy, xz, yz = stats.pearson(x, y), stats.pearson(x, z), stats.pearson(y, z)
        columns += [F.round(xy, 6).alias(f"{kind}_raw"), F.round(xz, 6).alias(f"{kind}_skeleton"), F.round(stats.partial(xy, xz, yz), 6).alias(f"{kind}_partial")]
    return rows.groupBy("grp").agg(*columns).withColumnRenamed("grp", "t_ord")


def hit_rate(selected: DataFrame, cells: DataFrame, budget: int, max_order: int = 3) -> DataFrame:
    """One row: the share of the truly best ``budget`` cells that were selected."""
    best = cells.where(F.col("ord").between(1, max_order)).orderBy(F.desc("dg"), "cell_code").limit(budget).select("cell_code")
    return best.join(selected.select("cell_code"), "cell_code", "left_semi").agg(F.count(F.lit(1)).alias("n_hits"), F.round(F.count(F.lit(1)) / budget, 6).alias("hit_rate"))


def common_terms(a: DataFrame, b: DataFrame) -> DataFrame:
    """Terms by the state that two selections leave them in: subset, n_terms."""
    both = a.select("term", F.col("informed").alias("ia"), F.col("pinned").alias("pa")).join(b.select("term", F.col("informed").alias("ib"), F.col("pinned").alias("pb")), "term")
    subsets = F.array(
        F.lit("all_eligible"),
        F.when(F.expr("ia and ib and not pa and not pb"), "common_informed_not_pinned"),
        F.when(F.expr("not ia and not ib"), "common_uninformed"),
    )
    return both.select(F.explode(F.array_compact(subsets)).alias("subset")).groupBy("subset").agg(F.count(F.lit(1)).alias("n_terms"))
