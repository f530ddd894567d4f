"""A benchmark of selections: for each held-out fold a blind selection, a fit on what it reveals, and scores on the fold.

All folds, methods and budgets are rows of one plan: a fold is a column, never a loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import stats
from .lattice import closure
from .selection import SEED


def held_out(pool: DataFrame, folds: int) -> DataFrame:
    """``pool`` (with fold, null for cells that are never held out) once for each fold: held, and whether the cell is in it."""
    return pool.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("inside", F.coalesce(F.col("fold") == F.col("held"), F.lit(False)))


def blind_coverage(cells: DataFrame, dealt: DataFrame, folds: int, max_order: int = 3) -> DataFrame:
    """held, cell_code, loops: in how many terms outside the held-out fold each cell stands."""
    terms = closure(cells.where(F.col("ord").between(2, max_order))).join(dealt.select(F.col("cell_code").alias("term"), "fold"), "term", "left")
    outside = held_out(terms, folds).where("not inside")
    return outside.groupBy("held", F.col("member").alias("cell_code")).agg(F.count(F.lit(1)).alias("loops"))


def blind_pool(pool: DataFrame, coverage: DataFrame, folds: int) -> DataFrame:
    """Candidates outside each held-out fold with the scores that they have there: held, cell_code, ident, prior, method, score."""
    rows = held_out(pool.select("cell_code", "ord", "ident", "prior", "prior_var", "fold"), folds).where("not inside").join(coverage, ["held", "cell_code"], "left")
    loops = F.coalesce("loops", F.lit(0)).cast("double")
    scores = F.array(*[F.struct(F.lit(m).alias("method"), s.alias("score")) for m, s in (("info", F.round(F.col("prior_var") * loops, 9)), ("prior", F.col("prior")), ("structural", loops))])
    return rows.select("held", "cell_code", "ord", "ident", "prior", F.explode(scores).alias("m")).select("held", "cell_code", "ord", "ident", "prior", "m.method", "m.score")


def plates(scored: DataFrame, budgets: list[int], seed: str = SEED) -> DataFrame:
    """``scored`` once for each budget whose plate the cell is on: held, method, budget, cell_code, ord, prior. One ranking serves all budgets."""
    w = Window.partitionBy("held", "method").orderBy(F.desc("score"), C.stable_order(seed, F.col("ident")), "ident")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(budgets))
    return ranked.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where("rank <= budget").select("held", "method", "budget", "cell_code", "ord", "prior", "rank")


_KEYS = ["held", "method", "budget"]


def revealed_counts(plate: DataFrame, cells: DataFrame) -> DataFrame:
    """held, method, budget: how many labels a plate reveals, how many are positive, not, or missing, and the positive share."""
    told = plate.join(cells.select("cell_code", "dg"), "cell_code", "left")
    return told.groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("n_selected"), F.count("dg").alias("n_train"), F.count_if(F.col("dg") > 0).alias("n_positive"), F.count_if(F.col("dg") <= 0).alias("n_nonpositive"),
        F.count_if(F.col("dg").isNull()).alias("n_missing"), F.round(F.try_divide(F.count_if(F.col("dg") > 0), F.count("dg")), 6).alias("positive_fraction"),
    )


def fits(plate: DataFrame, cells: DataFrame) -> DataFrame:
    """held, method, budget, slope: of measure on prior over what the plate reveals; 1 if nothing can be fitted."""
    told = plate.join(cells.select("cell_code", "dg").where("dg is not null"), "cell_code")
    return told.groupBy(*_KEYS).agg(F.round(stats.slope(F.col("prior"), F.col("dg")), 9).alias("slope"))


def evaluated(pool: DataFrame, cells: DataFrame, fitted: DataFrame, folds: int) -> DataFrame:
    """held, method, budget, ord, cell_code, pred, dg: the held-out cells, measured ones alone, under each fit."""
    due = held_out(pool.select("cell_code", "ord", "prior", "fold"), folds).where("inside").join(cells.select("cell_code", "dg").where("dg is not null"), "cell_code")
    return due.join(F.broadcast(fitted), "held").select(*_KEYS, "ord", "cell_code", F.round(F.col("slope") * F.col("prior"), 9).alias("pred"), "dg")


def cell_metrics(rows: DataFrame) -> DataFrame:
    """held, method, budget, n_held, rmse, spearman by order and their mean (null if either is)."""
    ranked = rows.withColumn("pr", stats.average_rank("pred", *_KEYS, "ord")).withColumn("tr", stats.average_rank("dg", *_KEYS, "ord"))
    per = ranked.groupBy(*_KEYS, "ord").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col("pred") - F.col("dg"), 2)).alias("sse"), F.round(stats.pearson(F.col("pr"), F.col("tr")), 9).alias("rho"))
    of = lambda k: F.max(F.when(F.col("ord") == k, F.col("rho")))
    return per.groupBy(*_KEYS).agg(
        F.sum("n").alias("n_held"), F.round(F.sqrt(F.sum("sse") / F.sum("n")), 6).alias("rmse"),
        F.round(of(2), 6).alias("spearman_2"), F.round(of(3), 6).alias("spearman_3"), F.round((of(2) + of(3)) / 2, 6).alias("macro_spearman"),
    )


def summaries(metrics: DataFrame) -> DataFrame:
    """method, budget: the means over folds, undefined ones left out, and how many folds had one."""
    return metrics.groupBy("method", "budget").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count("macro_spearman").alias("n_defined"),
        *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("rmse", "spearman_2", "spearman_3", "macro_spearman")],
    )


def ranking(scores: DataFrame, score: str, name: str) -> DataFrame:
    """``scores`` with ``place``: best first, undefined last, equal ones by name."""
    return scores.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), name)))


def support(pairs: DataFrame, pred: str, truth: str, *by: str) -> DataFrame:
    """Of matched coefficients: n, Spearman's r, the share of the squares that the prediction explains, and its support."""
    ranked = pairs.withColumn("pr", stats.average_rank(pred, *by)).withColumn("tr", stats.average_rank(truth, *by))
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(stats.pearson(F.col("pr"), F.col("tr")), 6).alias("spearman"),
        F.round(stats.sse_gain(F.lit(0.0), F.col(pred), F.col(truth)), 6).alias("sse_gain"), F.count_if(F.abs(pred) > 1e-12).alias("support"),
    )


def prior_policies(pool: DataFrame, told: DataFrame) -> DataFrame:
    """policy, slope, n_fit, n_open, sse: no prior, the prior itself, or the prior scaled to what is revealed; errors on what isn't.

    ``pool`` has cell_code, prior and dg; ``told`` the revealed cells' prior and dg.
    """
    fit = told.agg(F.round(stats.slope(F.col("prior"), F.col("dg")), 9).alias("fitted"), F.count(F.lit(1)).alias("n_fit"))
    policies = fit.select(F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), s.alias("slope"), n.alias("n_fit")) for p, s, n in (("zero", F.lit(0.0), F.lit(0).cast("long")), ("unit", F.lit(1.0), F.lit(0).cast("long")), ("fitted", F.col("fitted"), F.col("n_fit")))])).alias("p")).select("p.*")
    open_ = pool.join(told.select("cell_code"), "cell_code", "left_anti").where("dg is not null")
    return open_.crossJoin(F.broadcast(policies)).groupBy("policy", "slope", "n_fit").agg(F.count(F.lit(1)).alias("n_open"), F.round(F.sum(F.pow(F.col("slope") * F.col("prior") - F.col("dg"), 2)), 6).alias("sse"))


def seeded(pool: DataFrame, budget: int, seeds: int, salt: str) -> DataFrame:
    """seed, cell_code: for each seed a uniform selection without replacement, from the seeded order of ids."""
    rows = pool.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    order = F.sha2(F.concat(F.lit(f"{salt}-"), F.col("seed").cast("string"), F.lit(":"), F.col("ident")), 256)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(order, "ident"))).where(F.col("rank") <= budget).select("seed", "cell_code")


def arm_pairs(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """a_arm, b_arm, seed, delta of two tables of arms (arm, kind of seed, seed): by seed where both arms' seeds are of one kind, else each of one with each of the other.

    An arm of kind ``none`` has one row. All joins are on the arms or on arms and seeds; only the arms themselves, a row each, are crossed.
    """
    left, right = (x.select(F.col("arm").alias(f"{n}_arm"), F.col("kind").alias(f"{n}_kind"), F.col("seed").alias(f"{n}_seed"), F.col(value).alias(n)) for x, n in ((a, "a"), (b, "b")))
    arms = left.select("a_arm", "a_kind").distinct().crossJoin(right.select("b_arm", "b_kind").distinct())
    alike = (F.col("a_kind") == F.col("b_kind")) & (F.col("a_kind") != "none")
    paired = left.join(arms.where(alike), ["a_arm", "a_kind"]).join(right.withColumnRenamed("b_seed", "a_seed"), ["b_arm", "b_kind", "a_seed"]).select("a_arm", "b_arm", F.col("a_seed").alias("seed"), "a", "b")
    crossed = left.join(arms.where(~alike), ["a_arm", "a_kind"]).join(right, ["b_arm", "b_kind"]).select("a_arm", "b_arm", F.when(F.col("a_kind") == "none", F.col("b_seed")).when(F.col("b_kind") == "none", F.col("a_seed")).alias("seed"), "a", "b")
    return paired.unionByName(crossed).select("a_arm", "b_arm", "seed", F.round(F.col("a") - F.col("b"), 9).alias("delta"))


def realised_pairs(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """a_arm, b_arm, seed, delta of two arms' values (arm, seed): by seed if both have one, else each of one with the other's only one."""
    kind = F.when(F.col("seed").isNull(), "none").otherwise("seed")
    return arm_pairs(a.withColumn("kind", kind), b.withColumn("kind", kind), value)


def schedule(rows: DataFrame, factors: list[str]) -> DataFrame:
    """place, block, the factors, n, missing: every combination of the values that each factor shows, in the factors' order; ``block`` numbers the first factor's.

    Keys are those of the product, whatever occurs together; n counts the rows that do. One row a combination of few levels.
    """
    due = reduce(lambda x, y: x.crossJoin(y), [rows.select(f).distinct() for f in factors])
    seen = rows.groupBy(*factors).agg(F.count(F.lit(1)).alias("seen"))
    everything = Window.orderBy(*factors)
    out = due.join(seen, factors, "left").withColumn("place", F.row_number().over(everything)).withColumn("block", F.dense_rank().over(Window.orderBy(factors[0])))
    return out.select("place", "block", *factors, F.coalesce("seen", F.lit(0).cast("long")).alias("n"), F.col("seen").isNull().alias("missing"))


def variability(pairs: DataFrame) -> DataFrame:
    """a_arm, b_arm: mean, median, range and positive share of the realised differences."""
    return pairs.groupBy("a_arm", "b_arm").agg(
        F.count("delta").alias("n"), F.round(F.avg("delta"), 6).alias("mean"), F.round(F.median("delta"), 6).alias("median"), F.round(F.min("delta"), 6).alias("min"),
        F.round(F.max("delta"), 6).alias("max"), F.round(F.try_divide(F.count_if(F.col("delta") > 0), F.count("delta")), 6).alias("positive_fraction"),
    )


def needed(cells: DataFrame, terms: DataFrame) -> DataFrame:
    """cell_code: every cell that some of the ``terms`` is made of, once."""
    return closure(cells.join(terms.select("cell_code"), "cell_code", "left_semi")).select(F.col("member").alias("cell_code")).distinct()


def above_rounding(contrasts: DataFrame, largest: DataFrame, eps: str = "eps") -> DataFrame:
    """t_ord, n, n_above, signal: whether any contrast is larger than rounding could make it. ``largest`` has one row: size."""
    bound = F.lit(2.0**-52) * F.col("size") * (F.pow(F.lit(2.0), F.col("t_ord")) - 1)
    return contrasts.crossJoin(F.broadcast(largest)).groupBy("t_ord").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(eps) > bound).alias("n_above"), F.max(F.abs(eps) > bound).alias("signal"))


def evaluation(terms: DataFrame) -> DataFrame:
    """regime, t_ord: correlations and squared errors before and after, and how well updates follow what was due.

    Regimes: all terms, those informed by a selection, and of these those that aren't measured whole.
    """
    regimes = F.array_compact(F.array(F.lit("all"), F.when(F.col("informed"), "informed"), F.when(F.expr("informed and not pinned"), "predicted")))
    rows = terms.withColumn("regime", F.explode(regimes)).withColumn("moved", F.col("post_eps") - F.col("prior_eps")).withColumn("due", F.col("truth") - F.col("prior_eps"))
    r = lambda x, y: stats.pearson(F.col(x), F.col(y))
    sse = lambda x: F.round(F.sum(F.pow(F.col(x) - F.col("truth"), 2)), 6)
    return rows.groupBy("regime", "t_ord").agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(r("prior_eps", "truth"), 6).alias("r_prior"), F.round(r("post_eps", "truth"), 6).alias("r_post"),
        F.round(r("post_eps", "truth") - r("prior_eps", "truth"), 6).alias("delta_r"), sse("prior_eps").alias("sse_prior"), sse("post_eps").alias("sse_post"), F.round(r("moved", "due"), 6).alias("update_r"),
    )


def evidence(metrics: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """budget: percentiles over the folds of one method's value less another's, positives, and the verdict that they allow."""
    side = lambda m, name: metrics.where(F.col("method") == m).select("budget", "held", F.col(value).alias(name))
    d = side(first, "a").join(side(second, "b"), ["budget", "held"]).select("budget", F.round(F.col("a") - F.col("b"), 6).alias("d"))
    out = d.groupBy("budget").agg(F.count("d").alias("n"), F.expr("percentile(d, array(0.025, 0.5, 0.975))").alias("q"), F.count_if(F.col("d") > 0).alias("n_positive"))
    out = out.select("budget", "n", *[F.round(F.col("q")[k], 6).alias(c) for k, c in enumerate(("lo", "mid", "hi"))], "n_positive")
    return out.withColumn("verdict", F.when(F.col("n") == 0, "undefined").when(F.col("lo") > 0, "first").when(F.col("hi") < 0, "second").otherwise("open"))


def status(evidence: DataFrame) -> DataFrame:
    """One row: budgets for and against, whether medians reverse their sign, and the status: two budgets must agree."""
    for_, against = F.count_if(F.col("mid") > 0), F.count_if(F.col("mid") < 0)
    turned = (for_ > 0) & (against > 0)
    said = F.when(turned, "mixed").when(for_ >= 2, "for").when(against >= 2, "against").otherwise("open")
    return evidence.agg(F.count(F.lit(1)).alias("n_budgets"), for_.alias("n_for"), against.alias("n_against"), turned.alias("reversed"), said.alias("status"))
