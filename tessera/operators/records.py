"""Whole records of benchmark cells: four learners on what a selection reveals, two controls, and their scores on the held-out fold.

A cell is an estimand (whether coverage counts held-out terms), a regime (whether unmeasured candidates can be selected), a held-out
fold, a method and a budget; all of them are rows of one plan. A fit is a grouped function that gets the plate's rows and nothing
else, so no label of the fold can reach it; its weights are joined to the held-out rows, and labels meet predictions only then.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import stats
from . import learners
from .benchmark import held_out
from .folds import relevance
from .selection import SEED

ESTIMANDS = ("target_blind", "target_aware")
REGIMES = ("attempted_budget", "measured_available")
CELL = ["estimand", "regime", "held", "method", "budget"]
FITTED = ("full", "main_only", "no_triples", "offset")
CONTROLS = ("zero_shot", "circular")
#: Fewer labels than this fit nothing; inner folds of the penalties' search.
LEAST, INNER = 3, 3


def pools(dealt: DataFrame, cells: DataFrame, blind: DataFrame, aware: DataFrame, folds: int) -> DataFrame:
    """estimand, regime, held, method, cell_code, ord, ident, prior, score: who can be selected outside each fold, and by what.

    ``blind`` (held, cell_code, loops) counts terms outside the fold alone, ``aware`` (cell_code, loops) all of them.
    """
    rows = dealt.select("cell_code", "ord", "ident", "prior", "prior_var", "fold").join(cells.select("cell_code", F.col("dg").isNotNull().alias("measured")), "cell_code", "left")
    rows = held_out(rows, folds).where("not inside").join(blind.withColumnRenamed("loops", "b"), ["held", "cell_code"], "left").join(aware.withColumnRenamed("loops", "a"), "cell_code", "left")
    regimes = F.array_compact(F.array(F.lit(REGIMES[0]), F.when(F.col("measured"), F.lit(REGIMES[1]))))
    loops = F.array(*[F.struct(F.lit(e).alias("estimand"), F.coalesce(c, F.lit(0)).cast("double").alias("loops")) for e, c in zip(ESTIMANDS, ("b", "a"))])
    rows = rows.withColumn("regime", F.explode(regimes)).withColumn("e", F.explode(loops)).select("*", "e.*")
    scores = F.array(*[F.struct(F.lit(m).alias("method"), s.alias("score")) for m, s in (("info", F.round(F.col("prior_var") * F.col("loops"), 9)), ("prior", F.col("prior")), ("structural", F.col("loops")))])
    return rows.withColumn("m", F.explode(scores)).select("estimand", "regime", "held", "m.method", "cell_code", "ord", "ident", "prior", "m.score")


def plates(pool: DataFrame, budgets: list[int], seed: str = SEED) -> DataFrame:
    """``CELL``, cell_code, ord, ident, prior, pool_size: what each cell selects. One ranking serves all budgets."""
    keys = ["estimand", "regime", "held", "method"]
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), C.stable_order(seed, F.col("ident")), "ident")
    ranked = pool.withColumn("rank", F.row_number().over(order)).withColumn("pool_size", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    chosen = ranked.where(F.col("rank") <= max(budgets)).withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where("rank <= budget")
    return chosen.select(*CELL, "cell_code", "ord", "ident", "prior", "pool_size")


def _search(x: np.ndarray, y: np.ndarray, order: np.ndarray, offset: np.ndarray | None, fold: np.ndarray, mains: list[float], pairs: list[float]) -> tuple[float, float, bool]:
    """The penalties with the least error over inner folds, equal ones to more shrinkage; the largest if there are too few rows.

    An offset's slope is fitted without the fold that is scored.
    """
    if len(y) < INNER:
        return max(mains), max(pairs), True
    tried = []
    for main in mains:
        for pair in pairs:
            errors, penalty = [], np.where(order == 1, main, pair)
            for f in range(INNER):
                inside, slope = fold == f, 0.0
                z = np.zeros(len(y)) if offset is None else offset
                if offset is not None:
                    slope = _slope(z[~inside], y[~inside])
                b, w = learners.ridge(x[~inside], y[~inside] - slope * z[~inside], penalty)
                errors.append((y[inside] - b - x[inside] @ w - slope * z[inside]) ** 2)
            tried.append((round(float(np.concatenate(errors).mean()), 9), -main, -pair))
    _, main, pair = min(tried)
    return -main, -pair, False


def _slope(x: np.ndarray, y: np.ndarray) -> float:
    """The least-squares slope through the origin; 1 if nothing can be fitted."""
    square = float(x @ x)
    return float(x @ y) / square if square else 1.0


_FIT = "learner string, n_train int, n_doubles int, alpha_main double, alpha_pair double, fell_back boolean, slope double, weights array<struct<col: long, weight: double>>"


def fits(plate: DataFrame, cells: DataFrame, features: DataFrame, mains: list[float], pairs: list[float], salt: str = "inner-1") -> DataFrame:
    """``CELL``, learner, n_train, n_doubles, alpha_main, alpha_pair, fell_back, slope, weights (col -1: the intercept): a row for each learner.

    full: main effects and pairs; main_only: main effects; no_triples: without cells of order 3; offset: what a slope on the prior leaves.
    Of too few labels nothing is fitted: weights are null. A group is a plate, no larger than its budget.
    """
    told = plate.join(cells.select("cell_code", F.col("dg").alias("y")).where("y is not null"), "cell_code")
    long = told.join(features.select(F.col("row").alias("cell_code"), "col", "col_ord"), "cell_code")
    rows = long.groupBy(*CELL, "cell_code").agg(*[F.first(c).alias(c) for c in ("ord", "ident", "prior", "y")], F.collect_list(F.struct("col", "col_ord")).alias("entries"))
    rows = rows.withColumn("turn", C.stable_order(salt, F.col("ident")))

    def fit(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["turn", "ident"])
        out = []
        for name in FITTED:
            own = group[group["ord"] <= 2] if name == "no_triples" else group
            entries = [[(e["col"], e["col_ord"]) for e in row if name != "main_only" or e["col_ord"] == 1] for row in own["entries"]]
            orders = dict(e for row in entries for e in row)
            cols = sorted(orders)
            x, y, prior = np.zeros((len(own), len(cols))), own["y"].to_numpy(dtype=float), own["prior"].to_numpy(dtype=float)
            place = {c: k for k, c in enumerate(cols)}
            for k, row in enumerate(entries):
                x[k, [place[c] for c, _ in row]] = 1.0
            order, fold = np.array([orders[c] for c in cols]), np.arange(len(own)) % INNER
            head = (*keys, name, len(own), int((own["ord"] == 2).sum()))
            if len(own) < LEAST:
                out.append((*head, max(mains), max(pairs), True, 1.0, None))
                continue
            offset = prior if name == "offset" else None
            main, pair, fell = _search(x, y, order, offset, fold, mains, [max(pairs)] if name == "main_only" else pairs)
            slope = _slope(prior, y)
            b, w = learners.ridge(x, y - slope * prior if name == "offset" else y, np.where(order == 1, main, pair))
            out.append((*head, main, pair, fell, slope, [{"col": c, "weight": float(v)} for c, v in zip([-1, *cols], [b, *w])]))
        return pd.DataFrame(out, columns=[*CELL, *(c.split()[0] for c in ("learner", "n_train", "n_doubles", "alpha_main", "alpha_pair", "fell_back", "slope", "weights"))])

    return rows.groupBy(*CELL).applyInPandas(fit, f"estimand string, regime string, held int, method string, budget int, {_FIT}")


def due(dealt: DataFrame, cells: DataFrame, folds: int) -> DataFrame:
    """held, cell_code, ord, ident, prior: the measured cells of each fold, without their labels."""
    inside = held_out(dealt.select("cell_code", "ord", "ident", "prior", "fold"), folds).where("inside")
    return inside.join(cells.where("dg is not null").select("cell_code"), "cell_code", "left_semi").select("held", "cell_code", "ord", "ident", "prior")


def predictions(fitted: DataFrame, rows: DataFrame, features: DataFrame) -> DataFrame:
    """``CELL``, learner, cell_code, ord, ident, pred: each learner's values for the rows of its fold; a column that it never met gives nothing."""
    weights = fitted.where("weights is not null").select(*CELL, "learner", F.inline("weights"))
    bases = weights.where("col = -1").select(*CELL, "learner", F.col("weight").alias("base"))
    slopes = fitted.select(*CELL, "learner", F.when(F.col("learner") == "offset", F.col("slope")).otherwise(0.0).alias("slope"))
    active = rows.join(features.select(F.col("row").alias("cell_code"), "col"), "cell_code").select("held", "cell_code", "col")
    sums = active.join(weights, ["held", "col"]).groupBy(*CELL, "learner", "cell_code").agg(F.sum("weight").alias("sum"))
    out = rows.join(bases.join(slopes, [*CELL, "learner"]), "held").join(sums, [*CELL, "learner", "cell_code"], "left")
    return out.select(*CELL, "learner", "cell_code", "ord", "ident", F.round(F.col("base") + F.coalesce("sum", F.lit(0.0)) + F.col("slope") * F.col("prior"), 9).alias("pred"))


def slopes(plate: DataFrame, cells: DataFrame) -> DataFrame:
    """``CELL``, n, slope: of measure on prior, through the origin, over what each plate reveals."""
    told = plate.join(cells.select("cell_code", "dg").where("dg is not null"), "cell_code", "left")
    return told.groupBy(*CELL).agg(F.count("dg").alias("n"), F.round(stats.slope(F.when(F.col("dg").isNotNull(), F.col("prior")), F.col("dg")), 9).alias("slope"))


def controls(sloped: DataFrame, rows: DataFrame) -> DataFrame:
    """The same for the controls: the prior as it is, and the prior scaled to what is revealed (nothing revealed, no prediction)."""
    told = F.array_compact(F.array(F.struct(F.lit(CONTROLS[0]).alias("learner"), F.lit(1.0).alias("by")), F.when(F.col("n") > 0, F.struct(F.lit(CONTROLS[1]).alias("learner"), F.col("slope").alias("by")))))
    return rows.join(sloped.withColumn("c", F.explode(told)), "held").select(*CELL, "c.learner", "cell_code", "ord", "ident", F.round(F.col("c.by") * F.col("prior"), 9).alias("pred"))


def scores(predicted: DataFrame, cells: DataFrame) -> DataFrame:
    """``CELL``, learner, and its scores against the labels; undefined ones are null.

    Spearman's r by order, their mean and that of all; Pearson's r; the root of the mean squared error; of the best ``budget`` by prediction: nDCG, the share
    that is among the best by label, the best label and what it lacks of the best of all, the share of positive ones, how many orders and ids.
    """
    by = [*CELL, "learner"]
    rows = relevance(predicted.join(cells.select("cell_code", "dg"), "cell_code"), "dg", *by)
    own, best, ideal = (Window.partitionBy(*by).orderBy(F.desc(c), "ident") for c in ("pred", "dg", "relevance"))
    rows = rows.select("*", *[stats.average_rank(c, *by, *o).alias(n) for n, c, o in (("pr", "pred", ["ord"]), ("tr", "dg", ["ord"]), ("ppr", "pred", []), ("ptr", "dg", []))])
    rows = rows.select("*", F.row_number().over(own).alias("mine"), F.row_number().over(best).alias("best"), F.row_number().over(ideal).alias("ideal"))
    of = lambda k: F.round(stats.pearson(F.when(F.col("ord") == k, F.col("pr")), F.when(F.col("ord") == k, F.col("tr"))), 6)
    top = F.col("mine") <= F.col("budget")
    gain = lambda place: F.sum(F.when(F.col(place) <= F.col("budget"), F.col("relevance") / F.log2(F.col(place) + 1)))
    ndcg = F.when(F.max("relevance") == F.min("relevance"), 1.0).otherwise(F.coalesce(F.try_divide(gain("mine"), gain("ideal")), F.lit(0.0)))
    six = lambda c, name: F.round(c, 6).alias(name)
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_eval"), of(2).alias("rho_2"), of(3).alias("rho_3"), six(stats.pearson(F.col("ppr"), F.col("ptr")), "spearman"), six(stats.pearson(F.col("pred"), F.col("dg")), "pearson"),
        six(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("dg"), 2))), "rmse"), six(ndcg, "ndcg"), six(F.count_if(top & (F.col("best") <= F.col("budget"))) / F.count_if(top), "hit_rate"),
        six(F.max(F.when(top, F.col("dg"))), "best_in_top"), six(F.max("dg") - F.max(F.when(top, F.col("dg"))), "regret"), six(F.count_if(top & (F.col("dg") > 0)) / F.count_if(top), "positive_top"),
        F.count_distinct(F.when(top, F.col("ord"))).alias("order_diversity"), F.count_distinct(F.when(top, F.col("ident"))).alias("identity_diversity"),
    )
    return out.withColumn("macro", F.round((F.col("rho_2") + F.col("rho_3")) / 2, 6))


SCORES = ["n_eval", "rho_2", "rho_3", "macro", "spearman", "pearson", "rmse", "ndcg", "hit_rate", "best_in_top", "regret", "positive_top", "order_diversity", "identity_diversity"]


def accounting(plate: DataFrame, cells: DataFrame) -> DataFrame:
    """``CELL``, the pool's size, what is selected and revealed, by order, a digest of the selection, and the labels' kinds."""
    told = plate.join(cells.select("cell_code", "dg"), "cell_code", "left")
    kind = lambda c: F.count_if(c)
    return told.groupBy(*CELL).agg(
        F.first("pool_size").alias("pool_size"), F.count(F.lit(1)).alias("n_selected"), F.sha2(F.array_join(F.array_sort(F.collect_list("ident")), "\n"), 256).alias("selected_digest"), F.count("dg").alias("n_train"),
        *[kind(F.col("ord") == k).alias(f"selected_{k}") for k in (1, 2, 3)], *[kind((F.col("ord") == k) & F.col("dg").isNotNull()).alias(f"train_{k}") for k in (1, 2, 3)],
        kind(F.col("dg") > 0).alias("n_positive"), kind(F.col("dg") == 0).alias("n_zero"), kind(F.col("dg") < 0).alias("n_negative"), kind(F.col("dg").isNull()).alias("n_missing"),
        F.round(F.try_divide(kind(F.col("dg") > 0), F.count("dg")), 6).alias("positive_fraction"),
    )


def records(accounts: DataFrame, fitted: DataFrame, scored: DataFrame) -> DataFrame:
    """A row for each cell: its accounts, the full learner's scores and penalties, and what the other learners and the controls add to them.

    uplift: what pairs add over main effects; transfer: cells of order 3 predicted without any. Where nothing could be fitted the status says so.
    """
    of = lambda learner, c, name: F.max(F.when(F.col("learner") == learner, F.col(c))).alias(name)
    marks = scored.groupBy(*CELL).agg(
        *[of("full", c, c) for c in SCORES], of("main_only", "macro", "main_macro"), of("no_triples", "rho_3", "transfer_rho_3"), of("offset", "macro", "offset_macro"),
        of("zero_shot", "macro", "zero_shot_macro"), of("circular", "macro", "circular_macro"),
    )
    models = fitted.groupBy(*CELL).agg(
        of("full", "alpha_main", "alpha_main"), of("full", "alpha_pair", "alpha_pair"), of("full", "fell_back", "fell_back"), of("main_only", "alpha_main", "main_alpha"), of("offset", "slope", "offset_slope"),
        F.coalesce(F.max(F.when(F.col("learner") == "no_triples", (F.col("n_doubles") < LEAST) | F.col("weights").isNull())), F.lit(True)).alias("transfer_degenerate"),
    )
    out = accounts.join(models, CELL, "left").join(marks, CELL, "left")
    out = out.withColumn("uplift", F.round(F.col("macro") - F.col("main_macro"), 6)).withColumn("offset_slope", F.round("offset_slope", 6))
    return out.withColumn("status", F.when(F.col("n_train") < LEAST, "empty_training").otherwise("ok")).drop("main_macro")


MEANS = ["macro", "rho_2", "rho_3", "spearman", "pearson", "rmse", "ndcg", "hit_rate", "regret", "positive_top", "uplift", "transfer_rho_3", "n_train", "positive_fraction", "circular_macro", "zero_shot_macro", "offset_macro"]


def summaries(rows: DataFrame, means: list[str] = MEANS) -> DataFrame:
    """estimand, regime, method, budget: the cells, and the mean of each figure over those that have it; null if none has."""
    return rows.groupBy("estimand", "regime", "method", "budget").agg(F.count(F.lit(1)).alias("n_cells"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in means])


def random_plates(dealt: DataFrame, folds: int, budgets: list[int], seeds: int, salt: str) -> DataFrame:
    """partition, held, seed, budget, cell_code, prior: a uniform selection for each seed from what is outside the fold. ``dealt`` has partition and fold."""
    rows = held_out(dealt.select("partition", "cell_code", "ident", "prior", "fold"), folds).where("not inside").withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    order = F.sha2(F.concat(F.lit(f"{salt}-"), F.col("seed").cast("string"), F.lit(":"), F.col("ident")), 256)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("partition", "held", "seed").orderBy(order, "ident"))).where(F.col("rank") <= max(budgets))
    return ranked.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where("rank <= budget").select("partition", "held", "seed", "budget", "cell_code", "prior")


def over_seeds(rows: DataFrame, value: str) -> DataFrame:
    """partition, held, budget, n_seeds, n_defined and the mean of ``value`` over the seeds that have one."""
    return rows.groupBy("partition", "held", "budget").agg(F.count(F.lit(1)).alias("n_seeds"), F.count(value).alias("n_defined"), F.round(F.avg(value), 6).alias(f"mean_{value}"))
