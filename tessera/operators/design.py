"""Designs over pools of any size, and normal equations of plates with any number of labels.

A design is chosen one cell after another, each where the posterior variance of a Gaussian prior on the landscape's
modes is largest. The pool stays a table: a step reads the largest row, and the update is a join with what was picked, one row.
The normal equations are sums over a design's rows, so a solver gets a number for each pair of columns, however many rows there are.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.landscapes import dimensions
from ..sources.tables import kept

#: Variance of what is measured.
NOISE = 1e-2
#: Picks that are applied anew in every step before they are written into the table.
PICKS_AT_ONCE = 16


def mode_kernel(same: list[Column], sizes: list[int], orders: tuple[int, ...]) -> Column:
    """The prior covariance of two cells, given whether they agree in each dimension: the sum over the modes of ``orders``.

    Modes are orthonormal: a dimension that takes part gives its agreement less 1/q, the others 1/q each.
    """
    zero, total = F.lit(0.0), [F.lit(1.0)]
    for agree, q in zip(same, sizes):
        z = F.when(agree, 1.0 - 1.0 / q).otherwise(-1.0 / q)
        total = [F.lit(1.0 / q) * (total[o] if o < len(total) else zero) + (z * total[o - 1] if o else zero) for o in range(len(total) + 1)]
    return reduce(add, [total[o] for o in orders])


def own_variance(sizes: list[int], orders: tuple[int, ...]) -> float:
    """The kernel of a cell with itself."""
    total = np.array([1.0])
    for q in sizes:
        total = np.convolve(total, [1.0 / q, 1.0 - 1.0 / q])
    return float(sum(total[o] for o in orders))


def d_optimal(cells: DataFrame, pool: DataFrame, budget: int, targets: dict[str, tuple[int, ...]], noise: float = NOISE) -> DataFrame:
    """target, rank, cell_code, variance: for each target's orders of modes, ``budget`` cells of ``pool`` (cell_code, ident), best first.

    A cell's variance is that before it is measured; equal ones, to nine digits, go by id. A shorter budget's design is the beginning of
    a longer one's. Labels are never read. A pool with fewer cells is taken whole.
    """
    n, spark = dimensions(cells), cells.sparkSession
    sizes = list(cells.agg(*[(F.max(f"d{k}") + 1).alias(f"q{k}") for k in range(n)]).first())
    start = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(own_variance(sizes, orders)).alias("prior")) for t, orders in targets.items()])
    rows = pool.select("cell_code", "ident").join(cells.select("cell_code", F.array(*[f"d{k}" for k in range(n)]).alias("digits")), "cell_code")
    rows = rows.select("cell_code", "ident", "digits", F.explode(start).alias("t")).select("t.*", "cell_code", "ident", "digits", F.array().cast("array<double>").alias("u"), F.lit(True).alias("open"))
    rows, picks, out = kept(rows), [], []
    schema = "p_target string, picks array<struct<code: long, digits: array<int>, u: array<double>, scale: double>>"

    def kernel(p: Column) -> Column:
        same = [F.get("digits", F.lit(k)) == F.get(p["digits"], F.lit(k)) for k in range(n)]
        return reduce(lambda a, t: a.when(F.col("target") == t, mode_kernel(same, sizes, targets[t])), targets, F)

    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def applied() -> DataFrame:
        """The table after the picks that aren't written into it yet."""
        if not picks:
            return rows
        told = spark.createDataFrame([(t, [p[1] for p in picks if p[0] == t]) for t in targets], schema)
        both = rows.join(F.broadcast(told), F.col("target") == F.col("p_target"))
        u = F.aggregate("picks", F.col("u"), lambda u, p: F.concat(u, F.array((kernel(p) - dot(u, p["u"])) / p["scale"])))
        return both.select("target", "prior", "cell_code", "ident", "digits", u.alias("u"), (F.col("open") & ~F.exists("picks", lambda p: p["code"] == F.col("cell_code"))).alias("open"))

    for rank in range(1, budget + 1):
        now = applied()
        variance = F.greatest(F.col("prior") - dot(F.col("u"), F.col("u")), F.lit(0.0))
        best = F.min(F.struct((-F.round(variance, 9)).alias("less"), "ident", "cell_code", "digits", "u", variance.alias("variance")))
        found = now.where("open").groupBy("target").agg(best.alias("b")).collect()
        if not found:
            break
        if len(picks) >= PICKS_AT_ONCE * len(targets):
            rows, picks = kept(now), []
        for r in found:
            picks.append((r.target, (r.b.cell_code, r.b.digits, r.b.u, float(np.sqrt(noise + r.b.variance)))))
            out.append((r.target, rank, r.b.cell_code, round(r.b.variance, 6)))
    return spark.createDataFrame(out, "target string, rank int, cell_code long, variance double")


#: Columns that stand for the intercept and for the label in the normal equations.
ONE, LABEL = -1, -2


def gram(design: DataFrame, by: list[str]) -> DataFrame:
    """``by``, i, j, g: for each two columns, i <= j, the sum over rows of their products; ``design`` has ``by``, row, col, y.

    Non-zero entries are ones. Columns ``ONE`` and ``LABEL`` stand for the intercept and for y; a row without columns has no part in it.
    """
    entry = F.struct(F.col("col").cast("long").alias("c"), F.lit(1.0).alias("x"))
    ends = [F.struct(F.lit(ONE).cast("long").alias("c"), F.lit(1.0).alias("x")), F.struct(F.lit(LABEL).cast("long").alias("c"), F.first("y").alias("x"))]
    # the few columns of a row meet inside it
    rows = design.groupBy(*by, "row").agg(F.collect_list(entry).alias("own"), F.array(*ends).alias("ends")).select(*by, F.concat("own", "ends").alias("e"))
    pairs = rows.select(*by, F.explode("e").alias("a"), "e").select(*by, "a", F.explode("e").alias("b")).where("a.c <= b.c")
    return pairs.groupBy(*by, F.col("a.c").alias("i"), F.col("b.c").alias("j")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("g"))


def square(entries: pd.DataFrame, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float, float]:
    """Products of ``columns``, their sums, their products with the label, the label's square, its sum, and the rows."""
    names = np.concatenate([[LABEL, ONE], columns])
    place = {c: k for k, c in enumerate(names.tolist())}
    g = np.zeros((len(names), len(names)))
    i, j = (entries[c].map(place).to_numpy() for c in ("i", "j"))
    g[i, j] = g[j, i] = entries["g"].to_numpy()
    return g[2:, 2:], g[2:, 1], g[2:, 0], g[0, 0], g[0, 1], g[1, 1]


def ridge_from_gram(xx: np.ndarray, x: np.ndarray, xy: np.ndarray, y: float, n: float, penalty: np.ndarray) -> tuple[float, np.ndarray]:
    """Ridge with a penalty for each column and a free intercept, from sums over rows."""
    weights = np.linalg.solve(xx - np.outer(x, x) / n + np.diag(penalty), xy - x * y / n)
    return float((y - x @ weights) / n), weights


def squared_error(xx: np.ndarray, x: np.ndarray, xy: np.ndarray, yy: float, y: float, n: float, intercept: float, weights: np.ndarray) -> float:
    """The sum of squared errors of a fit over rows, from sums over them."""
    return float(yy - 2 * intercept * y - 2 * weights @ xy + n * intercept**2 + 2 * intercept * (weights @ x) + weights @ xx @ weights)


def blup_from_gram(xx: np.ndarray, xy: np.ndarray, yy: float, n: float, grid: np.ndarray) -> tuple[float, np.ndarray]:
    """Random effects by ridge without an intercept, the ratio of variances by generalised cross-validation; an infinite one means no effect."""
    s2, v = np.linalg.eigh(xx)
    there = s2 > s2.max(initial=0.0) * 1e-12
    s2, v = s2[there], v[:, there]
    told, best = v.T @ xy, (np.inf, np.inf, np.zeros(len(xx)))
    for ratio in grid:
        shrink = np.zeros(len(s2)) if np.isinf(ratio) else s2 / (s2 + ratio)
        rest = yy - ((2 * shrink - shrink**2) * told**2 / s2).sum()
        error = rest * n / max(n - shrink.sum(), 1e-9) ** 2
        if error < best[0] - 1e-12 * abs(yy):
            best = (error, float(ratio), np.zeros(len(xx)) if np.isinf(ratio) else v @ (told / (s2 + ratio)))
    return best[1], best[2]


def column_orders(design: DataFrame, by: list[str]) -> DataFrame:
    """``by``, i, col_ord: the orders of the columns in use, for their penalties."""
    return design.groupBy(*by, F.col("col").cast("long").alias("i")).agg(F.first("col_ord").alias("col_ord"))


def cross_validated(design: DataFrame, by: list[str], mains: list[float], pairs: list[float]) -> DataFrame:
    """``by``, alpha_main, alpha_pair, mse: the penalties with the least error over ``fold``, from each fold's normal equations.

    Equal errors, to nine digits, go to more shrinkage. A fold's model is that of the sums without it.
    """
    sums = gram(design, [*by, "fold"]).join(column_orders(design, by), [*by, "i"], "left")
    tried = reduce(lambda df, kv: df.withColumn(kv[0], F.explode(F.array(*map(F.lit, kv[1])))), {"alpha_main": mains, "alpha_pair": pairs}.items(), sums)

    def held_out(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own = group.dropna(subset=["col_ord"]).drop_duplicates("i").sort_values("i")
        columns, penalty = own["i"].to_numpy(), np.where(own["col_ord"] == 1, keys[-2], keys[-1])
        parts = [square(g, columns) for _, g in group.groupby("fold")]
        whole = [reduce(add, p) for p in zip(*parts)]
        error = 0.0
        for part in parts:
            xx, x, xy, _, y, n = (w - p for w, p in zip(whole, part))
            error += squared_error(*part, *ridge_from_gram(xx, x, xy, y, n, penalty))
        return pd.DataFrame([(*keys, round(error / whole[5], 9))], columns=[*by, "alpha_main", "alpha_pair", "mse"])

    kinds = ", ".join(f"{c} {dict(design.dtypes)[c]}" for c in by)
    errors = tried.groupBy(*by, "alpha_main", "alpha_pair").applyInPandas(held_out, f"{kinds}, alpha_main double, alpha_pair double, mse double")
    best = F.struct("mse", -F.col("alpha_main"), -F.col("alpha_pair"))
    return errors.groupBy(*by).agg(F.min_by(F.struct("alpha_main", "alpha_pair", "mse"), best).alias("b")).select(*by, "b.*")


def weights(design: DataFrame, by: list[str], chosen: DataFrame) -> DataFrame:
    """``by``, col, weight: of each plate at its ``chosen`` penalties; column ``ONE`` has the intercept."""
    sums = gram(design, by).join(column_orders(design, by), [*by, "i"], "left").join(F.broadcast(chosen), by)

    def fit(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own = group.dropna(subset=["col_ord"]).drop_duplicates("i").sort_values("i")
        columns = own["i"].to_numpy()
        xx, x, xy, _, y, n = square(group, columns)
        b, w = ridge_from_gram(xx, x, xy, y, n, np.where(own["col_ord"] == 1, group["alpha_main"].iloc[0], group["alpha_pair"].iloc[0]))
        out = pd.DataFrame({"col": np.append(columns, ONE), "weight": np.round(np.append(w, b), 9)})
        for k, c in enumerate(by):
            out.insert(k, c, keys[k])
        return out

    kinds = ", ".join(f"{c} {dict(design.dtypes)[c]}" for c in by)
    return sums.groupBy(*by).applyInPandas(fit, f"{kinds}, col long, weight double")


def random_effects(design: DataFrame, by: list[str], grid: np.ndarray) -> DataFrame:
    """``by``, ratio (null for none), col, effect: effects of the columns, the ratio of variances chosen from ``grid``."""

    def fit(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        columns = np.unique(group["j"][group["j"] >= 0])
        xx, _, xy, yy, _, n = square(group, columns)
        ratio, effect = blup_from_gram(xx, xy, yy, n, grid)
        out = pd.DataFrame({"ratio": None if np.isinf(ratio) else round(ratio, 9), "col": columns, "effect": np.round(effect, 9)})
        for k, c in enumerate(by):
            out.insert(k, c, keys[k])
        return out

    kinds = ", ".join(f"{c} {dict(design.dtypes)[c]}" for c in by)
    return gram(design, by).groupBy(*by).applyInPandas(fit, f"{kinds}, ratio double, col long, effect double")
