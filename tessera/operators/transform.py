"""The orthonormal multi-level transform of a complete landscape, and kernels on cells."""

from __future__ import annotations

from functools import reduce
from math import sqrt
from operator import add, mul

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.landscapes import dimensions


def helmert(q: int) -> list[list[float]]:
    """An orthonormal basis whose first row is constant and whose row k sets level k against those before it."""
    rows = [[1 / sqrt(q)] * q]
    for k in range(1, q):
        s = sqrt(k * (k + 1))
        rows.append([1 / s] * k + [-k / s] + [0.0] * (q - k - 1))
    return rows


def complete(cells: DataFrame) -> DataFrame:
    """``cells``, or an error if a combination of the observed levels is missing: holes are never filled."""
    n = dimensions(cells)
    wanted = reduce(mul, [F.max(f"d{k}") + 1 for k in range(n)])
    audit = cells.agg((F.count(F.lit(1)) == wanted).alias("whole"))
    return cells.crossJoin(audit).where(F.assert_true("whole", F.lit("the landscape has holes")).isNull()).drop("whole")


def coefficients(cells: DataFrame, value: str) -> DataFrame:
    """k0.., ord, coef: one contraction for each dimension, each a join with a small basis and a sum."""
    n, spark = dimensions(cells), cells.sparkSession
    sizes = cells.agg(*[(F.max(f"d{k}") + 1).alias(f"q{k}") for k in range(n)]).first()
    out = complete(cells).select(*[f"d{k}" for k in range(n)], F.col(value).alias("x"))
    for k in range(n):
        basis = spark.createDataFrame([(j, i, b) for i, row in enumerate(helmert(sizes[k])) for j, b in enumerate(row)], f"d{k} int, k{k} int, b double")
        done = [f"k{j}" for j in range(k + 1)] + [f"d{j}" for j in range(k + 1, n)]
        out = out.join(F.broadcast(basis), f"d{k}").groupBy(*done).agg(F.sum(F.col("b") * F.col("x")).alias("x"))
    order = reduce(add, [(F.col(f"k{k}") > 0).cast("int") for k in range(n)])
    return out.select(*[f"k{k}" for k in range(n)], order.alias("ord"), F.round("x", 9).alias("coef"))


def rebuilt(coefs: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    """cell_code and the value that the coefficients give each of ``cells``: one contraction for each dimension, back from modes to levels."""
    n, spark = dimensions(cells), cells.sparkSession
    sizes = coefs.agg(*[(F.max(f"k{k}") + 1).alias(f"q{k}") for k in range(n)]).first()
    out = coefs.select(*[f"k{k}" for k in range(n)], F.col("coef").alias("x"))
    for k in range(n):
        basis = spark.createDataFrame([(j, i, b) for i, row in enumerate(helmert(sizes[k])) for j, b in enumerate(row)], f"d{k} int, k{k} int, b double")
        done = [f"d{j}" for j in range(k + 1)] + [f"k{j}" for j in range(k + 1, n)]
        out = out.join(F.broadcast(basis), f"k{k}").groupBy(*done).agg(F.sum(F.col("b") * F.col("x")).alias("x"))
    return cells.select("cell_code", *[f"d{k}" for k in range(n)]).join(out.withColumnRenamed("x", name), [f"d{k}" for k in range(n)]).select("cell_code", name)


def spectrum(coefs: DataFrame) -> DataFrame:
    """ord, n_modes, energy (mean square over cells), share of the variance; the energies of orders over 0 add up to the variance."""
    everything = Window.partitionBy()
    per = coefs.groupBy("ord").agg(F.count(F.lit(1)).alias("n_modes"), F.sum(F.pow("coef", 2)).alias("e"))
    total = F.sum(F.when(F.col("ord") > 0, F.col("e"))).over(everything)
    n = F.sum("n_modes").over(everything)
    return per.select("ord", "n_modes", F.round(F.col("e") / n, 9).alias("energy"), F.round(F.when(F.col("ord") > 0, F.try_divide(F.col("e"), total)), 6).alias("share"))


def effective_counts(coefs: DataFrame, shares: list[float]) -> DataFrame:
    """share, n: how few coefficients carry that share of the energy."""
    w = Window.orderBy(F.desc("e"), "k0", "k1", "k2", "k3").rowsBetween(Window.unboundedPreceding, 0)
    rows = coefs.where("ord > 0").withColumn("e", F.pow("coef", 2)).select("e", F.sum("e").over(w).alias("upto"), F.row_number().over(Window.orderBy(F.desc("e"), "k0", "k1", "k2", "k3")).alias("rn"), F.sum("e").over(Window.partitionBy()).alias("total"))
    return rows.select(F.explode(F.array(*map(F.lit, shares))).alias("share"), "upto", "total", "rn").where("upto >= share * total - 1e-12").groupBy("share").agg(F.min("rn").alias("n"))


#: A landscape's energies differ by rounding alone up to this share; a variance below the second is none.
SAME, FLAT = 1e-6, 1e-12


def diagnosis(coefs: DataFrame, cells: DataFrame, value: str) -> DataFrame:
    """One row: cells, mean square, variance, whether values and modes hold the same energy, the variance's shares up to orders 1 and 2, whether it is flat.

    Of a flat landscape the shares are null.
    """
    square = lambda upto: F.sum(F.when(F.col("ord").between(1, upto), F.pow("coef", 2)))
    e = coefs.agg(F.sum(F.pow("coef", 2)).alias("e"), F.coalesce(F.sum(F.when(F.col("ord") > 0, F.pow("coef", 2))), F.lit(0.0)).alias("v"), square(1).alias("one"), square(2).alias("two"))
    s = cells.agg(F.sum(F.pow(value, 2)).alias("s"), F.count(F.lit(1)).alias("n_cells"), F.var_pop(value).alias("var"))
    flat = F.col("v") / F.col("n_cells") <= FLAT
    share = lambda c: F.when(~flat, F.round(F.try_divide(F.col(c), F.col("v")), 6))
    return e.crossJoin(s).select(
        "n_cells", F.round(F.col("e") / F.col("n_cells"), 6).alias("mean_square"), F.round("var", 6).alias("variance"), (F.abs(F.col("e") - F.col("s")) <= SAME * F.col("s")).alias("whole"),
        share("one").alias("share_1"), share("two").alias("share_2"), flat.alias("flat"),
    )


def magnitude_quantiles(coefs: DataFrame) -> DataFrame:
    """ord, q50, q90, q99, max of the absolute coefficients."""
    q = F.expr("percentile(abs(coef), array(0.5, 0.9, 0.99))")
    return coefs.where("ord > 0").groupBy("ord").agg(q.alias("q"), F.max(F.abs("coef")).alias("m")).select("ord", *[F.round(F.col("q")[k], 6).alias(c) for k, c in enumerate(("q50", "q90", "q99"))], F.round("m", 6).alias("max"))


def order_kernels(left: DataFrame, right: DataFrame, n: int, q: int | list[int]) -> DataFrame:
    """u, v, k1, k2: the sums of products of characters of orders 1 and 2, for all pairs of two stated sets of cells.

    ``q`` is the number of levels of every dimension, or of each. A dimension gives (1 if equal else 0) - 1/q; the order-2 kernel is the second elementary symmetric
    polynomial of those, so no mode is ever written out.
    """
    u = left.select(F.col("cell_code").alias("u"), *[F.col(f"d{k}").alias(f"a{k}") for k in range(n)])
    v = right.select(F.col("cell_code").alias("v"), *[F.col(f"d{k}").alias(f"b{k}") for k in range(n)])
    z = [F.when(F.col(f"a{k}") == F.col(f"b{k}"), 1.0).otherwise(0.0) - 1.0 / (q if isinstance(q, int) else q[k]) for k in range(n)]
    first, squares = reduce(add, z), reduce(add, [x * x for x in z])
    return u.crossJoin(v).select("u", "v", F.round(first, 9).alias("k1"), F.round((first * first - squares) / 2, 9).alias("k2"))


def features(cells: DataFrame) -> DataFrame:
    """row, col: the non-zero entries of the design of main effects and pairs, for every cell; col names the sub-cell."""
    from .lattice import closure

    return closure(cells.where("ord > 0")).where("m_ord <= 2").select(F.col("term").alias("row"), F.col("member").alias("col"), F.col("m_ord").alias("col_ord"))


def predict(design: DataFrame, weights: DataFrame, intercept: float = 0.0) -> DataFrame:
    """row, pred: the intercept and the sum of the weights of each row's columns; unknown columns give nothing."""
    return design.join(weights, "col", "left").groupBy("row").agg(F.round(F.lit(intercept) + F.sum(F.coalesce("weight", F.lit(0.0))), 9).alias("pred"))
