"""Candidate lattices, sub-cube closures, and contrasts over them."""

from __future__ import annotations

from functools import reduce
from math import comb
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.landscapes import dimensions


def candidates(cells: DataFrame, max_order: int) -> DataFrame:
    """Every cell of orders 1 to ``max_order`` that the observed levels allow: cell_code, d0.., ord.

    Levels come from the landscape, a few for each dimension; their product is the lattice.
    """
    n = dimensions(cells)
    levels = [cells.select(f"d{k}", f"v{k}", f"w{k}", (F.col(f"d{k}") * F.col(f"r{k}")).alias(f"c{k}")).distinct() for k in range(n)]
    grid = reduce(lambda a, b: a.crossJoin(b), levels)
    order = reduce(add, [(F.col(f"d{k}") > 0).cast("int") for k in range(n)])
    code = reduce(add, [F.col(f"c{k}") for k in range(n)])
    return grid.select(code.alias("cell_code"), *[f"d{k}" for k in range(n)], *[f"v{k}" for k in range(n)], *[f"w{k}" for k in range(n)], order.alias("ord")).where(F.col("ord").between(1, max_order))


def analytic_coverage(n: int, q: int, max_order: int) -> list[tuple[int, int]]:
    """(order, how many candidates of order 2 and up contain a cell of that order) in closed form."""
    return [(k, sum(comb(n - k, j) * (q - 1) ** j for j in range(max_order - k + 1) if k + j >= 2)) for k in range(1, max_order + 1)]


def closure(terms: DataFrame) -> DataFrame:
    """Each cell with all its non-empty sub-cells: term, t_ord, member, m_ord, sign. Codes are summed, nothing is looked up."""
    n = dimensions(terms)
    bit = lambda m, k: F.shiftright(m, k).bitwiseAND(F.lit(1))
    inside: Column = reduce(lambda a, b: a & b, [(bit(F.col("mask"), k) == 0) | (F.col(f"d{k}") > 0) for k in range(n)])
    code = reduce(add, [bit(F.col("mask"), k) * F.col(f"d{k}") * F.col(f"r{k}") for k in range(n)])
    rows = terms.select(F.col("cell_code").alias("term"), F.col("ord").alias("t_ord"), *[f"d{k}" for k in range(n)], *[f"r{k}" for k in range(n)], F.explode(F.sequence(F.lit(1), F.lit(2**n - 1))).alias("mask"))
    order = F.bit_count(F.col("mask"))
    return rows.where(inside).select("term", "t_ord", code.cast("long").alias("member"), order.alias("m_ord"), F.when((F.col("t_ord") - order) % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))


def with_members(terms: DataFrame, values: DataFrame, strict: bool) -> DataFrame:
    """The closure joined with ``values`` (cell_code and whatever else), by member.

    Strict: a member that ``values`` lacks is an error. Else terms that lack one are dropped, never filled in.
    """
    members = closure(terms)
    joined = members.join(values.withColumnRenamed("cell_code", "member"), "member", "left" if strict else "inner")
    if strict:
        there = [c for c in values.columns if c != "cell_code"][0]
        return joined.where(F.assert_true(F.col(there).isNotNull(), F.concat(F.lit("no value for member "), F.col("member").cast("string"))).isNull())
    whole = joined.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.first("t_ord").alias("o")).where(F.col("n") == F.pow(F.lit(2), F.col("o")) - 1).select("term")
    return joined.join(whole, "term", "left_semi")


def contrasts(terms: DataFrame, values: DataFrame, value: str, strict: bool, variance: str | None = None) -> DataFrame:
    """term, t_ord, eps (signed sum over the closure) and, if asked for, sigma2 (plain sum of variances)."""
    rows = with_members(terms, values, strict)
    extra = [F.round(F.sum(variance), 9).alias("sigma2")] if variance else []
    return rows.groupBy("term", "t_ord").agg(F.round(F.sum(F.col("sign") * F.col(value)), 9).alias("eps"), *extra)


def coverage(cells: DataFrame, max_order: int = 3) -> DataFrame:
    """member, loops: in how many terms of orders 2 to ``max_order`` each cell stands."""
    return closure(cells.where(F.col("ord").between(2, max_order))).groupBy("member").agg(F.count(F.lit(1)).alias("loops"))
