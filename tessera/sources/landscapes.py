"""Measure landscapes: fact tables aggregated to one row for each cell of a few categorical dimensions.

A cell is a level of every dimension. Levels are numbered from 0 in their order; level 0 of every
dimension is the reference. ``cell_code`` packs the digits in mixed radix, so the code of a sub-cell is
a sum of some of the terms that make the cell's own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import table

MONEY = "decimal(18,2)"


@dataclass(frozen=True)
class Landscape:
    """``dims``: the columns of the joined facts that are the dimensions. ``regions``: whether both regions are joined."""

    name: str
    dims: tuple[str, ...]
    regions: bool = False


REGISTRY = {
    s.name: s
    for s in (
        Landscape("quad5", ("o_orderpriority", "c_mktsegment", "c_region", "s_region"), regions=True),
        Landscape("mixed225", ("l_returnflag", "o_orderpriority", "c_mktsegment", "o_orderstatus")),
        Landscape("mixed150", ("l_returnflag", "l_linestatus", "o_orderpriority", "c_mktsegment")),
    )
}


def resolve(name: str) -> Landscape:
    if name not in REGISTRY:
        raise ValueError(f"unknown landscape {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name]


def facts(spark: SparkSession, sf_dir: str, spec: Landscape) -> DataFrame:
    """Line items with the dimensions of ``spec``; only the columns in use are read."""
    out = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    if spec.regions:
        nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
        named = lambda p: nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias(f"{p}_nation"), F.col("r_name").alias(f"{p}_region"))
        out = (
            out.join(named("c"), F.col("c_nationkey") == F.col("c_nation"))
            .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(named("s"), F.col("s_nationkey") == F.col("s_nation"))
        )
    return out.select(*spec.dims, "l_linenumber", "l_extendedprice", "l_quantity")


def cells(base: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """One row per cell: v0.. the levels, n_rows, the mean price and quantity, and the spread of the log quantity over line numbers.

    Sums are exact decimals, so that no order of addition shows. Rows are aggregated by line number first and then
    to cells, so the second step sees a few rows for each cell.
    """
    by_line = base.groupBy(*dims, "l_linenumber").agg(
        F.sum(F.col("l_extendedprice").cast(MONEY)).alias("price"), F.sum(F.col("l_quantity").cast(MONEY)).alias("qty"), F.count(F.lit(1)).alias("n")
    )
    out = by_line.groupBy(*dims).agg(
        F.sum("n").alias("n_rows"),
        (F.sum("price").cast("double") / F.sum("n")).alias("price"),
        (F.sum("qty").cast("double") / F.sum("n")).alias("qty"),
        F.var_pop(F.ln(F.col("qty").cast("double") / F.col("n"))).alias("spread"),
    )
    return out.select(*[F.col(d).alias(f"v{k}") for k, d in enumerate(dims)], "n_rows", "price", "qty", "spread")


def _sum(columns: list[Column]) -> Column:
    return reduce(add, columns)


def encode(table_: DataFrame, n_dims: int) -> DataFrame:
    """Adds digits d0.., radices r0.., cell_code and ord. The table has a row per cell, so one window over it is small."""
    digits = table_.select("*", *[(F.dense_rank().over(Window.orderBy(f"v{k}")) - 1).alias(f"d{k}") for k in range(n_dims)])
    sizes = digits.agg(*[(F.max(f"d{k}") + 1).cast("long").alias(f"q{k}") for k in range(n_dims)])
    out = digits.crossJoin(sizes)
    for k in range(n_dims):
        out = out.withColumn(f"r{k}", reduce(lambda a, j: a * F.col(f"q{j}"), range(k), F.lit(1).cast("long")))
    return out.withColumn("cell_code", _sum([F.col(f"d{k}") * F.col(f"r{k}") for k in range(n_dims)])).withColumn(
        "ord", _sum([(F.col(f"d{k}") > 0).cast("int") for k in range(n_dims)])
    )


def centre_log(value: str, reference: Column) -> Column:
    """``ln(value) - ln(reference)`` to nine digits; null for a value that has no logarithm."""
    return F.when(F.col(value) > 0, F.round(F.ln(value) - F.ln(reference), 9))


def build(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """cell_code, d0.., r0.., v0.., w0.. (reference levels), ord, n_rows, measure, dg (centred log measure), prior, prior_var.

    The prior is the centred log of another measure, and its variance the spread of that over line numbers.
    """
    spec = resolve(name)
    n = len(spec.dims)
    coded = encode(cells(facts(spark, sf_dir, spec), spec.dims), n)
    reference = coded.where("cell_code = 0").select(F.col("price").alias("price0"), F.col("qty").alias("qty0"), *[F.col(f"v{k}").alias(f"w{k}") for k in range(n)])
    out = coded.crossJoin(reference)
    return out.select(
        "cell_code", *[f"d{k}" for k in range(n)], *[f"r{k}" for k in range(n)], *[f"v{k}" for k in range(n)], *[f"w{k}" for k in range(n)], "ord", "n_rows",
        F.round("price", 6).alias("measure"), centre_log("price", F.col("price0")).alias("dg"), centre_log("qty", F.col("qty0")).alias("prior"), F.round("spread", 9).alias("prior_var"),
    ).coalesce(1)


_known: dict[tuple[str, str, str], DataFrame] = {}


def landscape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The landscape, kept in memory for the session: a row per cell, however many facts there are."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _known:
        _known[key] = build(spark, sf_dir, name).persist()
    return _known[key]


def dimensions(cells_: DataFrame) -> int:
    return sum(c.startswith("d") and c[1:].isdigit() for c in cells_.columns)
