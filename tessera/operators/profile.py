"""A table's profile as one nested row, the same in any order of its rows."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(rows: DataFrame, dims: list[str], key: str, label: Column, positive: Column) -> DataFrame:
    """``p``: n_rows, levels (by dimension: level and n, sorted), n_cells and whether each combination of levels occurs, labels, keys.

    One scan: each row is counted in the grouping sets of the whole, each dimension, all dimensions together, and the key. Levels come
    together in one row, so dimensions are those of few levels; keys are only counted. An empty table has zero rows and no levels.
    """
    held = rows.select(*dims, F.col(key).alias("_key"), label.cast("decimal(18,2)").alias("_label"), positive.alias("_positive"))
    sets = [list(s) for s in dict.fromkeys([(), *((d,) for d in dims), tuple(dims), ("_key",)])]
    counted = held.groupingSets(sets, *dims, "_key").agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"), F.count("_label").alias("n_labels"), F.count_if("_positive").alias("n_positive"), F.min("_label").alias("least"), F.max("_label").alias("largest"), F.sum("_label").alias("total"),
    )
    # a bit of the id is set for each column that a set leaves out, the first column's highest
    width = len(dims) + 1
    of = lambda present: F.col("_set") == sum(1 << (width - 1 - k) for k, c in enumerate([*dims, "_key"]) if c not in present)
    levels = F.struct(*[F.array_sort(F.collect_list(F.when(of([d]), F.struct(F.col(d).cast("string").alias("level"), "n")))).alias(d) for d in dims])
    whole = lambda c: F.max(F.when(of([]), F.col(c)))
    out = counted.agg(
        F.coalesce(whole("n"), F.lit(0).cast("long")).alias("n_rows"), levels.alias("levels"), F.count_if(of(dims)).alias("n_cells"),
        F.struct(whole("n_labels").alias("n_labels"), whole("n_positive").alias("n_positive"), whole("least").cast("double").alias("least"), whole("largest").cast("double").alias("largest"), F.try_divide(whole("total").cast("double"), whole("n_labels")).alias("mean")).alias("labels"),
        F.struct(F.count_if(of(["_key"])).alias("n_keys"), F.count_if(of(["_key"]) & (F.col("n") > 1)).alias("n_repeated_keys"), F.max(F.when(of(["_key"]), F.col("n"))).alias("most_of_a_key")).alias("keys"),
    )
    complete = F.col("n_cells") == reduce(mul, [F.size(f"levels.{d}") for d in dims])
    return out.select(F.struct("n_rows", "levels", "n_cells", complete.alias("complete"), "labels", "keys").alias("p"))
