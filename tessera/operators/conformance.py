"""Configurations of runs against a protocol, and the status that is left when every defect has been looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivoted(configs: DataFrame, run: str, fields: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """``run``, field, observed, size: a row for each field. Ordered lists are told in their order, sets sorted; ``size`` is how large a scale is."""
    rows = [F.struct(F.lit(f).alias("field"), told.cast("string").alias("observed"), (F.lit(None) if size is None else size).cast("int").alias("size")) for f, (told, size) in fields.items()]
    return configs.select(run, F.explode(F.array(*rows)).alias("f")).select(run, "f.*")


def compared(configs: DataFrame, protocol: DataFrame, run: str) -> DataFrame:
    """``run``, mismatches (sorted names), conforming, smaller (whether all that differs is a scale below the protocol's).

    ``protocol`` has field, expected, expected_size (null unless the field is a scale): a row for each field, so it is small. A field that a run lacks, or that is null, differs unless null is expected;
    nothing is ever coerced.
    """
    due = configs.select(run).distinct().crossJoin(F.broadcast(protocol))
    both = due.join(configs, [run, "field"], "left")
    off = ~F.col("observed").eqNullSafe(F.col("expected"))
    smaller = F.coalesce(F.col("size") < F.col("expected_size"), F.lit(False))
    told = both.groupBy(run).agg(F.array_sort(F.collect_list(F.when(off, F.col("field")))).alias("names"), F.bool_and(~off | smaller).alias("smaller"))
    return told.select(run, F.array_join("names", ",").alias("mismatches"), (F.size("names") == 0).alias("conforming"), (F.col("smaller") & (F.size("names") > 0)).alias("smaller"))


def status(own: Column) -> Column:
    """The status of a run, from conforming, smaller, n_missing, n_repeated and its own verdict.

    A configuration that differs comes first: a smaller scale with whole records is a trial, all else nonconforming. Then records that repeat, then those that are missing.
    """
    whole = (F.col("n_missing") == 0) & (F.col("n_repeated") == 0)
    return (
        F.when(~F.col("conforming"), F.when(F.col("smaller") & whole, "smoke_or_exploratory_profile").otherwise("nonconforming_protocol_profile"))
        .when(F.col("n_repeated") > 0, "nonconforming_protocol_profile").when(F.col("n_missing") > 0, "insufficient_valid_partitions").otherwise(own)
    )
