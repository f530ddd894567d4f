"""Append-only journals: an ordered fold of events into a state, and its replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(events: DataFrame, run: str, seq: str, kind: str, allowed: dict[str, list[str]]) -> DataFrame:
    """``run``, n_events, last_kind, n_illegal: each run's events folded in their order.

    ``allowed`` has, for each kind, the kinds that may follow; the empty kind stands for the start. A journal is
    as long as one run, so its events are gathered for the fold.
    """
    rules = F.array(*[F.lit(f"{a}>{b}") for a, follow in allowed.items() for b in follow])
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(kind).alias("kind"))))
    start = F.struct(F.lit("").alias("kind"), F.lit(0).alias("bad"))
    step = lambda s, e: F.struct(e["kind"].alias("kind"), (s["bad"] + F.when(F.array_contains(rules, F.concat(s["kind"], F.lit(">"), e["kind"])), 0).otherwise(1)).alias("bad"))
    folded = events.groupBy(run).agg(ordered.alias("events"))
    return folded.select(run, F.size("events").alias("n_events"), F.aggregate("events", start, step).alias("s")).select(run, "n_events", F.col("s.kind").alias("last_kind"), F.col("s.bad").alias("n_illegal"))
