"""Run journals of eight kinds of events: which may follow which, and the state that a run's events fold into.

A run is prepared once, then designed step by step, its selection is published, and cell by cell is fitted fold by fold and closed;
attempts to execute it start and complete, and a report ends it. Events are numbered from 0 within their run; only those without a gap before them
count. The first event that may not stand where it does fails the run, and nothing after it counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("prepared", "attempt_started", "attempt_completed", "design", "selection", "fit", "cell", "report")


@dataclass(frozen=True)
class Protocol:
    """What a whole run has: design steps before the selection, cells, and folds of each cell's fit."""

    design_steps: int
    cells: int
    folds: int


#: Numbers and flags of a run's state, all zero at the start.
FIELDS = ("n_applied", "prepared", "design", "selected", "folds", "cells", "attempts", "abandoned", "open", "completed", "reported")


def _rules(p: Protocol) -> list[tuple[str, str]]:
    """(condition, message), the first that holds fails the event; over ``kind`` and the fields, in words that SQL and Python share."""
    return [
        ("reported = 1", "an event follows the report"),
        ("kind = 'prepared' and n_applied > 0", "the run is prepared already"),
        ("kind <> 'prepared' and prepared = 0", "the run is not prepared"),
        ("kind = 'attempt_started' and completed = 1", "an attempt starts after completion"),
        ("kind = 'attempt_completed' and open = 0", "no attempt is open"),
        (f"kind = 'attempt_completed' and (cells < {p.cells} or folds > 0)", "an attempt completes before its cells"),
        ("kind in ('design', 'selection', 'fit', 'cell') and completed = 1", "only the report may follow completion"),
        ("kind = 'design' and selected = 1", "a design step follows the selection"),
        (f"kind = 'design' and design >= {p.design_steps}", "the design is complete"),
        ("kind = 'selection' and selected = 1", "the selection is published already"),
        (f"kind = 'selection' and design < {p.design_steps}", "the design is not complete"),
        ("kind in ('fit', 'cell', 'report') and selected = 0", "the selection is not published"),
        (f"kind in ('fit', 'cell') and cells >= {p.cells}", "all cells are closed"),
        (f"kind = 'fit' and folds >= {p.folds}", "the fit has all its folds"),
        (f"kind = 'cell' and folds < {p.folds}", "a cell closes before its fit"),
        (f"kind = 'report' and cells < {p.cells}", "the report comes before its cells"),
        ("kind = 'report' and completed = 0", "no attempt has completed"),
    ]


#: What a legal event makes of each field, in the same words.
_CHANGES = {
    "n_applied": "n_applied + 1",
    "prepared": "case when kind = 'prepared' then 1 else prepared end",
    "design": "case when kind = 'design' then design + 1 else design end",
    "selected": "case when kind = 'selection' then 1 else selected end",
    "folds": "case when kind = 'fit' then folds + 1 when kind = 'cell' then 0 else folds end",
    "cells": "case when kind = 'cell' then cells + 1 else cells end",
    "attempts": "case when kind = 'attempt_started' then attempts + 1 else attempts end",
    "abandoned": "case when kind = 'attempt_started' then abandoned + open else abandoned end",
    "open": "case when kind = 'attempt_started' then 1 when kind = 'attempt_completed' then 0 else open end",
    "completed": "case when kind = 'attempt_completed' then 1 else completed end",
    "reported": "case when kind = 'report' then 1 else reported end",
}


def error_sql(p: Protocol) -> str:
    """Why an event of ``kind`` may not follow a state of ``FIELDS``; empty if it may."""
    known = ", ".join(f"'{k}'" for k in KINDS)
    return f"case when coalesce(kind, '') not in ({known}) then 'an event of unknown kind' " + " ".join(f"when {c} then '{m}'" for c, m in _rules(p)) + " else '' end"


def changes_sql() -> dict[str, str]:
    """The fields after a legal event of ``kind``."""
    return dict(_CHANGES)


def status(error: Column, reported: Column, waiting: Column) -> Column:
    return F.when(error != "", "failed").when(reported == 1, "reported").when(waiting > 0, "waiting").otherwise("open")


def _inside(expression: str) -> str:
    """The expression over ``s`` (a state) and ``e`` (an event) in place of plain names; what stands in quotes is left alone."""
    names = re.compile(rf"\b(?:({'|'.join(FIELDS)})|(kind))\b")
    parts = expression.split("'")
    return "'".join(part if k % 2 else names.sub(lambda m: f"s.{m[1]}" if m[1] else "e.kind", part) for k, part in enumerate(parts))


def replay(events: DataFrame, run: str, protocol: Protocol, seq: str = "seq", kind: str = "kind") -> DataFrame:
    """``run``, n_events, the fields, n_waiting, status, error (empty if none): each run's whole journal at once.

    An event delivered again, by its number, counts once; n_waiting events stand behind a gap. A journal is as long as one
    run, so its events are gathered for the fold. Rows without a number are not events; a null kind is unknown.
    """
    once = events.where(F.col(seq).isNotNull()).groupBy(run, F.col(seq).cast("long").alias("seq")).agg(F.min(kind).alias("kind"))
    journals = once.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("events"))
    # of an ascending list of different numbers, those that are their own places
    journals = journals.withColumn("due", F.filter("events", lambda e, i: e["seq"] == i))
    start = "named_struct(" + ", ".join(f"'{f}', 0" for f in FIELDS) + ", 'error', '')"
    error = _inside(error_sql(protocol))
    changed = "named_struct(" + ", ".join(f"'{f}', " + _inside(c) for f, c in _CHANGES.items()) + ", 'error', '')"
    failed = "named_struct(" + ", ".join(f"'{f}', s.{f}" for f in FIELDS) + f", 'error', {error})"
    state = F.expr(f"aggregate(due, {start}, (s, e) -> case when s.error <> '' then s when ({error}) <> '' then {failed} else {changed} end)")
    out = journals.select(run, F.size("events").alias("n_events"), (F.size("events") - F.size("due")).alias("n_waiting"), state.alias("s"))
    return out.select(run, "n_events", "s.*", "n_waiting").withColumn("status", status(F.col("error"), F.col("reported"), F.col("n_waiting")))
