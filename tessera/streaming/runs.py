"""Run journals as streams: the state of each run is kept between batches, and events may come late or twice."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.runs import FIELDS, KINDS, Protocol

OUT = "n_events int, " + ", ".join(f"{f} int" for f in FIELDS) + ", error string, n_waiting int, status string"


def step(state: dict[str, int], kind: str | None, p: Protocol) -> str:
    """Applies one event to a state; if it may not stand there, leaves the state and says why."""
    s = state
    if kind not in KINDS:
        return "an event of unknown kind"
    if s["reported"]:
        return "an event follows the report"
    if kind == "prepared":
        if s["n_applied"]:
            return "the run is prepared already"
        s["prepared"] = 1
    elif not s["prepared"]:
        return "the run is not prepared"
    elif kind == "attempt_started":
        if s["completed"]:
            return "an attempt starts after completion"
        s["abandoned"] += s["open"]
        s["attempts"], s["open"] = s["attempts"] + 1, 1
    elif kind == "attempt_completed":
        if not s["open"]:
            return "no attempt is open"
        if s["cells"] < p.cells or s["folds"]:
            return "an attempt completes before its cells"
        s["open"], s["completed"] = 0, 1
    elif s["completed"] and kind != "report":
        return "only the report may follow completion"
    elif kind == "design":
        if s["selected"]:
            return "a design step follows the selection"
        if s["design"] >= p.design_steps:
            return "the design is complete"
        s["design"] += 1
    elif kind == "selection":
        if s["selected"]:
            return "the selection is published already"
        if s["design"] < p.design_steps:
            return "the design is not complete"
        s["selected"] = 1
    elif not s["selected"]:
        return "the selection is not published"
    elif kind == "report":
        if s["cells"] < p.cells:
            return "the report comes before its cells"
        if not s["completed"]:
            return "no attempt has completed"
        s["reported"] = 1
    elif s["cells"] >= p.cells:
        return "all cells are closed"
    elif kind == "fit":
        if s["folds"] >= p.folds:
            return "the fit has all its folds"
        s["folds"] += 1
    else:
        if s["folds"] < p.folds:
            return "a cell closes before its fit"
        s["folds"], s["cells"] = 0, s["cells"] + 1
    s["n_applied"] += 1
    return ""


class RunReducer(StatefulProcessor):
    """The state of a run, and the events that wait behind a gap, by their number."""

    def __init__(self, run: str, protocol: Protocol) -> None:
        self.run, self.protocol = run, protocol

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", ", ".join(f"{f} int" for f in FIELDS) + ", error string, n_events int, n_waiting int")
        self.waiting = handle.getMapState("waiting", "seq long", "kind string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        told = self.state.get() if self.state.exists() else (*(0 for _ in FIELDS), "", 0, 0)
        state, error, events, waiting = dict(zip(FIELDS, told)), *told[len(FIELDS) :]
        # numbers up to here have come: what a failure cuts off is told apart from what waits
        due = events - waiting
        for batch in rows:
            for seq, kind in zip(batch["seq"].tolist(), batch["kind"].tolist()):
                if seq is None or seq != seq or seq < due or self.waiting.containsKey((int(seq),)):
                    continue  # no number, or it has come before
                self.waiting.updateValue((int(seq),), (None if kind != kind else kind,))
                events, waiting = events + 1, waiting + 1
                while waiting and self.waiting.containsKey((due,)):
                    (next_,) = self.waiting.getValue((due,))
                    self.waiting.removeKey((due,))
                    due, waiting = due + 1, waiting - 1
                    error = error or step(state, next_, self.protocol)
        self.state.update((*state.values(), error, events, waiting))
        status = "failed" if error else "reported" if state["reported"] else "waiting" if waiting else "open"
        yield pd.DataFrame([(*key, events, *state.values(), error, waiting, status)], columns=[self.run, "n_events", *FIELDS, "error", "n_waiting", "status"])

    def close(self) -> None:
        pass


def reduce_runs(events: DataFrame, run: str, protocol: Protocol) -> DataFrame:
    """``run`` and its state after each batch of ``events`` (``run``, seq, kind) that has something for it, as ``operators.runs.replay`` gives it at the end.

    A stream, or a table as one batch. The session's state store must be the one on RocksDB.
    """
    kind = dict(events.dtypes)[run]
    keyed = events.select(run, "seq", "kind").groupBy(run)
    return keyed.transformWithStateInPandas(RunReducer(run, protocol), f"{run} {kind}, {OUT}", "Update", "None")
