"""Small iterative fits, one for each group of rows: Spark deals the groups out, NumPy solves each.

A group is a plate of a few hundred measured cells, so it fits in a task whatever the size of the facts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The design, labels, row ids, column ids and column orders of long rows (row, col, col_ord, y)."""
    rows, r = np.unique(group["row"].to_numpy(), return_inverse=True)
    cols, c = np.unique(group["col"].to_numpy(), return_inverse=True)
    x, y, order = np.zeros((len(rows), len(cols))), np.zeros(len(rows)), np.zeros(len(cols), dtype=int)
    x[r, c], y[r], order[c] = 1.0, group["y"].to_numpy(), group["col_ord"].to_numpy()
    return x, y, rows, cols, order


def ridge(x: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> tuple[float, np.ndarray]:
    """Ridge with a penalty for each column and a free intercept, by a system of as many unknowns as there are rows."""
    mean_x, mean_y = x.mean(axis=0), y.mean()
    z = (x - mean_x) / penalty
    weights = z.T @ np.linalg.solve(z @ (x - mean_x).T + np.eye(len(x)), y - mean_y)
    return float(mean_y - mean_x @ weights), weights


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, sweeps: int = 2_000, tolerance: float = 1e-10) -> np.ndarray:
    """Minimises the mean squared error plus ``penalty`` times the absolute weights, one coordinate at a time."""
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    scale, rest = (x**2).mean(axis=0), y - x @ w
    active = np.arange(x.shape[1])
    for sweep in range(sweeps):
        moved = 0.0
        for j in active:
            if scale[j] == 0:
                continue
            pull = x[:, j] @ rest / len(y) + scale[j] * w[j]
            new = np.sign(pull) * max(abs(pull) - penalty / 2, 0.0) / scale[j]
            if new != w[j]:
                rest += x[:, j] * (w[j] - new)
                moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tolerance:
            if len(active) == x.shape[1]:
                break
            active = np.arange(x.shape[1])  # the support has settled; now whether any other column would enter
        elif sweep % 10 == 0:
            active = np.flatnonzero(w) if w.any() else active
    return w


def fista(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 5_000, tolerance: float = 1e-10) -> np.ndarray:
    """The same minimum by accelerated proximal steps; momentum starts over when it points uphill."""
    w = z = np.zeros(x.shape[1])
    t, reach = 1.0, 2 * np.linalg.norm(x, 2) ** 2 / len(y) or 1.0
    for _ in range(steps):
        slope = 2 * x.T @ (x @ z - y) / len(y)
        step = z - slope / reach
        new = np.sign(step) * np.maximum(np.abs(step) - penalty / reach, 0)
        if (z - new) @ (new - w) > 0:
            t = 1.0
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / later * (new - w)
        if np.abs(new - w).max(initial=0) < tolerance:
            return new
        w, t = new, later
    return w


def largest_penalty(x: np.ndarray, y: np.ndarray) -> float:
    """The least penalty that leaves no weight."""
    return float(2 * np.abs(x.T @ y).max(initial=0) / max(len(y), 1))


def optimality_gap(x: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray) -> float:
    """By how much weights break the conditions of the minimum that ``lasso`` and ``fista`` seek, as a share of the penalty."""
    pull = 2 * x.T @ (y - x @ w) / max(len(y), 1)
    broken = np.where(w != 0, np.abs(pull - penalty * np.sign(w)), np.maximum(np.abs(pull) - penalty, 0))
    return float(broken.max(initial=0) / penalty) if penalty > 0 else 0.0


def per_group(long: DataFrame, by: list[str], fit: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fit`` applied to the rows of each group; the group's keys are kept in front of what it gives."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = fit(group)
        for k, c in enumerate(by):
            out.insert(k, c, group[c].iloc[0])
        return out

    keys = ", ".join(f"{c} {dict(long.dtypes)[c]}" for c in by)
    return long.groupBy(*by).applyInPandas(run, f"{keys}, {schema}")


def grid(long: DataFrame, values: dict[str, list[float]]) -> DataFrame:
    """``long`` once for each combination of the values, which makes a fit for each a group of its own."""
    out = long
    for name, choices in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in choices])))
    return out
