from itertools import product

import numpy as np
import pytest

from tessera.operators import design, lattice, learners, selection
from tessera.sources.landscapes import landscape

DATA = "/root/testdata/sf0.001"


def kernel(a, b, sizes, orders):
    """The sum over all sets of dimensions, one by one."""
    out = 0.0
    for chosen in product((0, 1), repeat=len(sizes)):
        if sum(chosen) in orders:
            out += np.prod([((x == y) - 1 / q) if c else 1 / q for x, y, q, c in zip(a, b, sizes, chosen)])
    return out


def greedy(cells, budget, orders, sizes, noise):
    """(cell_code, variance) by posterior covariances of the whole pool."""
    rows = sorted(cells, key=lambda r: r[1])
    k = np.array([[kernel(a[2], b[2], sizes, orders) for b in rows] for a in rows])
    out, open_ = [], np.ones(len(rows), dtype=bool)
    for _ in range(min(budget, len(rows))):
        shown = np.where(open_, np.round(np.diag(k), 9), -1)
        i = int(np.argmax(shown))
        out.append((rows[i][0], round(float(k[i, i]), 6)))
        open_[i] = False
        k = k - np.outer(k[:, i], k[i]) / (noise + k[i, i])
    return out


@pytest.mark.parametrize("name", ["quad5", "mixed225", "mixed150"])
def test_d_optimal_is_that_of_the_whole_covariance(spark, name, monkeypatch):
    monkeypatch.setattr(design, "PICKS_AT_ONCE", 3)
    cells = landscape(spark, DATA, name)
    sizes = [cells.agg({f"d{k}": "max"}).first()[0] + 1 for k in range(4)]
    pool = lattice.candidates(cells, 3).join(selection.scored(cells).select("cell_code", "ident"), "cell_code")
    targets = {"all": (1, 2, 3), "pairs": (1, 2)}
    got = design.d_optimal(cells, pool, 8, targets).collect()
    rows = [(r.cell_code, r.ident, (r.d0, r.d1, r.d2, r.d3)) for r in pool.collect()]
    for target, orders in targets.items():
        mine = [(r.cell_code, r.variance) for r in sorted(got, key=lambda r: r["rank"]) if r.target == target]
        assert mine == greedy(rows, 8, orders, sizes, design.NOISE)


def test_d_optimal_of_a_small_pool_takes_it_whole(spark):
    cells = landscape(spark, DATA, "mixed225")
    pool = selection.scored(cells).select("cell_code", "ident").limit(3)
    got = design.d_optimal(cells, pool, 8, {"pairs": (1, 2)}).collect()
    assert len(got) == 3 and {r["rank"] for r in got} == {1, 2, 3}
    assert design.d_optimal(cells, pool.where("false"), 8, {"pairs": (1, 2)}).count() == 0


@pytest.fixture(scope="module")
def plate(spark):
    """Two plates of 40 rows over 12 columns, 8 of them of order 1, in three folds."""
    r, rows = np.random.default_rng(3), []
    for name in ("a", "b"):
        for row in range(40):
            y = float(r.normal())
            for col in sorted(set(r.choice(12, 4).tolist())):
                rows.append((name, row, col, 1 if col < 8 else 2, y, row % 3))
    return spark.createDataFrame(rows, "method string, row long, col long, col_ord int, y double, fold int"), rows


def dense(rows, name):
    own = [r for r in rows if r[0] == name]
    ids, cols = sorted({r[1] for r in own}), sorted({r[2] for r in own})
    x, y, fold = np.zeros((len(ids), len(cols))), np.zeros(len(ids)), np.zeros(len(ids), dtype=int)
    for _, row, col, _, label, f in own:
        x[ids.index(row), cols.index(col)], y[ids.index(row)], fold[ids.index(row)] = 1.0, label, f
    return x, y, fold, np.array(cols), np.where(np.array(cols) < 8, 1, 2)


def test_normal_equations(plate):
    df, rows = plate
    got = {(r.method, r.i, r.j): r.g for r in design.gram(df, ["method"]).collect()}
    for name in ("a", "b"):
        x, y, _, cols, _ = dense(rows, name)
        names, z = [design.LABEL, design.ONE, *cols.tolist()], np.column_stack([y, np.ones(len(y)), x])
        want = z.T @ z
        for i, a in enumerate(names):
            for j, b in enumerate(names):
                if a <= b:
                    assert got.pop((name, a, b), 0.0) == pytest.approx(want[i, j], abs=1e-9)
    assert not got


def test_ridge_from_sums_is_that_of_the_rows(plate):
    df, rows = plate
    mains, pairs = [0.1, 10.0], [1.0, 100.0]
    best = {r.method: r for r in design.cross_validated(df, ["method"], mains, pairs).collect()}
    fitted = design.weights(df, ["method"], design.cross_validated(df, ["method"], mains, pairs)).collect()
    for name in ("a", "b"):
        x, y, fold, cols, order = dense(rows, name)
        tried = []
        for m, p in product(mains, pairs):
            errors = []
            for f in range(3):
                b, w = learners.ridge(x[fold != f], y[fold != f], np.where(order == 1, m, p))
                errors += ((y[fold == f] - b - x[fold == f] @ w) ** 2).tolist()
            tried.append((round(float(np.mean(errors)), 9), -m, -p))
        mse, m, p = min(tried)
        assert (best[name].alpha_main, best[name].alpha_pair) == (-m, -p) and best[name].mse == pytest.approx(mse, abs=1e-8)
        b, w = learners.ridge(x, y, np.where(order == 1, -m, -p))
        got = {r.col: r.weight for r in fitted if r.method == name}
        assert got.pop(design.ONE) == pytest.approx(b, abs=1e-7)
        assert got == pytest.approx(dict(zip(cols.tolist(), w)), abs=1e-7)


def test_random_effects_from_sums_are_those_of_the_rows(plate):
    df, rows = plate
    grid = np.append(np.logspace(-3, 4, 11), np.inf)
    got = design.random_effects(df, ["method"], grid).collect()
    for name in ("a", "b"):
        x, y, _, cols, _ = dense(rows, name)
        tried = []
        for ratio in grid:
            hat = np.zeros((len(y), len(y))) if np.isinf(ratio) else x @ np.linalg.solve(x.T @ x + ratio * np.eye(len(cols)), x.T)
            tried.append((((y - hat @ y) ** 2).sum() * len(y) / (len(y) - np.trace(hat)) ** 2, ratio))
        ratio = min(tried)[1]
        mine = [r for r in got if r.method == name]
        assert {r.ratio for r in mine} == {None if np.isinf(ratio) else round(float(ratio), 9)}
        effects = np.zeros(len(cols)) if np.isinf(ratio) else np.linalg.solve(x.T @ x + ratio * np.eye(len(cols)), x.T @ y)
        assert {r.col: r.effect for r in mine} == pytest.approx(dict(zip(cols.tolist(), effects)), abs=1e-7)


def test_random_effects_of_noise_and_of_a_law():
    r = np.random.default_rng(1)
    x = (r.random((200, 6)) < 0.5).astype(float)
    for y, none in ((x @ np.arange(6.0), False), (r.normal(size=200), True)):
        ratio, w = design.blup_from_gram(x.T @ x, x.T @ y, float(y @ y), 200, np.array([1e-6, 1.0, np.inf]))
        assert np.isinf(ratio) == none or none and ratio == 1.0
        assert none or np.allclose(w, np.arange(6.0), atol=1e-4)
