import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.jobs import evidence
from tessera.jobs import records as jobs
from tessera.operators import learners, records, transform
from tessera.sources.landscapes import landscape

DATA = "/root/testdata/sf0.001"
MAINS, PAIRS = [0.1, 10.0], [1.0, 100.0]


@pytest.fixture(scope="module")
def parts(spark):
    cells, dealt, plate = jobs._plates(spark, DATA)
    plate = plate.where("held < 2 and method <> 'prior' and estimand = 'target_blind' and regime = 'attempted_budget'")
    features = transform.features(cells).persist()
    fitted = records.fits(plate, cells, features, MAINS, PAIRS).persist()
    return cells, dealt, plate, features, fitted


def slow_fit(rows, features, name):
    """intercept, weights by column, main and pair penalties, slope: from the plate's rows in salted order, by dense systems."""
    rows = [r for r in rows if name != "no_triples" or r["ord"] <= 2]
    columns = {r["cell_code"]: [(c, o) for c, o in features[r["cell_code"]] if name != "main_only" or o == 1] for r in rows}
    orders = {c: o for own in columns.values() for c, o in own}
    cols = sorted(orders)
    x = np.array([[float(c in dict(columns[r["cell_code"]])) for c in cols] for r in rows])
    y, prior, order = np.array([r["dg"] for r in rows]), np.array([r["prior"] for r in rows]), np.array([orders[c] for c in cols])
    fold = np.arange(len(rows)) % 3
    slope = lambda keep: (prior[keep] @ y[keep]) / (prior[keep] @ prior[keep]) if name == "offset" else 0.0
    tried = []
    for m in MAINS:
        for p in PAIRS if name != "main_only" else [max(PAIRS)]:
            errors = []
            for f in range(3):
                b, w = learners.ridge(x[fold != f], y[fold != f] - slope(fold != f) * prior[fold != f], np.where(order == 1, m, p))
                errors += ((y - slope(fold != f) * prior - b - x @ w)[fold == f] ** 2).tolist()
            tried.append((round(float(np.mean(errors)), 9), -m, -p))
    _, m, p = min(tried)
    s = slope(np.ones(len(rows), dtype=bool))
    b, w = learners.ridge(x, y - s * prior, np.where(order == 1, -m, -p))
    return b, dict(zip(cols, w)), -m, -p, s


def test_four_learners_against_dense_systems(parts):
    cells, dealt, plate, features, fitted = parts
    from tessera.functions import cells as C

    told = plate.join(cells.select("cell_code", "dg"), "cell_code").withColumn("turn", C.stable_order("inner-1", F.col("ident"))).collect()
    columns = {}
    for r in features.collect():
        columns.setdefault(r.row, []).append((r.col, r.col_ord))
    for r in fitted.collect():
        own = sorted((t.asDict() for t in told if (t.held, t.method, t.budget) == (r.held, r.method, r.budget)), key=lambda t: (t["turn"], t["ident"]))
        b, w, m, p, s = slow_fit(own, columns, r.learner)
        got = {x.col: x.weight for x in r.weights}
        assert (r.alpha_main, r.alpha_pair) == (m, p) and got.pop(-1) == pytest.approx(b, abs=1e-9)
        assert got == pytest.approx(w, abs=1e-9) and (r.learner != "offset" or r.slope == pytest.approx(s))


def test_predictions_add_up_what_was_fitted(parts):
    cells, dealt, plate, features, fitted = parts
    due = records.due(dealt, cells, evidence.FOLDS)
    got = records.predictions(fitted, due, features).collect()
    columns, prior = {}, {r.cell_code: r.prior for r in due.collect()}
    for r in features.collect():
        columns.setdefault(r.row, []).append(r.col)
    models = {(r.held, r.method, r.budget, r.learner): r for r in fitted.collect()}
    assert {(r.held, r.method, r.budget, r.learner) for r in got} == set(models)
    for r in got:
        model = models[r.held, r.method, r.budget, r.learner]
        w = {x.col: x.weight for x in model.weights}
        offset = model.slope * prior[r.cell_code] if r.learner == "offset" else 0.0
        assert r.pred == pytest.approx(w[-1] + sum(w.get(c, 0.0) for c in columns[r.cell_code]) + offset, abs=1e-8)


def test_no_label_of_the_fold_reaches_a_fit(parts, spark):
    """Held-out labels changed at will leave every weight, and every prediction, as it was."""
    cells, dealt, plate, features, fitted = parts
    wrong = cells.join(dealt.where("fold = 0").select("cell_code", F.lit(True).alias("due")), "cell_code", "left").withColumn("dg", F.when(F.col("due"), F.col("dg") * -3 + 100).otherwise(F.col("dg"))).drop("due")
    at = plate.where("held = 0")
    key = lambda df: sorted(map(repr, df.where("held = 0").collect()))
    assert key(records.fits(at, wrong, features, MAINS, PAIRS)) == key(fitted)


def test_too_few_labels_fit_nothing(parts):
    cells, dealt, plate, features, _ = parts
    two = plate.where("held = 0 and budget = 12 and method = 'info'").limit(2).persist()
    due = records.due(dealt, cells, evidence.FOLDS)
    fitted = records.fits(two, cells, features, MAINS, PAIRS).persist()
    assert all(r.weights is None and r.fell_back for r in fitted.collect())
    predicted = records.predictions(fitted, due, features).unionByName(records.controls(records.slopes(two, cells), due))
    got = records.records(records.accounting(two, cells), fitted, records.scores(predicted, cells)).collect()
    assert len(got) == 1 and got[0].status == "empty_training" and got[0].macro is None and got[0].zero_shot_macro is not None and got[0].transfer_degenerate


def test_records_and_their_means(spark):
    rows = jobs.benchmark_records(spark, DATA).persist()
    cells = landscape(spark, DATA, "quad5")
    assert rows.count() == 2 * 2 * 5 * 3 * 2 and rows.select(*records.CELL).distinct().count() == rows.count()
    for r in rows.collect():
        assert r.n_selected == r.budget == r.selected_1 + r.selected_2 + r.selected_3 and r.n_train == r.n_positive + r.n_zero + r.n_negative
        assert r.uplift is None or abs(r.uplift) <= 2 and r.regret >= 0 and 0 <= r.ndcg <= 1
    # a pool without holes is the same in both regimes
    assert cells.where("dg is null").count() == 0
    by = {(r.estimand, r.held, r.method, r.budget): r.macro for r in rows.where("regime = 'attempted_budget'").collect()}
    assert by == {(r.estimand, r.held, r.method, r.budget): r.macro for r in rows.where("regime = 'measured_available'").collect()}
    means = records.summaries(rows).where("estimand = 'target_blind' and regime = 'attempted_budget' and method = 'info' and budget = 48").first()
    own = [r.macro for r in rows.collect() if (r.estimand, r.regime, r.method, r.budget) == ("target_blind", "attempted_budget", "info", 48)]
    assert means.n_cells == 5 and means.mean_macro == pytest.approx(np.mean(own), abs=1e-6)
