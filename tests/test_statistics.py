import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators import audit, folds, journal, learners, resample


def ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_correlations_and_their_guards(spark):
    r = np.random.default_rng(1)
    x, y = np.round(r.random(40), 1), np.round(r.random(40), 1)
    rows = [("a", float(a), float(b)) for a, b in zip(x, y)] + [("flat", 1.0 + 1e-15 * k, float(k)) for k in range(9)] + [("few", 1.0, 2.0), ("few", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    df = df.withColumn("xr", stats.average_rank("x", "g")).withColumn("yr", stats.average_rank("y", "g"))
    got = {t.g: t for t in df.groupBy("g").agg(stats.pearson(F.col("x"), F.col("y")).alias("p"), stats.pearson(F.col("xr"), F.col("yr")).alias("s")).collect()}
    assert abs(got["a"].p - np.corrcoef(x, y)[0, 1]) < 1e-9 and abs(got["a"].s - np.corrcoef(ranks(x), ranks(y))[0, 1]) < 1e-9
    assert got["flat"].p is None and got["few"].p is None


def test_partial_correlation_is_that_of_residuals(spark):
    r = np.random.default_rng(2)
    z = r.standard_normal(60)
    x, y = z + r.standard_normal(60), 2 * z + r.standard_normal(60)
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(x, y, z)], "x double, y double, z double")
    c = stats.pearson
    got = df.agg(c(F.col("x"), F.col("y")).alias("xy"), c(F.col("x"), F.col("z")).alias("xz"), c(F.col("y"), F.col("z")).alias("yz")).select(stats.partial(F.col("xy"), F.col("xz"), F.col("yz"))).first()[0]
    rest = lambda v: v - np.polyval(np.polyfit(z, v, 1), z)
    assert abs(got - np.corrcoef(rest(x), rest(y))[0, 1]) < 1e-9


def test_slope_and_gain_fall_back(spark):
    df = spark.createDataFrame([(0.0, 3.0)], "x double, y double")
    row = df.agg(stats.slope(F.col("x"), F.col("y")).alias("b"), stats.sse_gain(F.col("y"), F.col("x"), F.col("y")).alias("g")).first()
    assert row.b == 1.0 and row.g is None


def test_folds_are_balanced_and_blind_to_order(spark):
    df = spark.createDataFrame([(f"id{k}", k % 3) for k in range(50)], "ident string, ord int")
    a = {r.ident: r.fold for r in folds.deal(df, 4, "s", "ord").collect()}
    b = {r.ident: r.fold for r in folds.deal(df.orderBy(F.desc("ident")), 4, "s", "ord").collect()}
    assert a == b
    for o in range(3):
        n = [sum(a[f"id{k}"] == f for k in range(50) if k % 3 == o) for f in range(4)]
        assert max(n) - min(n) <= 1
    with pytest.raises(ValueError):
        folds.deal(df, 1, "s")


def test_ndcg_by_hand(spark):
    rows = [("p", 3.0, 0.0, "a"), ("p", 2.0, 5.0, "b"), ("p", 1.0, 2.0, "c"), ("q", 1.0, -1.0, "a"), ("q", 2.0, -2.0, "b")]
    df = folds.relevance(spark.createDataFrame(rows, "g string, pred double, label double, id string"), "label", "g")
    got = {r.g: r.ndcg for r in folds.ndcg(df, "pred", "id", 2, "g").collect()}
    assert abs(got["p"] - (1 / np.log2(3)) / (1 + 0.5 / np.log2(3))) < 1e-6 and got["q"] == 1.0


def test_budget_auc(spark):
    df = spark.createDataFrame([("a", 48, 1.0), ("a", 96, 2.0), ("a", 192, 4.0), ("b", 48, 1.0), ("b", 96, None)], "g string, b int, v double")
    assert {r.g: r.auc for r in folds.budget_auc(df, "v", "b", "g").collect()} == {"a": 2.25, "b": None}
    with pytest.raises(PySparkException):
        folds.budget_auc(spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 1.0)], "g string, b int, v double"), "v", "b", "g").collect()


def test_audits(spark):
    due = spark.createDataFrame([(k,) for k in range(5)], "k int")
    seen = spark.createDataFrame([(0, "x"), (1, "x"), (1, "x"), (2, "x"), (2, "y"), (9, "z")], "k int, p string")
    assert {(r.k, r.finding) for r in folds.key_audit(due, seen, ["k"], F.col("p")).collect()} == {(1, "duplicate"), (2, "divergent"), (3, "missing"), (4, "missing"), (9, "unexpected")}
    labels = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 2.0), ("c", None), ("c", None), ("d", 1.0), ("d", 3.0), ("e", 0.0)], "i string, v double")
    row = audit.duplicates(labels, "i", "v").first()
    assert (row.n_rows, row.n_unique, row.n_duplicate, row.n_identical, row.n_conflicting, row.samples) == (9, 5, 4, 2, 2, "a,d")
    doc = spark.createDataFrame([('{"a/b": [1, {"c~": "x"}]}',)], "d string")
    assert doc.select(audit.pointed(F.col("d"), "/a~1b/1/c~0")).first()[0] == "x"
    buckets = audit.label_buckets(spark.createDataFrame([(v,) for v in (1.0, 0.0, -0.5, -1.0, float("nan"), float("inf"), None)], "v double"), F.col("v")).first()
    assert tuple(buckets) == (7, 1, 1, 1, 1, 2, 1)


def test_replay_counts_illegal_steps(spark):
    df = spark.createDataFrame([("r", 0, "a"), ("r", 1, "b"), ("r", 2, "a"), ("r", 3, "a"), ("s", 1, "b")], "run string, seq int, kind string")
    got = {r.run: (r.n_events, r.last_kind, r.n_illegal) for r in journal.replay(df, "run", "seq", "kind", {"": ["a"], "a": ["b"], "b": ["a"]}).collect()}
    assert got == {"r": (4, "a", 1), "s": (1, "b", 1)}


def test_bootstrap_covers_and_repeats(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal(80)
    df = spark.createDataFrame([(k, float(a), float(a + 0.5 * e)) for k, (a, e) in enumerate(zip(x, r.standard_normal(80)))], "k int, x double, y double").withColumn("g", F.lit(1))
    one = resample.correlation_interval(df, "x", "y", "k", 100, "s", "g").first()
    assert one == resample.correlation_interval(df.orderBy(F.desc("k")), "x", "y", "k", 100, "s", "g").first()
    assert one.lo < 0.9 < one.hi and one.n_valid == 100


def test_ridge_dual_is_the_primal():
    r = np.random.default_rng(4)
    for n, p in ((5, 3), (4, 9), (12, 12)):
        x, y, pen = r.standard_normal((n, p)), r.standard_normal(n), r.random(p) + 0.1
        b, w = learners.ridge(x, y, pen)
        c = x - x.mean(axis=0)
        assert np.allclose(w, np.linalg.solve(c.T @ c + np.diag(pen), c.T @ (y - y.mean()))) and np.isclose(b, y.mean() - x.mean(axis=0) @ w)


def test_lasso_solvers_agree_and_meet_the_optimality_conditions():
    r = np.random.default_rng(5)
    x = r.standard_normal((30, 50))
    y = x[:, :3] @ [1.5, -0.8, 0.45] + 0.05 * r.standard_normal(30)
    top = learners.largest_penalty(x, y)
    assert not learners.lasso(x, y, top * 1.0001).any()
    for share in (0.5, 0.1):
        a, b = learners.lasso(x, y, share * top), learners.fista(x, y, share * top)
        assert np.allclose(a, b, atol=1e-5)
        pull = 2 * x.T @ (y - x @ a) / 30
        assert (np.abs(pull) <= share * top + 1e-6).all() and np.allclose(pull[a != 0], share * top * np.sign(a[a != 0]), atol=1e-5)


def test_a_fit_that_stops_early_shows_its_gap():
    r = np.random.default_rng(6)
    x, y = r.standard_normal((60, 20)), r.standard_normal(60)
    penalty = 0.1 * learners.largest_penalty(x, y)
    for solve, steps in ((learners.lasso, "sweeps"), (learners.fista, "steps")):
        assert learners.optimality_gap(x, y, penalty, solve(x, y, penalty)) < 1e-4 < learners.optimality_gap(x, y, penalty, solve(x, y, penalty, **{steps: 1}))


def test_solvers_agree_on_every_plate(spark):
    from tessera.jobs import iterative

    of = lambda f: {(r.method, r.ratio): (r.support, round(r.mse, 5), r.converged) for r in f(spark, "/root/testdata/sf0.01").collect()}
    lasso, fista = of(iterative.lasso_path), of(iterative.fista_path)
    assert lasso == fista and all(c for _, _, c in lasso.values()) and len(lasso) == 12
