import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, benchmark, folds, resample, selection
from tessera.sources.landscapes import landscape

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def parts(spark):
    cells = landscape(spark, DATA, "mixed225")
    pool = selection.scored(cells)
    dealt = folds.deal(pool.where("ord >= 2"), 5, "outer-1", "ord").unionByName(pool.where("ord < 2").withColumn("fold", F.lit(None).cast("int")), allowMissingColumns=True)
    return cells, pool, dealt


def test_a_selection_sees_nothing_of_its_held_out_fold(parts):
    cells, pool, dealt = parts
    fold = {r.cell_code: r.fold for r in dealt.collect()}
    cover = {(r.held, r.cell_code): r.loops for r in benchmark.blind_coverage(cells, dealt, 5).collect()}
    rows = {r.cell_code: r for r in cells.collect()}
    held, code = 2, next(c for c, r in rows.items() if r.ord == 1)
    inside = lambda a, b: all(a[f"d{k}"] in (0, b[f"d{k}"]) for k in range(4))
    want = sum(2 <= r.ord <= 3 and fold.get(c) != held and inside(rows[code], r) for c, r in rows.items())
    assert cover[held, code] == want
    plate = benchmark.plates(benchmark.blind_pool(dealt, benchmark.blind_coverage(cells, dealt, 5), 5), [8, 20]).collect()
    assert all(fold[r.cell_code] != r.held for r in plate)
    small, large = ({(r.held, r.method, r.cell_code) for r in plate if r.budget == b} for b in (8, 20))
    assert small < large and len(small) == 8 * 15 and len(large) == 20 * 15


def test_no_measure_steers_a_selection(parts):
    cells, pool, dealt = parts
    other = cells.withColumn("dg", -F.col("dg"))
    of = lambda c: {(r.held, r.method, r.cell_code) for r in benchmark.plates(benchmark.blind_pool(dealt, benchmark.blind_coverage(c, dealt, 5), 5), [12]).collect()}
    assert of(cells) == of(other)


def test_missing_labels_are_counted_and_never_fitted(spark, parts):
    cells, _, dealt = parts
    some = cells.withColumn("dg", F.when(F.col("cell_code") % 3 > 0, F.col("dg")))
    plate = benchmark.plates(benchmark.blind_pool(dealt, benchmark.blind_coverage(cells, dealt, 5), 5), [30])
    for r in benchmark.revealed_counts(plate, some).collect():
        assert r.n_selected == 30 and r.n_train + r.n_missing == 30 and r.n_positive + r.n_nonpositive == r.n_train and r.n_missing > 0
    nothing = cells.withColumn("dg", F.lit(None).cast("double"))
    assert benchmark.fits(plate, nothing).count() == 0
    assert all(r.n_train == 0 and r.positive_fraction is None for r in benchmark.revealed_counts(plate, nothing).collect())


def test_quantiles_are_exact(spark):
    r = np.random.default_rng(4)
    groups = {"a": r.standard_normal(997), "b": np.array([2.5]), "c": np.repeat([1.0, 7.0], [60, 41]), "d": np.append(r.random(200), 1e9), "e": np.full(12, -3.0)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("b", float("nan")), ("f", None)]
    shares = {"q0": 0.0, "q05": 0.05, "median": 0.5, "q9": 0.9, "q1": 1.0}
    got = {x.g: x for x in audit.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(4), "v", shares, "g").collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert np.allclose([got[g][k] for k in shares], np.quantile(values, list(shares.values())))
    whole = audit.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", {"m": 0.5}).collect()
    assert np.isclose(whole[0].m, np.median(np.concatenate(list(groups.values()))))


def test_draws_are_as_many_as_the_group_has_rows(spark):
    rows = spark.createDataFrame([(g, k) for g, n in (("a", 7), ("b", 1)) for k in range(n)], "g string, k int")
    got = resample.draws(resample.numbered(rows, "k", "g"), 5, "s", "g").groupBy("g", "rep").agg(F.count("*").alias("n"), F.max("idx").alias("top")).collect()
    assert {(r.g, r.rep): r.n for r in got} == {(g, rep): n for g, n in (("a", 7), ("b", 1)) for rep in range(5)} and all(r.top < {"a": 7, "b": 1}[r.g] for r in got)


def test_arms_meet_by_seed_or_alone(spark):
    arms = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0), ("y", 1, 0.5), ("y", 3, 9.0), ("z", None, 4.0)], "arm string, seed int, v double")
    got = {(r.a_arm, r.b_arm, r.seed): r.delta for r in benchmark.realised_pairs(arms.where("arm = 'x'"), arms.where("arm <> 'x'"), "v").collect()}
    assert got == {("x", "y", 1): 0.5, ("x", "z", 1): -3.0, ("x", "z", 2): -2.0}
    fact = benchmark.variability(spark.createDataFrame([("a", "b", -1.0), ("a", "b", 3.0), ("a", "b", 4.0)], "a_arm string, b_arm string, delta double")).collect()[0]
    assert (fact.n, fact["mean"], fact.median, fact.positive_fraction) == (3, 2.0, 3.0, round(2 / 3, 6))


def test_a_cut_that_parts_equals_is_an_error(spark):
    pool = spark.createDataFrame([(1, 5.0), (2, 4.0), (3, 4.0), (4, 1.0)], "cell_code long, s double")
    assert [r.budget for r in selection.require_untied(pool, "s", [1, 3]).collect()] == [1, 3]
    with pytest.raises(Exception, match="equals at the cut of a budget of 2"):
        selection.require_untied(pool, "s", [2]).collect()


def test_ranking_puts_what_is_undefined_last(spark):
    scores = spark.createDataFrame([("a", None), ("b", 2.0), ("c", 3.0), ("d", 2.0)], "method string, s double")
    assert [r.method for r in benchmark.ranking(scores, "s", "method").orderBy("place").collect()] == ["c", "b", "d", "a"]
