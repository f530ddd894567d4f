from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import cells as C
from tessera.operators import benchmark, folds, selection, transform

from test_lattice import coupled, grid


def test_arms_are_paired_by_seed_or_crossed_by_the_kind_of_their_seeds(spark):
    rows = [("one", "none", None, 5.0), *(("r", "random", s, float(s)) for s in (1, 2, 3)), *(("q", "random", s, 10.0 * s) for s in (2, 3, 4)), *(("t", "tie", s, 100.0 * s) for s in (1, 2))]
    arms = spark.createDataFrame(rows, "arm string, kind string, seed int, v double")
    want = []
    for a, b in product(rows, rows):
        if a[1] == b[1] != "none" and a[2] != b[2]:
            continue
        seed = a[2] if a[1] == b[1] != "none" else b[2] if a[1] == "none" else a[2] if b[1] == "none" else None
        want.append((a[0], b[0], seed, a[3] - b[3]))
    got = benchmark.arm_pairs(arms, arms, "v")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert "NestedLoop" not in got.where("a_arm = 'r'")._jdf.queryExecution().optimizedPlan().toString()
    plain = arms.select("arm", "seed", "v").where("kind <> 'tie'")
    assert benchmark.realised_pairs(plain.where("arm = 'one'"), plain, "v").count() == 7


def test_a_schedule_has_every_combination(spark):
    rows = spark.createDataFrame([("x", 1, "s"), ("y", 2, "s"), ("x", 1, "s"), ("x", 2, "t")], "m string, b int, s string")
    got = benchmark.schedule(rows, ["b", "m", "s"]).orderBy("place").collect()
    assert [(r.b, r.m, r.s) for r in got] == list(product((1, 2), "xy", "st")) and [r.place for r in got] == list(range(1, 9)) and [r.block for r in got] == [1] * 4 + [2] * 4
    assert {(r.b, r.m, r.s): r.n for r in got if not r.missing} == {(1, "x", "s"): 2, (2, "y", "s"): 1, (2, "x", "t"): 1}
    assert all((r.n == 0) == r.missing for r in got)


def test_energy_is_the_same_in_values_and_modes(spark):
    cells = grid(spark, (3, 2, 3), coupled)
    own = transform.diagnosis(transform.coefficients(cells, "prior"), cells, "prior").first()
    values = np.array([r.prior for r in cells.collect()])
    assert own.whole and not own.flat and own.n_cells == 18
    assert own.mean_square == pytest.approx((values**2).mean(), abs=1e-6) and own.variance == pytest.approx(values.var(), abs=1e-6)
    assert 0 <= own.share_1 <= own.share_2 <= 1
    flat = cells.withColumn("same", F.lit(2.5))
    told = transform.diagnosis(transform.coefficients(flat, "same"), flat, "same").first()
    assert told.flat and told.whole and told.share_1 is None and told.variance == 0


def test_a_stable_prefix_keeps_the_order_of_ties(spark):
    rows = spark.createDataFrame([(k, g, float(v)) for k, (g, v) in enumerate([("a", 1), ("a", 2), ("a", 2), ("b", 0), ("a", 2), ("a", 3)])], "i long, g string, v double")
    got = selection.stable_prefix(rows, "v", "i", 3, "g").collect()
    assert sorted((r.g, r.place, r.i) for r in got) == [("a", 1, 5), ("a", 2, 1), ("a", 3, 2), ("b", 1, 3)]


def test_diversity_of_the_best(spark):
    rows = [("f", f"id{k}", float(10 - k), *d) for k, d in enumerate([(0, 1, 2), (0, 1, 1), (2, 0, 0), (1, 1, 1), (0, 0, 1)])] + [("g", "only", 1.0, 1, 0, 0)]
    df = spark.createDataFrame(rows, "f string, id string, p double, d0 int, d1 int, d2 int")
    got = {r.f: r for r in folds.top_diversity(df, "p", "id", 4, ["d0", "d1", "d2"], "f").collect()}
    top = [r[3:] for r in rows[:4]]
    assert got["f"].n_top == 4 and got["f"].n_orders == 3 and got["f"].n_ids == 4
    assert got["f"].mean_distance == pytest.approx(np.mean([sum(x != y for x, y in zip(a, b)) for a, b in combinations(top, 2)]), abs=1e-6)
    assert got["g"].n_top == 1 and got["g"].mean_distance is None


def test_orders_have_names(spark):
    got = spark.range(5).select("id", C.order_label(F.col("id")).alias("n")).collect()
    assert [r.n for r in sorted(got)] == ["reference", "single", "pairwise", "third-order", "4th-order"]
