from itertools import combinations, product
from math import log

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import cells as C
from tessera.operators import lattice, selection, transform
from tessera.sources import landscapes


def grid(spark, sizes, value, skip=()):
    """A landscape in memory: every combination of levels but those to skip, with a value of its digits."""
    rows, radix, total = [], [], 1
    for q in sizes:
        radix.append(total)
        total *= q
    for d in product(*map(range, sizes)):
        if d in skip:
            continue
        v = [chr(65 + x) for x in d]
        rows.append((sum(x * r for x, r in zip(d, radix)), *d, *radix, *v, *["A"] * len(d), sum(x > 0 for x in d), float(value(d)), float(value(d)), 0.1 + 0.01 * sum(d)))
    n = len(sizes)
    names = ["cell_code bigint", *[f"d{k} int" for k in range(n)], *[f"r{k} bigint" for k in range(n)], *[f"v{k} string" for k in range(n)], *[f"w{k} string" for k in range(n)], "ord int", "dg double", "prior double", "prior_var double"]
    return spark.createDataFrame(rows, ", ".join(names))


def brute(value, d):
    support = [k for k, x in enumerate(d) if x]
    return sum((-1) ** (len(support) - m) * value(tuple(x if k in sub else 0 for k, x in enumerate(d))) for m in range(1, len(support) + 1) for sub in combinations(support, m))


def coupled(d):
    return 0.3 * sum(d) + 0.8 * (d[0] > 0 and d[1] > 0) + 2.25 * (sum(x > 0 for x in d) == 3)


def test_contrasts_are_signed_sums_over_all_subcells(spark):
    cells = grid(spark, (3, 2, 3, 2), coupled)
    got = {r.term: r.eps for r in lattice.contrasts(cells.where("ord between 2 and 4"), cells.select("cell_code", "dg"), "dg", strict=True).collect()}
    for r in cells.where("ord >= 2").collect():
        d = (r.d0, r.d1, r.d2, r.d3)
        assert abs(got[r.cell_code] - brute(coupled, d)) < 1e-8


def test_additive_values_have_no_contrast(spark):
    cells = grid(spark, (3, 3, 3), lambda d: 0.5 * d[0] - 0.2 * d[1] + log(1 + d[2]))
    assert lattice.contrasts(cells.where("ord >= 2"), cells.select("cell_code", "dg"), "dg", strict=True).where("abs(eps) > 1e-8").count() == 0


def test_missing_members_raise_or_drop(spark):
    cells = grid(spark, (2, 2, 2), coupled)
    holes = cells.where("cell_code <> 1").select("cell_code", "dg")
    with pytest.raises(PySparkException):
        lattice.contrasts(cells.where("ord >= 2"), holes, "dg", strict=True).collect()
    kept = lattice.contrasts(cells.where("ord >= 2"), holes, "dg", strict=False).collect()
    assert {r.term for r in kept} == {6}


def test_candidates_and_coverage_follow_the_closed_form(spark):
    cells = grid(spark, (4, 4, 4), coupled)
    got = {r.ord: r.n for r in lattice.candidates(cells, 3).groupBy("ord").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 9, 2: 27, 3: 27}
    loops = cells.join(lattice.coverage(cells).withColumnRenamed("member", "cell_code"), "cell_code").groupBy("ord").agg(F.min("loops").alias("a"), F.max("loops").alias("b")).collect()
    assert {(r.ord, r.a, r.b) for r in loops} == {(k, n, n) for k, n in lattice.analytic_coverage(3, 4, 3)}


def test_spectrum_adds_up_to_the_variance_and_finds_the_only_mode(spark):
    cells = grid(spark, (3, 5, 2), coupled)
    spec = transform.spectrum(transform.coefficients(cells, "dg"))
    total = spec.where("ord > 0").agg(F.sum("energy")).first()[0]
    assert abs(total - cells.agg(F.var_pop("dg")).first()[0]) < 1e-7
    bump = grid(spark, (2, 2, 2), lambda d: (-1) ** d[0] * (-1) ** d[2])
    modes = transform.coefficients(bump, "dg").where("abs(coef) > 1e-9").collect()
    assert [(r.k0, r.k1, r.k2) for r in modes] == [(1, 0, 1)]


def test_transform_refuses_holes(spark):
    with pytest.raises(PySparkException):
        transform.coefficients(grid(spark, (2, 2), coupled_two, skip={(1, 1)}), "dg").collect()


def coupled_two(d):
    return float(d[0] * d[1])


def test_kernel_is_the_product_of_explicit_modes(spark):
    cells = grid(spark, (3, 3, 3, 3), coupled)
    got = {(r.u, r.v): r.k2 for r in transform.order_kernels(cells.where("cell_code < 12"), cells.where("cell_code > 60"), 4, 3).collect()}
    basis = transform.helmert(3)
    rows = {r.cell_code: (r.d0, r.d1, r.d2, r.d3) for r in cells.collect()}
    for (u, v), k in got.items():
        a, b = rows[u], rows[v]
        want = sum(basis[m][a[s]] * basis[m][b[s]] * basis[n][a[t]] * basis[n][b[t]] for s, t in combinations(range(4), 2) for m in (1, 2) for n in (1, 2))
        assert abs(k - want) < 1e-8


def test_selection_breaks_ties_by_seed_and_not_by_input_order(spark):
    cells = grid(spark, (3, 3, 3), coupled)
    pool = selection.scored(cells)
    one = [r.cell_code for r in selection.top(pool, "structural", 7).orderBy("rank").collect()]
    two = [r.cell_code for r in selection.top(pool.orderBy(F.desc("cell_code")), "structural", 7).orderBy("rank").collect()]
    other = [r.cell_code for r in selection.top(pool, "structural", 7, seed="else").orderBy("rank").collect()]
    assert one == two != other
    longer = [r.cell_code for r in selection.top(pool, "structural", 12).orderBy("rank").collect()]
    assert longer[:7] == one
    assert "dg" not in pool.columns and "measure" not in pool.columns
    with pytest.raises(ValueError):
        selection.top(pool, "info", 0)
    with pytest.raises(PySparkException):
        selection.varied(pool.withColumn("info", F.lit(0.0)), "info").collect()


def test_practice_takes_as_few_singles_as_fill_the_budget(spark):
    cells = grid(spark, (3, 3, 3), coupled)
    rows = {r.cell_code: r for r in cells.collect()}
    singles = sorted((r for r in rows.values() if r.ord == 1), key=lambda r: (-r.prior, r.cell_code))
    for budget in (1, 3, 5, 50):
        got = [r.cell_code for r in selection.practice(selection.scored(cells), budget).orderBy("rank").collect()]
        pairs = []
        for k in range(2, len(singles) + 1):
            pairs = [a.cell_code + b.cell_code for a, b in combinations(singles[:k], 2) if not any(x and y for x, y in zip((a.d0, a.d1, a.d2), (b.d0, b.d1, b.d2)))]
            if len(pairs) >= budget:
                break
        assert got == sorted(pairs, key=lambda c: (-rows[c].prior, c))[:budget]


def test_cells_are_named_written_and_read(spark):
    df = spark.createDataFrame([("VDGV", "VDGV"), ("ADGC", "VDGV"), ("VDGV"[:3] + "A", "VDGV")], "seq string, ref string").withColumn("cell", C.diff(F.col("seq"), F.col("ref")))
    rows = df.select("seq", C.canonical_id(F.col("cell")).alias("id"), C.short_id(F.col("cell")).alias("short"), C.notation(F.col("cell")).alias("spec"), C.overlay(F.col("ref"), F.col("cell")).alias("again")).collect()
    assert [r.again for r in rows] == [r.seq for r in rows]
    assert rows[1].id == '[[0,"V","A"],[3,"V","C"]]' and rows[1].spec == "V1A V4C" and rows[0].short == "REF"
    back = spark.createDataFrame([("V4C V1A",), ("v1A",), ("",)], "spec string").select(C.canonical_id(C.parse_notation(F.col("spec"))).alias("id")).collect()
    assert [r.id for r in back] == ['[[0,"V","A"],[3,"V","C"]]', None, "[]"]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("AB", "ABC")], "s string, r string").select(C.diff(F.col("s"), F.col("r"))).collect()


def test_unknown_landscape():
    with pytest.raises(ValueError):
        landscapes.resolve("nope")
