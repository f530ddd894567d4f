import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import scoring, selection
from tessera.sources import files

from test_lattice import coupled, grid


def test_raw_rows_are_classified_and_none_dropped(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("sequence,extra,label\nABCD,x,1.5\nAACD,x,\nABC,x,1\nAZCD,x,1\nABCA,x,2\nAACD,x,nan\nAACD,x,-0.5\n,x,3\n")
    rows = files.classify(files.read_raw(spark, str(path)), "ABCD", [0, 1], "ABCD").collect()
    assert [r.status for r in rows] == ["ok", "missing_label", "wrong_length", "invalid_level", "off_site", "missing_label", "ok", "wrong_length"]
    assert rows[6].value == -0.5 and [tuple(x) for x in rows[6].cell] == [(1, "B", "A")] and rows[0].cell == []
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_raw(spark, str(path))


def test_stores(spark, tmp_path):
    good = '{"cell_code": 1, "score": 0.5, "variance": 0.1}\n'
    path = tmp_path / "store.jsonl"
    path.write_text(good + good.replace("1,", "2,", 1))
    assert files.read_store(spark, str(path)).count() == 2
    path.write_text(good + good)
    with pytest.raises(PySparkException):
        files.read_store(spark, str(path)).collect()
    path.write_text(good + '{"cell_code": 2, "sc')
    with pytest.raises(PySparkException):
        files.read_store(spark, str(path)).collect()
    assert [r.cell_code for r in files.read_torn_store(spark, str(path)).collect()] == [1]
    path.write_text('{"cell_code": 2, "sc\n' + good)
    with pytest.raises(PySparkException):
        files.read_torn_store(spark, str(path)).collect()


def test_sequences_specs_and_one_write(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">name here\nacd\nEF\n")
    row = files.read_sequence(spark, str(tmp_path / "a.fasta")).first()
    assert (row.name, row.sequence) == ("name here", "ACDEF")
    (tmp_path / "s.txt").write_text("variant,score\nV39A D40C,1\n\nbad\nG1A\n")
    rows = files.read_specs(spark, str(tmp_path / "s.txt")).collect()
    assert [r.spec for r in rows] == ["V39A D40C", "bad", "G1A"] and rows[1].cell is None and len(rows[0].cell) == 2
    df = spark.range(2)
    files.write_once(df, str(tmp_path / "out"))
    with pytest.raises(PySparkException):
        files.write_once(df, str(tmp_path / "out"))


def test_unique_scores_give_what_scoring_each_row_would(spark):
    pool_cells = grid(spark, (3, 3, 2), coupled)
    pool = selection.scored(pool_cells)
    planned, means = scoring.plan(pool, 3, "s"), scoring.marginals(pool_cells, "prior")
    assert scoring.unique(planned).count() < planned.count()
    got = {r.cell_code: r for r in scoring.finalize(planned, scoring.score(scoring.unique(planned), means)).collect()}
    rows = pool_cells.collect()
    value = {(r.d0, r.d1, r.d2): r.prior for r in rows}

    def mean(pattern):
        hit = [v for d, v in value.items() if all(p in ("*", str(x)) for p, x in zip(pattern.split(","), d))]
        return sum(hit) / len(hit)

    sums = {}
    for r in planned.collect():
        sums[r.cell_code, r["pass"]] = sums.get((r.cell_code, r["pass"]), 0) + mean(r.pattern) - mean(r.base)
    for c, r in got.items():
        others = [sums[c, p] for p in (1, 2, 3)]
        m = sum(others) / 3
        assert abs(r.score - sums[c, 0]) < 1e-5 and abs(r.variance - sum((x - m) ** 2 for x in others) / 3) < 1e-5
    assert pool.where(F.col("ord") == 1).count() == 5
