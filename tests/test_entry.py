import duckdb
import pytest

import __spark_entry__ as entry
from tessera.jobs import catalog
from tessera.streaming import scores

DATA = "/root/testdata/sf0.001"
SOME = ("landscape_mixed225", "top_pairwise_contrasts", "notation_parse", "key_audit", "chain_audit", "journal_replay", "raw_status_counts", "spectrum_mixed225", "value_profile", "hierarchical_bootstrap", "benchmark_cells", "label_accounting", "method_ranking", "seed_means")


def views():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_every_sql_is_text_that_runs(name):
    assert isinstance(entry.oracle_sql()[name], str)
    tables = views()
    assert tables.sql(entry.oracle_sql()[name]).columns and tables.execute(entry.oracle_sql()[name]).fetchall() is not None


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", SOME)
def test_small_queries_against_sql(spark, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    frame = views().sql(catalog.oracle_sql()[name])
    want = sorted((tuple(plain(dict(zip(frame.columns, r))[c]) for c in columns) for r in frame.fetchall()), key=repr)
    assert sorted(frame.columns) == columns and rows == want


def test_score_stream_scores_each_key_once(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    scorer = lambda df: df.selectExpr("cell_code", "cell_code * 2.0 as score")
    for part in ([1, 2, 2, 3], [3, 4], []):
        spark.createDataFrame([(k,) for k in part], "cell_code long").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("cell_code long").parquet(str(source))
        scores.score_stream(stream, str(store), scorer, str(tmp_path / "checkpoint")).awaitTermination(60)
    rows = spark.read.parquet(f"{store}/batch=*").collect()
    assert sorted((r.cell_code, r.score) for r in rows) == [(1, 2.0), (2, 4.0), (3, 6.0), (4, 8.0)]
