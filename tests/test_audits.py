import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.jobs import evidence_trail
from tessera.operators import artifacts, audit, conformance, profile

FILES = [
    ("a.json", '{"n": 1234, "m": -0.5, "s": "x", "list": [7, {"k/y": 2}], "z": 0, "01": 5, "o\'k": 3}'), ("bad.json", "{"), ("gone.json", None),
    ("r.py", "code"), ("figures/ok.png", "pixels"), ("figures/odd.png", "p"), ("figures/none.png", "p"), ("doc.md", "n is 1,234; m is −0.50; half: 617.0 ![x](figures/ok.png) ![y](figures/new.png#a) ![](http://e/figures/z.png) ![](figures/odd.png) ![](figures/none.png)"),
]


@pytest.fixture(scope="module")
def trail(spark):
    files = spark.createDataFrame([f for f in FILES if f[1] is not None], "path string, content string")
    listed = [("a.json", "data", None), ("bad.json", "data", None), ("gone.json", "data", None), ("figures/ok.png", "result", "r.py"), ("figures/odd.png", "result", "lost.py"), ("figures/none.png", None, None)]
    manifest = spark.createDataFrame([(p, k, r) for p, k, r in listed], "path string, kind string, renderer string").join(files, "path", "left").select("path", F.coalesce(F.sha2("content", 256), F.lit("x")).alias("sha256"), "kind", "renderer")
    said = [
        ("n", "a.json", "/n", "grouped", 0, None, "1,234", "n is 1,234", "ok"), ("m", "a.json", "/m", "round", 2, None, "−0.50", "m is −0.50", "ok"), ("half", "a.json", "/n", "ratio", 1, "/list/1/k~1y", "617.0", "half: 617.0", "ok"),
        ("nowhere", "a.json", "/list/2", "round", 0, None, "1", "1", "pointer not found"), ("rootless", "a.json", "n", "round", 0, None, "1", "1", "pointer not found"), ("text", "a.json", "/s", "round", 0, None, "1", "1", "not a number"),
        ("nought", "a.json", "/n", "ratio", 0, "/z", "1", "1", "invalid denominator"), ("no-over", "a.json", "/n", "ratio", 0, None, "1", "1", "invalid denominator"), ("wrong", "a.json", "/list/0", "identity", 0, None, "8", "8", "renders otherwise"),
        ("unsaid", "a.json", "/list/0", "identity", 0, None, "7", "seven 7", "not in its document"), ("digits", "a.json", "/01", "identity", 0, None, "5", "5 there", "not in its document"), ("quote", "a.json", "/o'k", "identity", 0, None, "3", "3 there", "not in its document"),
        ("broken", "bad.json", "/n", "round", 0, None, "1", "1", "not a JSON document"), ("missing", "gone.json", "/n", "round", 0, None, "1", "1", "missing artifact"), ("other", "figures/x", "/n", "round", 0, None, "1", "1", "unlisted artifact"),
        ("pixels", "figures/ok.png", "/n", "round", 0, None, "1", "1", "not a JSON document"),
    ]
    claims = spark.createDataFrame([(i, "doc.md", a, p, t, d, False, True, o, r, h) for i, a, p, t, d, o, r, h, _ in said], "id string, document string, artifact string, pointer string, transform string, digits int, plus boolean, minus boolean, denominator string, rendered string, anchor string")
    return files, manifest, claims, {s[0]: s[-1] for s in said}


def test_claims_are_traced_to_the_first_thing_that_is_wrong(trail):
    files, manifest, claims, want = trail
    assert {r.id: r.status for r in artifacts.audit_claims(claims, manifest, files).collect()} == want


def test_a_missing_target_is_an_error(trail):
    files, manifest, claims, want = trail
    found = artifacts.audit_claims(claims, manifest, files)
    good = [i for i, s in want.items() if s == "ok"]
    assert artifacts.strict(found.where(F.col("id").isin(good)), "id").count() == len(good)
    for name in ("nowhere", "missing", "other", "broken"):
        with pytest.raises(PySparkException, match=want[name]):
            artifacts.strict(found.where(F.col("id") == name), "id").collect()


def test_figures_and_literals(trail):
    files, manifest, claims, _ = trail
    got = {r.path: r.status for r in artifacts.audit_figures(files.where("path = 'doc.md'"), manifest, files, claims, "figures").collect()}
    assert got == {"figures/ok.png": "ok", "figures/new.png": "unlisted figure", "figures/odd.png": "missing renderer", "figures/none.png": "figure of no kind"}
    assert [tuple(r) for r in artifacts.forbidden(files, ["half", "never"]).collect()] == [("doc.md", "half")]
    altered = files.withColumn("content", F.when(F.col("path") == "a.json", F.concat("content", F.lit(" "))).otherwise(F.col("content")))
    assert {r.status for r in artifacts.audit_claims(claims.where("id = 'n'"), manifest, altered).collect()} == {"checksum differs"}


def test_digests_do_not_depend_on_order_or_partitions(spark):
    rows = spark.range(20_000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    one = audit.tree_digest(rows, F.col("id")).first()
    many = audit.tree_digest(rows.orderBy(F.desc("id")).repartition(13).unionByName(rows.limit(500)), F.col("id")).first()
    assert one == many and one.n == 20_000
    assert audit.tree_digest(rows.where("id <> 7"), F.col("id")).first().digest != one.digest
    # groups of different sizes give what each gives alone
    mixed = rows.where("g = 0 or id < 600")
    by = {r.g: r.digest for r in audit.tree_digest(mixed, F.col("id"), "g").collect()}
    assert by == {g: audit.tree_digest(mixed.where(f"g = {g}"), F.col("id")).first().digest for g in range(3)}
    assert audit.tree_digest(rows.where("false"), F.col("id")).count() == 0
    swapped = rows.withColumn("g", F.when(F.col("id") == 1, 0).when(F.col("id") == 0, 1).otherwise(F.col("g")))
    assert audit.map_digest(rows, F.col("id"), F.col("g")).first().digest != audit.map_digest(swapped, F.col("id"), F.col("g")).first().digest


def test_sequences(spark):
    rows = spark.range(3000).select("id", (F.col("id") * 7 % 11).alias("x"))
    a, b = (audit.sequence_digest(df, "id", F.col("x")).first() for df in (rows, rows.repartition(9)))
    assert a == b and a.n == 3000
    assert audit.sequence_digest(rows.withColumn("x", F.when(F.col("id") < 2, 1 - F.col("id")).otherwise(F.col("x"))), "id", F.col("x")).first().digest != a.digest
    assert audit.sequence_digest(rows.limit(1), "id", F.col("x")).count() == 1 and audit.sequence_digest(rows.where("false"), "id", F.col("x")).count() == 0
    for wrong in (rows.where("id <> 5"), rows.unionByName(rows.limit(1))):
        with pytest.raises(ValueError):
            audit.sequence_digest(wrong, "id", F.col("x"))


def test_an_outlier_leaves_no_group_whole(spark):
    """Among distinct values and one of 1e300 each task orders the few values around a place."""
    n = 250_000
    rows = spark.range(n).select(F.when(F.col("id") == 3, 1e300).otherwise(F.sqrt(F.col("id").cast("double")) * F.when(F.col("id") % 2 == 0, -1).otherwise(1)).alias("v"), F.lit("g").alias("g"))
    values = np.sqrt(np.arange(n)) * np.where(np.arange(n) % 2 == 0, -1, 1)
    values[3] = 1e300
    shares = {"q0": 0.0, "q05": 0.05, "median": 0.5, "q99": 0.99, "q1": 1.0}
    found = audit.quantiles(rows, "v", shares, "g")
    got = found.first()
    assert np.allclose([got[k] for k in shares], np.quantile(values, list(shares.values())))
    # how many values lie between the limits of the median
    cuts = rows.agg(F.percentile_approx("v", [0.5 - 5 / audit.ACCURACY, 0.5 + 5 / audit.ACCURACY], audit.ACCURACY).alias("c")).first().c
    assert ((values >= cuts[0]) & (values <= cuts[1])).sum() < n / 100


def test_every_status_of_a_run(spark):
    protocol = spark.createDataFrame([("a", "x", None), ("n", "5", 5)], "field string, expected string, expected_size int")
    rows = [  # run, a, n, missing, repeated, status
        (1, "x", 5, 0, 0, "mine"), (2, "x", 3, 0, 0, "smoke_or_exploratory_profile"), (3, "x", 3, 1, 0, "nonconforming_protocol_profile"), (4, "x", 6, 0, 0, "nonconforming_protocol_profile"), (5, "y", 5, 0, 0, "nonconforming_protocol_profile"),
        (6, None, 5, 0, 0, "nonconforming_protocol_profile"), (7, "x", 5, 2, 0, "insufficient_valid_partitions"), (8, "x", 5, 2, 1, "nonconforming_protocol_profile"),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "run int, a string, n int, n_missing int, n_repeated int")
    configs = conformance.unpivoted(df, "run", {"a": (F.col("a"), None), "n": (F.col("n"), F.col("n"))})
    got = conformance.compared(configs, protocol, "run").join(df, "run").select("run", "mismatches", conformance.status(F.lit("mine")).alias("status")).collect()
    assert {r.run: r.status for r in got} == {r[0]: r[-1] for r in rows} and {r.run: r.mismatches for r in got}[5] == "a"
    lacks = conformance.compared(configs.where("run = 1 and field = 'a'"), protocol, "run").first()
    assert lacks.mismatches == "n" and not lacks.conforming and not lacks.smaller


def test_given_tables_show_every_status():
    c = duckdb.connect()
    for t in ("orders", "customer"):
        c.sql(f"create view {t} as select * from read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    from tessera.jobs import catalog

    found = {r[0] for r in c.sql(f"select distinct status from ({catalog.oracle_sql()['conformance']})").fetchall()}
    assert found == {"pass", "fail", "insufficient_valid_partitions", "smoke_or_exploratory_profile", "nonconforming_protocol_profile"}
    assert evidence_trail.PROTOCOL


def test_profile_in_any_order(spark):
    rows = spark.createDataFrame([("a", "x", 1, 2.5), ("a", "y", 2, None), ("b", "x", 1, -1.0), (None, "x", 3, 0.0)], "p string, q string, k int, v double")
    one, two = (profile.profile(df, ["p", "q"], "k", F.col("v"), F.col("v") > 0).first() for df in (rows, rows.orderBy(F.desc("k")).repartition(3)))
    assert one == two
    p = one.p
    assert p.n_rows == 4 and [(x.level, x.n) for x in p.levels.q] == [("x", 3), ("y", 1)] and {(x.level, x.n) for x in p.levels.p} == {("a", 2), ("b", 1), (None, 1)}
    assert p.n_cells == 4 and not p.complete and p.labels.n_labels == 3 and p.labels.n_positive == 1 and p.keys.n_keys == 3 and p.keys.n_repeated_keys == 1 and p.keys.most_of_a_key == 2
    assert profile.profile(rows, ["p"], "k", F.col("v"), F.col("v") > 0).first().p.n_cells == 3
    assert profile.profile(rows.where("false"), ["p"], "k", F.col("v"), F.col("v") > 0).first().p.n_rows == 0
