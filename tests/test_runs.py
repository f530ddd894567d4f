import random

import pytest

from tessera.jobs import iterative
from tessera.operators import runs
from tessera.streaming import runs as streamed

P = runs.Protocol(design_steps=2, cells=2, folds=2)
LEGAL = ["prepared", "attempt_started", "design", "design", "selection", "fit", "fit", "cell", "attempt_started", "fit", "fit", "cell", "attempt_completed", "report"]


def plain(kinds):
    """The state after a journal without gaps, one event at a time."""
    state, error = dict.fromkeys(runs.FIELDS, 0), ""
    for kind in kinds:
        error = error or streamed.step(state, kind, P)
    return state, error


def journals(seed):
    """run: kinds, from whole runs, whole ones with a fault, and random ones."""
    r, out = random.Random(seed), {}
    for run in range(120):
        kinds = list(LEGAL)
        if run % 3 == 1:
            kinds[r.randrange(len(kinds))] = r.choice([*runs.KINDS, "unheard", None])
        elif run % 3 == 2:
            kinds = ["prepared", *(r.choice(runs.KINDS) for _ in range(r.randrange(20)))]
        out[run] = kinds[: r.randrange(1, len(kinds) + 1)] if run % 4 == 3 else [*kinds, *(["fit"] if run % 5 == 0 else [])]
    return out


@pytest.mark.parametrize("position", range(len(LEGAL)))
def test_every_kind_has_its_places(position):
    """Of the eight kinds, those that may follow each beginning of a whole run."""
    state, error = plain(LEGAL[:position])
    assert error == ""
    may = {k for k in runs.KINDS if streamed.step(dict(state), k, P) == ""}
    assert LEGAL[position] in may and ("prepared" in may) == (position == 0)
    if LEGAL[position] in ("selection", "cell", "report", "prepared", "attempt_completed"):
        # what must happen here, besides attempts that may start
        assert may - {"attempt_started"} == {LEGAL[position]}


def test_replay_against_one_event_at_a_time(spark):
    told = journals(1)
    rows = [(run, seq, kind) for run, kinds in told.items() for seq, kind in enumerate(kinds)]
    rows += rows[::3] + [(7, None, "fit")]
    got = {r.run: r for r in runs.replay(spark.createDataFrame(rows, "run long, seq long, kind string").repartition(4), "run", P).collect()}
    assert set(got) == set(told) and {r.status for r in got.values()} == {"failed", "reported", "open"}
    for run, kinds in told.items():
        state, error = plain(kinds)
        assert {f: got[run][f] for f in runs.FIELDS} == state and got[run].error == error
        assert got[run].n_events == len(kinds) and got[run].n_waiting == 0


def test_events_behind_a_gap_wait(spark):
    rows = [(1, 0, "prepared"), (1, 2, "design"), (1, 3, "report"), (2, 1, "design")]
    got = {r.run: r for r in runs.replay(spark.createDataFrame(rows, "run long, seq long, kind string"), "run", P).collect()}
    assert (got[1].n_applied, got[1].n_waiting, got[1].status, got[1].error) == (1, 2, "waiting", "")
    assert (got[2].n_applied, got[2].n_waiting, got[2].status) == (0, 1, "waiting")
    assert runs.replay(spark.createDataFrame([], "run long, seq long, kind string"), "run", P).count() == 0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_a_stream_in_parts_ends_in_the_state_of_a_replay(spark, rocks, tmp_path):
    """Late, repeated and lost events; the states that a stream tells last are those of the whole journal."""
    r = random.Random(5)
    rows = [(run, seq, kind) for run, kinds in journals(2).items() for seq, kind in enumerate(kinds) if r.random() > 0.01]
    r.shuffle(rows)
    schema = "run long, seq long, kind string"
    source, told = tmp_path / "in", {}

    def last(batch, number):
        for x in batch.collect():
            told[x.run] = x

    for k in range(3):
        part = rows[k::3] + r.sample(rows, 100)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = streamed.reduce_runs(spark.readStream.schema(schema).parquet(str(source)), "run", P)
        query = stream.writeStream.foreachBatch(last).outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
    want = {x.run: x for x in runs.replay(spark.createDataFrame(rows, schema), "run", P).collect()}
    assert {x.status for x in want.values()} == {"failed", "reported", "open", "waiting"}
    columns = ["n_events", *runs.FIELDS, "error", "n_waiting", "status"]
    assert {k: [x[c] for c in columns] for k, x in told.items()} == {k: [x[c] for c in columns] for k, x in want.items()}


def test_the_table_as_one_batch_is_the_replay(spark, rocks):
    events = iterative.journals(spark, "/root/testdata/sf0.001")
    columns = ["o_custkey", "n_events", *runs.FIELDS, "error", "n_waiting", "status"]
    got, want = (df.select(columns).collect() for df in (streamed.reduce_runs(events, "o_custkey", iterative.PROTOCOL), runs.replay(events, "o_custkey", iterative.PROTOCOL)))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
