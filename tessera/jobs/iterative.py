"""Queries that run in grouped functions or as streams: fits of small plates, and an incremental score store."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import design, folds, lattice, learners, runs, selection, transform
from ..operators.design import NOISE
from ..sources.landscapes import landscape
from . import sql as S
from .catalog import BUDGET, LAND, MAIN, POOL, query

METHODS = ("info", "structural", "prior")


def _plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, row, col, col_ord, y, fold): the long design of the plate of each selection method, with inner folds.

    The pool is read once and ranked by every method in one window.
    """
    cells = landscape(spark, sf_dir, MAIN)
    chosen = folds.deal(selection.tops(selection.scored(cells), METHODS, 2 * BUDGET), 3, "inner-1", "method").select("method", "cell_code", "fold")
    told = chosen.join(cells.select("cell_code", F.col("dg").alias("y")).where("y is not null"), "cell_code")
    return told.withColumnRenamed("cell_code", "row").join(transform.features(cells), "row").select("method", "row", "col", "col_ord", "y", "fold")


MAINS, PAIRS = [0.1, 1.0, 10.0], [1.0, 10.0, 100.0]


@query("ridge_cv")
def ridge_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalties of each plate with the least error over its inner folds."""
    return design.cross_validated(_plates(spark, sf_dir), ["method"], MAINS, PAIRS)


@query("ridge_weights")
def ridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of each plate at the penalties that cross-validation picks."""
    plates = _plates(spark, sf_dir)
    return design.weights(plates, ["method"], design.cross_validated(plates, ["method"], MAINS, PAIRS))


def _plate_sql() -> str:
    """``pl``: the long design of the plates of ``_plates``."""
    tops = [S.top(score, 2 * BUDGET, name=f"sel_{score}") for score in METHODS]
    union = " union all ".join(f"select '{score}' as method, cell_code from sel_{score}" for score in METHODS)
    return S.with_(S.land(MAIN), S.POOL, *tops, f"""pl as (
  select method, term as row, member as col, dg as y from ({union}) u join land l using (cell_code) join clo on term = l.cell_code where m_ord <= 2 and dg is not null
)""")


@query(
    "plate_gram",
    _plate_sql() + """, e as (select method, row, col as c, 1.0::double as x from pl union all select distinct method, row, -1, 1.0::double from pl union all select distinct method, row, -2, y from pl)
select method, a.c as i, b.c as j, round(sum(a.x * b.x), 6) as g from e a join e b using (method, row) where a.c <= b.c group by method, a.c, b.c""",
)
def plate_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal equations of each plate: all that a solver sees of it."""
    return design.gram(_plates(spark, sf_dir), ["method"]).withColumn("g", F.round("g", 6))


#: A fit whose conditions are broken by more than this share of the penalty hasn't converged.
GAP = 1e-4
RATIOS = [0.5, 0.2, 0.1, 0.05]


def _path(spark: SparkSession, sf_dir: str, solver: str) -> DataFrame:
    """method, ratio, support, mse, converged: a fit of its own for each plate and penalty, and whether it reached the minimum."""
    solve = {"lasso": learners.lasso, "fista": learners.fista}[solver]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x, y, *_ = learners.dense(group)
        x, y = x - x.mean(axis=0), y - y.mean()
        penalty = float(group["ratio"].iloc[0]) * learners.largest_penalty(x, y)
        w = solve(x, y, penalty)
        return pd.DataFrame({"support": [int((np.abs(w) > 1e-9).sum())], "mse": [round(float(((y - x @ w) ** 2).mean()), 7)], "converged": [learners.optimality_gap(x, y, penalty, w) <= GAP]})

    return learners.per_group(learners.grid(_plates(spark, sf_dir), {"ratio": RATIOS}), ["method", "ratio"], fit, "support int, mse double, converged boolean")


@query("lasso_path")
def lasso_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(spark, sf_dir, "lasso")


@query("fista_path")
def fista_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(spark, sf_dir, "fista")


@query("gcv_blup")
def gcv_blup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random effects of the prior's error on each plate: the chosen ratio and the effects."""
    cells = landscape(spark, sf_dir, MAIN).select(F.col("cell_code").alias("row"), "prior")
    plates = _plates(spark, sf_dir).join(cells, "row").withColumn("y", F.col("y") - F.col("prior"))
    return design.random_effects(plates, ["method"], np.append(np.logspace(-3, 4, 11), np.inf))


#: The orders of modes that a design is to tell: all but the highest, or single dimensions and pairs.
TARGETS = {"all": (1, 2, 3), "pairs": (1, 2)}


def _d_optimal_sql() -> str:
    def kernel(orders: tuple[int, ...], digits: str = "p.d{k}") -> str:
        same = [f"(case when d{k} = {digits.format(k=k)} then 1.0 else 0.0 end - 1.0 / q{k})" for k in range(4)]
        return " + ".join(" * ".join(same[k] if m >> k & 1 else f"(1.0 / q{k})" for k in range(4)) for m in range(1, 16) if m.bit_count() in orders)

    of = lambda digits="p.d{k}": "case target " + " ".join(f"when '{t}' then {kernel(o, digits)}" for t, o in TARGETS.items()) + " end"
    order = "open desc, round(greatest(var, 0), 9) desc, ident"
    columns = "target, cell_code, ident, d0, d1, d2, d3, q0, q1, q2, q3"
    return POOL.replace("with ", "with recursive ", 1) + f""", q as (select max(d0) + 1 as q0, max(d1) + 1 as q1, max(d2) + 1 as q2, max(d3) + 1 as q3 from land), s0 as (
  select *, {of("d{k}")} as var from (select unnest({list(TARGETS)}) as target, cell_code, ident, d0, d1, d2, d3, q.* from pool, q)
), st(step, {columns}, u, var, open) as (
  select 0, {columns}, []::double[], var::double, true from s0
  union all
  select step + 1, {columns}, list_append(u, c / sqrt({NOISE} + greatest(p.var, 0))), var - (c / sqrt({NOISE} + greatest(p.var, 0))) ** 2, open and cell_code <> p.cell_code from (
    select *, ({of()}) - case when len(u) = 0 then 0.0 else list_inner_product(u, p.u) end as c from (
      select *, first_value(struct_pack(cell_code := cell_code, d0 := d0, d1 := d1, d2 := d2, d3 := d3, u := u, var := var)) over (partition by target order by {order}) as p from st where step < {BUDGET // 2}
    )
  )
)
select target, (step + 1)::int as rank, cell_code, round(greatest(var, 0), 6) as variance from st where step < {BUDGET // 2} and open qualify row_number() over (partition by target, step order by {order}) = 1"""


@query("d_optimal", _d_optimal_sql())
def d_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One design over the candidates of all orders for each target: always the cell whose value is least certain."""
    cells = landscape(spark, sf_dir, MAIN)
    return design.d_optimal(cells, lattice.candidates(cells, 3).join(selection.scored(cells).select("cell_code", "ident"), "cell_code"), BUDGET // 2, TARGETS)


@query(
    "journal_replay",
    """with c as (select conv_id, turn, role, coalesce(lag(role) over (partition by conv_id order by turn), '') as before from conversations)
select conv_id, count(*)::int as n_events, max_by(role, turn) as last_kind, (count(*) filter (before || '>' || role not in ('>user', '>system', 'system>user', 'user>assistant', 'assistant>user')))::int as n_illegal from c group by conv_id""",
)
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as journals: each is folded in order into a state, and steps that may not follow are counted."""
    from ..operators import journal
    from ..sources.tables import table

    return journal.replay(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", {"": ["user", "system"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]})


#: A whole run: two design steps, two cells of one fold each, and a second attempt after one that is abandoned.
PROTOCOL = runs.Protocol(design_steps=2, cells=2, folds=1)
SCRIPT = ("prepared", "attempt_started", "design", "design", "selection", "fit", "cell", "attempt_started", "fit", "cell", "attempt_completed", "report")


def journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_custkey, seq, kind: the orders of a customer as a run's journal, some steps out of their turn and some lost on the way."""
    from pyspark.sql import Window

    from ..sources.tables import table

    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", seq.alias("seq"))
    turn = F.when(F.col("o_orderkey") % 23 == 0, F.col("seq") + 1).when(F.col("o_orderkey") % 29 == 0, F.col("seq") * 5 + 3).otherwise(F.col("seq"))
    return rows.where(F.col("o_orderkey") % 41 != 5).select("o_custkey", F.col("seq").cast("long").alias("seq"), F.get(F.array(*map(F.lit, SCRIPT)), (turn % len(SCRIPT)).cast("int")).alias("kind"))


def _runs_sql() -> str:
    fields = ", ".join(runs.FIELDS)
    changed = ", ".join(f"case when err <> '' then {f} else {c} end" for f, c in runs.changes_sql().items())
    return f"""with recursive nu as (
  select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as seq from orders
), ev as (
  select o_custkey, seq, {list(SCRIPT)}[(case when o_orderkey % 23 = 0 then seq + 1 when o_orderkey % 29 = 0 then seq * 5 + 3 else seq end) % {len(SCRIPT)} + 1] as kind from nu where o_orderkey % 41 <> 5
), st(o_custkey, step, {fields}, error) as (
  select distinct o_custkey, 0, {", ".join("0" for _ in runs.FIELDS)}, '' from ev
  union all
  select o_custkey, step + 1, {changed}, err from (select st.*, kind, {runs.error_sql(PROTOCOL)} as err from st join ev using (o_custkey) where ev.seq = st.step and error = '')
), n as (
  select o_custkey, count(*) as n_events, count(*) filter (seq <> place) as n_waiting from (select *, row_number() over (partition by o_custkey order by seq) - 1 as place from ev) group by o_custkey
)
select o_custkey, n_events::int as n_events, {fields}, error, n_waiting::int as n_waiting, case when error <> '' then 'failed' when reported = 1 then 'reported' when n_waiting > 0 then 'waiting' else 'open' end as status
from (select * from st qualify row_number() over (partition by o_custkey order by step desc) = 1) join n using (o_custkey)"""


@query("run_states", _runs_sql())
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every run after its whole journal."""
    return runs.replay(journals(spark, sf_dir), "o_custkey", PROTOCOL)


@query("incremental_scores", LAND + "select cell_code, prior as score from land where ord between 1 and 3 and cell_code % 3 <> 0")
def incremental_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of candidates that the store lacks, as a batch of a stream would add them."""
    from ..streaming import scores

    cells = landscape(spark, sf_dir, MAIN)
    stored = cells.where("cell_code % 3 = 0 and ord between 1 and 3").select("cell_code", F.col("prior").alias("score"))
    wanted = lattice.candidates(cells, 3).select("cell_code")
    return scores.missing(wanted, stored).join(cells.select("cell_code", F.col("prior").alias("score")), "cell_code")
