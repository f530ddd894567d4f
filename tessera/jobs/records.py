"""Registered queries of whole benchmark records, with SQL for what needs no system of equations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import benchmark, folds, lattice, records, transform
from ..operators.selection import SEED
from ..sources.tables import kept
from . import sql as S
from .catalog import POOL, _main, _pool, query
from .evidence import _DEALT, FOLDS, _dealt

BUDGETS = [12, 48]
MAINS, PAIRS = [0.1, 1.0, 10.0], [1.0, 10.0, 100.0]
_KEYS = ", ".join(records.CELL)


def _plates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells, dealt = _main(spark, sf_dir), _dealt(spark, sf_dir)
    aware = lattice.coverage(cells).withColumnRenamed("member", "cell_code")
    pool = records.pools(dealt, cells, benchmark.blind_coverage(cells, dealt, FOLDS), aware, FOLDS)
    return cells, dealt, kept(records.plates(pool, BUDGETS))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, dealt, plate = _plates(spark, sf_dir)
    features, rows = transform.features(cells), records.due(dealt, cells, FOLDS)
    fitted = kept(records.fits(plate, cells, features, MAINS, PAIRS))
    predicted = records.predictions(fitted, rows, features).unionByName(records.controls(records.slopes(plate, cells), rows))
    return records.records(records.accounting(plate, cells), fitted, records.scores(predicted, cells))


@query("benchmark_records")
def benchmark_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of two estimands, two regimes, five folds, three methods and two budgets, with four learners and two controls."""
    return _records(spark, sf_dir)


@query("record_summary")
def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means of the records over the folds."""
    return records.summaries(_records(spark, sf_dir))


_CELLS = _DEALT + f""", blind as (
  select held, member as cell_code, count(*) as loops from clo left join dealt on term = dealt.cell_code, h where t_ord between 2 and 3 and fold is distinct from held group by held, member
), out as (
  select held, p.cell_code, p.ord, p.ident, p.prior, p.prior_var, l.dg, coalesce(b.loops, 0)::double as lb, coalesce(a.loops, 0)::double as la
  from dealt p cross join h left join blind b using (held, cell_code) left join loops a on a.member = p.cell_code left join land l on l.cell_code = p.cell_code where fold is distinct from held
), o2 as (
  select *, unnest(['target_blind', 'target_aware']) as estimand, unnest([lb, la]) as lo from out
), o3 as (
  select o2.*, regime from o2, (select unnest(['attempted_budget', 'measured_available']) as regime) where regime = 'attempted_budget' or dg is not null
), o4 as (
  select *, unnest(['info', 'prior', 'structural']) as method, unnest([round(prior_var * lo, 9), prior, lo]) as score from o3
), o5 as (
  select *, row_number() over (partition by estimand, regime, held, method order by score desc, sha256('{SEED}:' || ident), ident) as rank, count(*) over (partition by estimand, regime, held, method) as pool_size from o4
), plate as (
  select o5.*, budget from o5, (select unnest({BUDGETS}) as budget) where rank <= budget
)"""


@query(
    "record_accounting",
    POOL + _CELLS + f""" select {_KEYS}, max(pool_size) as pool_size, count(*) as n_selected, sha256(string_agg(ident, chr(10) order by ident)) as selected_digest, count(dg) as n_train,
count(*) filter (ord = 1) as selected_1, count(*) filter (ord = 2) as selected_2, count(*) filter (ord = 3) as selected_3, count(dg) filter (ord = 1) as train_1, count(dg) filter (ord = 2) as train_2, count(dg) filter (ord = 3) as train_3,
count(*) filter (dg > 0) as n_positive, count(*) filter (dg = 0) as n_zero, count(*) filter (dg < 0) as n_negative, count(*) filter (dg is null) as n_missing, round(count(*) filter (dg > 0) / nullif(count(dg), 0), 6) as positive_fraction
from plate group by all""",
)
def record_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each cell selects and what that reveals."""
    cells, _, plate = _plates(spark, sf_dir)
    return records.accounting(plate, cells)


def _scores_sql() -> str:
    by = f"{_KEYS}, learner"
    top, rho = "mine <= budget", lambda k: f"round({S.pearson(f'(case when ord = {k} then pr end)', f'(case when ord = {k} then tr end)')}, 6)"
    return _CELLS + f""", sl as (
  select {_KEYS}, count(dg) as n, round(coalesce(sum(case when dg is not null then prior end * dg) / nullif(sum(case when dg is not null then prior * prior end), 0), 1.0), 9) as slope from plate group by all
), ctl as (
  select {_KEYS}, unnest(['zero_shot', 'circular']) as learner, unnest([1.0, slope]) as by_, n from sl
), ev as (
  select {by}, d.cell_code, d.ord, d.ident, round(by_ * d.prior, 9) as pred, l.dg from dealt d join ctl on d.fold = held join land l on l.cell_code = d.cell_code where l.dg is not null and (learner = 'zero_shot' or n > 0)
), re as (
  select *, case when dg > 0 then round(({S.avg_rank('dg', by + ', dg > 0')}) / count(*) over (partition by {by}, dg > 0), 9) else 0.0 end as relevance from ev
), rk as (
  select *, {S.avg_rank('pred', by + ', ord')} as pr, {S.avg_rank('dg', by + ', ord')} as tr, {S.avg_rank('pred', by)} as ppr, {S.avg_rank('dg', by)} as ptr,
         row_number() over (partition by {by} order by pred desc, ident) as mine, row_number() over (partition by {by} order by dg desc, ident) as best, row_number() over (partition by {by} order by relevance desc, ident) as ideal from re
), sc as (
  select {by}, count(*) as n_eval, {rho(2)} as rho_2, {rho(3)} as rho_3, round({S.pearson('ppr', 'ptr')}, 6) as spearman, round({S.pearson('pred', 'dg')}, 6) as pearson, round(sqrt(avg((pred - dg) ** 2)), 6) as rmse,
         round(case when max(relevance) = min(relevance) then 1.0 else coalesce(sum(relevance / log2(mine + 1)) filter ({top}) / nullif(sum(relevance / log2(ideal + 1)) filter (ideal <= budget), 0), 0.0) end, 6) as ndcg,
         round(count(*) filter ({top} and best <= budget) / count(*) filter ({top}), 6) as hit_rate, round(max(dg) filter ({top}), 6) as best_in_top, round(max(dg) - max(dg) filter ({top}), 6) as regret,
         round(count(*) filter ({top} and dg > 0) / count(*) filter ({top}), 6) as positive_top, count(distinct ord) filter ({top}) as order_diversity, count(distinct ident) filter ({top}) as identity_diversity
  from rk group by all
)"""


@query("control_scores", POOL + _scores_sql() + " select *, round((rho_2 + rho_3) / 2, 6) as macro from sc")
def control_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of the two controls, the prior as it is and the prior scaled to what a selection reveals."""
    cells, dealt, plate = _plates(spark, sf_dir)
    return records.scores(records.controls(records.slopes(plate, cells), records.due(dealt, cells, FOLDS)), cells)


_OVER = ["macro", "rho_2", "rho_3", "spearman", "pearson", "rmse", "ndcg", "hit_rate", "regret", "positive_top"]


@query(
    "control_summary",
    POOL + _scores_sql() + ", ma as (select *, round((rho_2 + rho_3) / 2, 6) as macro from sc) select estimand, regime, method, budget, count(*) as n_cells, " + ", ".join(f"round(avg({c}), 6) as mean_{c}" for c in _OVER) + " from ma where learner = 'circular' group by all",
)
def control_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means over folds of the scaled prior's scores."""
    cells, dealt, plate = _plates(spark, sf_dir)
    found = records.scores(records.controls(records.slopes(plate, cells), records.due(dealt, cells, FOLDS)), cells)
    return records.summaries(found.where("learner = 'circular'"), _OVER)


_PARTS, _SEEDS = 2, 3


def _seeded_sql() -> str:
    return f""", sp as (
  select part::int as partition, cell_code, ord, ident, prior, case when ord >= 2 then (row_number() over (partition by part, ord order by sha256('outer-' || (part + 1) || ':' || ident), ident) - 1) % {FOLDS} end as fold
  from pool, (select unnest(range({_PARTS})) as part)
), hs as (select unnest(range({FOLDS}))::int as held), rp as (
  select partition, held, seed::int as seed, cell_code, prior, row_number() over (partition by partition, held, seed order by sha256('cells-' || seed || ':' || ident), ident) as rank
  from sp, hs, (select unnest(range(1, {_SEEDS + 1})) as seed) where fold is distinct from held
), fs as (
  select partition, held, seed, budget, round(coalesce(sum(p.prior * dg) / nullif(sum(p.prior * p.prior), 0), 1.0), 9) as slope from (select rp.*, budget from rp, (select unnest({BUDGETS}) as budget) where rank <= budget) p join land l using (cell_code) where dg is not null group by all
), es as (
  select partition, held, seed, budget, sp.ord, round(slope * sp.prior, 9) as pred, dg from sp join fs using (partition) join land l using (cell_code) where fold = held and dg is not null
), rs as (
  select *, {S.avg_rank('pred', 'partition, held, seed, budget, ord')} as pr, {S.avg_rank('dg', 'partition, held, seed, budget, ord')} as tr from es
), ps as (
  select partition, held, seed, budget, ord, round({S.pearson('pr', 'tr')}, 9) as rho from rs group by all
), ms as (select partition, held, seed, budget, round((max(rho) filter (ord = 2) + max(rho) filter (ord = 3)) / 2, 6) as macro from ps group by all)"""


@query("seed_cell_means", POOL + _seeded_sql() + " select partition, held, budget, count(*) as n_seeds, count(macro) as n_defined, round(avg(macro), 6) as mean_macro from ms group by all")
def seed_cell_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of random selections: the mean over the seeds of each partition, fold and budget."""
    cells, pool = _main(spark, sf_dir), _pool(spark, sf_dir)
    parts = None
    for p in range(_PARTS):
        own = folds.deal(pool.where("ord >= 2"), FOLDS, f"outer-{p + 1}", "ord").unionByName(pool.where("ord < 2").withColumn("fold", F.lit(None).cast("int")), allowMissingColumns=True).withColumn("partition", F.lit(p))
        parts = own if parts is None else parts.unionByName(own)
    labels = cells.select("cell_code", "dg").where("dg is not null")
    keys = ["partition", "held", "seed", "budget"]
    plate = records.random_plates(parts, FOLDS, BUDGETS, _SEEDS, "cells").join(labels, "cell_code")
    fit = plate.groupBy(*keys).agg(F.round(stats.slope(F.col("prior"), F.col("dg")), 9).alias("slope"))
    rows = parts.where("fold is not null").select("partition", F.col("fold").alias("held"), "cell_code", "ord", "prior").join(labels, "cell_code").join(fit, ["partition", "held"])
    rows = rows.withColumn("pred", F.round(F.col("slope") * F.col("prior"), 9))
    rows = rows.withColumn("pr", stats.average_rank("pred", *keys, "ord")).withColumn("tr", stats.average_rank("dg", *keys, "ord"))
    rho = rows.groupBy(*keys, "ord").agg(F.round(stats.pearson(F.col("pr"), F.col("tr")), 9).alias("rho")).groupBy(*keys)
    of = lambda k: F.max(F.when(F.col("ord") == k, F.col("rho")))
    return records.over_seeds(rho.agg(F.round((of(2) + of(3)) / 2, 6).alias("macro")), "macro")
