"""Registered queries of the benchmark cells and of what is reported about them, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import audit, benchmark, folds, lattice, recovery, resample, selection, transform
from ..operators.selection import SEED
from . import sql as S
from .catalog import _AUC, _REPS, BUDGET, INFO, LAND, MAIN, POOL, _boot_sql, _main, _metric_grid, _orders_sql, _pool, _terms, query

FOLDS, BUDGETS = 5, [12, 24, 48, 96]


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool with fold: cells of two dimensions and more are dealt, single ones never held out."""
    pool = _pool(spark, sf_dir)
    dealt = folds.deal(pool.where("ord >= 2"), FOLDS, "outer-1", "ord")
    return dealt.unionByName(pool.where("ord < 2").withColumn("fold", F.lit(None).cast("int")), allowMissingColumns=True)


def _plates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells, dealt = _main(spark, sf_dir), _dealt(spark, sf_dir)
    scored = benchmark.blind_pool(dealt, benchmark.blind_coverage(cells, dealt, FOLDS), FOLDS)
    return cells, dealt, benchmark.plates(scored, BUDGETS)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, dealt, plate = _plates(spark, sf_dir)
    return benchmark.cell_metrics(benchmark.evaluated(dealt, cells, benchmark.fits(plate, cells), FOLDS))


_DEALT = f""", dealt as (
  select cell_code, ord, ident, prior, prior_var, case when ord >= 2 then (row_number() over (partition by ord order by sha256('outer-1:' || ident), ident) - 1) % {FOLDS} end as fold from pool
), h as (select unnest(range({FOLDS})) as held)"""
_PLATES = _DEALT + f""", cover as (
  select held, member as cell_code, count(*) as loops from clo left join dealt on term = dealt.cell_code, h where t_ord between 2 and 3 and fold is distinct from held group by held, member
), scored as (
  select held, p.cell_code, p.ord, ident, prior, unnest(['info', 'prior', 'structural']) as method,
         unnest([round(prior_var * coalesce(loops, 0), 9), prior, coalesce(loops, 0)::double]) as score
  from dealt p cross join h left join cover using (held, cell_code) where fold is distinct from held
), ranked as (
  select *, row_number() over (partition by held, method order by score desc, sha256('{SEED}:' || ident), ident) as rank from scored
), plate as (
  select held, method, budget, cell_code, ord, prior from ranked, (select unnest({BUDGETS}) as budget) where rank <= budget
)"""
_METRICS = _PLATES + f""", fit as (
  select held, method, budget, round(coalesce(sum(p.prior * dg) / nullif(sum(p.prior * p.prior), 0), 1.0), 9) as slope from plate p join land l using (cell_code) where dg is not null group by all
), ev as (
  select held, method, budget, d.ord, round(slope * d.prior, 9) as pred, dg from dealt d join h on fold = held join land l using (cell_code) join fit using (held) where dg is not null
), er as (
  select *, {S.avg_rank('pred', 'held, method, budget, ord')} as pr, {S.avg_rank('dg', 'held, method, budget, ord')} as tr from ev
), per as (
  select held, method, budget, ord, count(*) as n, sum((pred - dg) ** 2) as sse, round({S.pearson('pr', 'tr')}, 9) as rho from er group by all
), me as (
  select held, method, budget, sum(n)::bigint as n_held, round(sqrt(sum(sse) / sum(n)), 6) as rmse, round(max(rho) filter (ord = 2), 6) as spearman_2, round(max(rho) filter (ord = 3), 6) as spearman_3,
         round((max(rho) filter (ord = 2) + max(rho) filter (ord = 3)) / 2, 6) as macro_spearman from per group by all
)"""


@query("benchmark_cells", POOL + _METRICS + " select * from me")
def benchmark_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each held-out fold, method and budget: a selection blind to the fold, a fit on what it reveals, scores on the fold."""
    return _metrics(spark, sf_dir)


@query("method_budget_summary", POOL + _METRICS + " select method, budget, count(*) as n_cells, count(macro_spearman) as n_defined, " + ", ".join(f"round(avg({c}), 6) as mean_{c}" for c in ("rmse", "spearman_2", "spearman_3", "macro_spearman")) + " from me group by all")
def method_budget_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.summaries(_metrics(spark, sf_dir))


@query(
    "label_accounting",
    POOL + _PLATES + """ select held, method, budget, count(*) as n_selected, count(dg) as n_train, count(*) filter (dg > 0) as n_positive, count(*) filter (dg <= 0) as n_nonpositive, count(*) filter (dg is null) as n_missing,
round(count(*) filter (dg > 0) / nullif(count(dg), 0), 6) as positive_fraction from plate left join (select cell_code, dg from land) using (cell_code) group by all""",
)
def label_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _, plate = _plates(spark, sf_dir)
    return benchmark.revealed_counts(plate, cells)


@query("blind_coverage", POOL + _PLATES + " select held, cell_code, loops from cover")
def blind_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.blind_coverage(_main(spark, sf_dir), _dealt(spark, sf_dir), FOLDS)


@query("informed_fraction", INFO + "select t_ord, count(*) as n_terms, round(avg(n_measured / n_members), 6) as informed_fraction from terms group by t_ord")
def informed_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of its terms' members a selection measures, by order."""
    return _terms(spark, sf_dir).groupBy("t_ord").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.avg(F.col("n_measured") / F.col("n_members")), 6).alias("informed_fraction"))


@query(
    "signal_gate",
    INFO + """, s as (select max(abs(prior)) as size from land where ord > 0), c as (select term, t_ord, round(sum(sign * prior), 9) as eps from clo join land on member = cell_code where t_ord between 2 and 3 group by all)
select t_ord, count(*) as n, count(*) filter (abs(eps) > 2.220446049250313e-16 * size * (2 ** t_ord - 1)) as n_above, bool_or(abs(eps) > 2.220446049250313e-16 * size * (2 ** t_ord - 1)) as signal from c, s group by t_ord""",
)
def signal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the prior predicts any contrast beyond rounding."""
    cells = _main(spark, sf_dir)
    found = lattice.contrasts(cells.where("ord between 2 and 3"), cells.where("ord > 0").select("cell_code", "prior"), "prior", strict=True)
    return benchmark.above_rounding(found, cells.where("ord > 0").agg(F.max(F.abs("prior")).alias("size")))


@query("method_ranking", _orders_sql(_AUC) + ", m as (select method, round(avg(auc), 6) as mean_auc from auc group by method) select method, mean_auc, row_number() over (order by mean_auc desc nulls last, method) as place from m")
def method_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    auc = folds.budget_auc(_metric_grid(spark, sf_dir), "value", "budget", "y", "fold", "method")
    return benchmark.ranking(auc.groupBy("method").agg(F.round(F.avg("auc"), 6).alias("mean_auc")), "mean_auc", "method")


@query(
    "prior_policies",
    INFO + """, o as (select p.cell_code, p.prior, l.dg from pool p join land l using (cell_code) where dg is not null and cell_code not in (select cell_code from rev)),
pol as (select unnest(['zero', 'unit', 'fitted']) as policy, unnest([0.0, 1.0, slope]::double[]) as slope, unnest([0, 0, n]::bigint[]) as n_fit from fit)
select policy, slope, n_fit, count(*) as n_open, round(sum((slope * prior - dg) ** 2), 6) as sse from o, pol group by all""",
)
def prior_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, pool = _main(spark, sf_dir), _pool(spark, sf_dir)
    told = recovery.reveal(selection.top(pool, "structural", BUDGET), cells)
    return benchmark.prior_policies(pool.select("cell_code", "prior").join(cells.select("cell_code", "dg"), "cell_code"), told)


_SEEDS = 20
_SEEDED = f""", seeded as (
  select seed, cell_code from (select seed, cell_code, row_number() over (partition by seed order by sha256('arm-' || seed || ':' || ident), ident) as rank from pool, (select unnest(range(1, {_SEEDS + 1})) as seed)) where rank <= {BUDGET}
), arm as (
  select 'random' as arm, seed::int as seed, avg(dg) as mean_dg, max(dg) as best_dg from seeded join land using (cell_code) group by seed
  union all select 'structural', null, avg(dg), max(dg) from sel join (select cell_code, dg from land) using (cell_code)
)"""


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, seed, mean_dg, best_dg: of random selections by seed, and of the structural one, which has none."""
    cells, pool = _main(spark, sf_dir).select("cell_code", "dg"), _pool(spark, sf_dir)
    facts = [F.avg("dg").alias("mean_dg"), F.max("dg").alias("best_dg")]
    drawn = benchmark.seeded(pool, BUDGET, _SEEDS, "arm").join(cells, "cell_code").groupBy(F.lit("random").alias("arm"), "seed").agg(*facts)
    chosen = selection.top(pool, "structural", BUDGET).join(cells, "cell_code").groupBy(F.lit("structural").alias("arm"), F.lit(None).cast("int").alias("seed")).agg(*facts)
    return drawn.unionByName(chosen)


@query("seed_means", INFO + _SEEDED + " select arm, count(seed) as n_seeds, round(avg(mean_dg), 6) as mean_dg, round(avg(best_dg), 6) as best_dg from arm group by arm")
def seed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the seeds of each arm."""
    return _arms(spark, sf_dir).groupBy("arm").agg(F.count("seed").alias("n_seeds"), F.round(F.avg("mean_dg"), 6).alias("mean_dg"), F.round(F.avg("best_dg"), 6).alias("best_dg"))


@query(
    "selection_variability",
    INFO + _SEEDED + """, pr as (select a.arm as a_arm, b.arm as b_arm, round(a.mean_dg - b.mean_dg, 9) as delta from arm a, arm b where a.arm = 'structural' and (a.seed is null or b.seed is null or a.seed = b.seed))
select a_arm, b_arm, count(delta) as n, round(avg(delta), 6) as mean, round(median(delta), 6) as median, round(min(delta), 6) as min, round(max(delta), 6) as max, round(count(*) filter (delta > 0) / nullif(count(delta), 0), 6) as positive_fraction from pr group by all""",
)
def selection_variability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structural selection against every arm, its own included, pair by pair."""
    arms = _arms(spark, sf_dir)
    return benchmark.variability(benchmark.realised_pairs(arms.where("arm = 'structural'"), arms, "mean_dg"))


@query("needed_cells", S.with_(S.land(MAIN), S.POOL, S.top("info", BUDGET)) + "select distinct member as cell_code from clo join sel on term = sel.cell_code")
def needed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.needed(_main(spark, sf_dir), selection.top(_pool(spark, sf_dir), "info", BUDGET))


@query(
    "reconstruction",
    S.with_(S.land(MAIN), S.coefs(MAIN)) + """, r as (select l.cell_code, round(sum(coef * x0 * x1 * x2 * x3), 6) as rebuilt, round(sum(coef * x0 * x1 * x2 * x3) filter (coef.ord <= 2), 6) as low_orders
  from land l join b0 using (d0) join b1 using (d1) join b2 using (d2) join b3 using (d3) join coef using (k0, k1, k2, k3) group by l.cell_code)
select cell_code, rebuilt, low_orders, round(dg, 6) as dg from r join land using (cell_code)""",
)
def reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landscape from all its coefficients, and from those of two dimensions at most."""
    cells = _main(spark, sf_dir)
    coefs = transform.coefficients(cells, "dg")
    low = coefs.withColumn("coef", F.when(F.col("ord") <= 2, F.col("coef")).otherwise(0.0))
    both = transform.rebuilt(coefs, cells, "rebuilt").join(transform.rebuilt(low, cells, "low_orders"), "cell_code")
    return both.join(cells.select("cell_code", "dg"), "cell_code").select("cell_code", F.round("rebuilt", 6).alias("rebuilt"), F.round("low_orders", 6).alias("low_orders"), F.round("dg", 6).alias("dg"))


_PRIOR_COEF = ", pcoef as (select k0, k1, k2, k3, round(sum(x0 * x1 * x2 * x3 * prior), 9) as p from land join b0 using (d0) join b1 using (d1) join b2 using (d2) join b3 using (d3) group by all)"


@query(
    "coefficient_metrics",
    S.with_(S.land(MAIN), S.coefs(MAIN)) + _PRIOR_COEF + f""", j as (select ord, p, coef from coef join pcoef using (k0, k1, k2, k3) where ord > 0), r as (select *, {S.avg_rank('p', 'ord')} as pr, {S.avg_rank('coef', 'ord')} as tr from j)
select ord, count(*) as n, round({S.pearson('pr', 'tr')}, 6) as spearman, round(1.0 - sum((p - coef) ** 2) / nullif(sum(coef ** 2), 0), 6) as sse_gain, count(*) filter (abs(p) > 1e-12) as support from r group by ord""",
)
def coefficient_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prior's coefficients against the measure's, by order."""
    cells, modes = _main(spark, sf_dir), ["k0", "k1", "k2", "k3"]
    prior = transform.coefficients(cells, "prior").select(*modes, F.col("coef").alias("p"))
    return benchmark.support(transform.coefficients(cells, "dg").where("ord > 0").join(prior, modes), "p", "coef", "ord")


@query("macro_spearman", POOL + _METRICS + " select method, budget, held, macro_spearman, row_number() over (partition by budget, held order by macro_spearman desc nulls last, method) as place from me")
def macro_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which method is best in each fold at each budget."""
    from pyspark.sql import Window

    w = Window.partitionBy("budget", "held").orderBy(F.desc_nulls_last("macro_spearman"), "method")
    return _metrics(spark, sf_dir).select("method", "budget", "held", "macro_spearman", F.row_number().over(w).alias("place"))


@query("measured_regime", LAND + "select ord, count(*) as n, count(dg) as n_measured, round(count(dg) / count(*), 6) as share from land where ord between 1 and 3 group by ord")
def measured_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the candidates of each order have a measure."""
    cells = _main(spark, sf_dir)
    return cells.where("ord between 1 and 3").groupBy("ord").agg(F.count(F.lit(1)).alias("n"), F.count("dg").alias("n_measured"), F.round(F.count("dg") / F.count(F.lit(1)), 6).alias("share"))


# ---------------------------------------------------------------- evidence over resamples and budgets


_EVAL = f"""round({S.pearson('prior_eps', 'truth')}, 6) as r_prior, round({S.pearson('post_eps', 'truth')}, 6) as r_post, round({S.pearson('post_eps', 'truth')} - {S.pearson('prior_eps', 'truth')}, 6) as delta_r,
round(sum((prior_eps - truth) ** 2), 6) as sse_prior, round(sum((post_eps - truth) ** 2), 6) as sse_post"""


@query(
    "evaluation_record",
    INFO + f""", reg as (select *, unnest(['all', case when informed then 'informed' end, case when informed and not pinned then 'predicted' end]) as regime from terms),
u as (select regime, t_ord, post_eps - prior_eps as moved, truth - prior_eps as due, prior_eps, post_eps, truth from reg where regime is not null)
select regime, t_ord, count(*) as n_terms, {_EVAL}, round({S.pearson('moved', 'due')}, 6) as update_r from u group by regime, t_ord""",
)
def evaluation_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms, those that a selection informs, and those that it informs without measuring them whole: prior against posterior."""
    return benchmark.evaluation(_terms(spark, sf_dir))


_GAIN = f"round({S.pearson('post_eps', 'truth')}, 9) as r, round({S.pearson('post_eps', 'truth')} - {S.pearson('prior_eps', 'truth')}, 9) as dr, round(1.0 - sum((post_eps - truth) ** 2) / nullif(sum((prior_eps - truth) ** 2), 0), 9) as gain"
_INTERVALS = ", ".join(f"count({c}) as n_{c}, round(case when count({c}) >= 3 then quantile_cont({c}, 0.025) end, 6) as {c}_lo, round(case when count({c}) >= 3 then quantile_cont({c}, 0.975) end, 6) as {c}_hi" for c in ("r", "dr", "gain"))


@query("joint_bootstrap", _boot_sql(_GAIN) + f" select t_ord, {_INTERVALS} from rs group by t_ord")
def joint_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals by order of a correlation, its gain over the prior's, and the share of error gone: one set of resamples for all three."""
    r = lambda c: stats.pearson(F.col(c), F.col("truth"))
    facts = {"r": r("post_eps"), "dr": r("post_eps") - r("prior_eps"), "gain": stats.sse_gain(F.col("prior_eps"), F.col("post_eps"), F.col("truth"))}
    return resample.joint_interval(resample.replicate(_terms(spark, sf_dir), "term", _REPS, "boot-1", facts, "t_ord"), list(facts), "t_ord")


_DIFF = """, di as (select a.budget, a.held, round(a.macro_spearman - b.macro_spearman, 6) as d from (select * from me where method = 'structural') a join (select * from me where method = 'info') b using (budget, held)),
ev2 as (select budget, count(d) as n, round(quantile_cont(d, 0.025), 6) as lo, round(quantile_cont(d, 0.5), 6) as mid, round(quantile_cont(d, 0.975), 6) as hi, count(*) filter (d > 0) as n_positive from di group by budget)"""


@query("evidence_by_budget", POOL + _METRICS + _DIFF + " select *, case when n = 0 then 'undefined' when lo > 0 then 'first' when hi < 0 then 'second' else 'open' end as verdict from ev2")
def evidence_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural against informed selection over the folds: percentiles of the difference at each budget, and what they say."""
    return benchmark.evidence(_metrics(spark, sf_dir), "structural", "info", "macro_spearman")


@query(
    "evidence_status",
    POOL + _METRICS + _DIFF + """ select count(*) as n_budgets, count(*) filter (mid > 0) as n_for, count(*) filter (mid < 0) as n_against, count(*) filter (mid > 0) > 0 and count(*) filter (mid < 0) > 0 as reversed,
case when count(*) filter (mid > 0) > 0 and count(*) filter (mid < 0) > 0 then 'mixed' when count(*) filter (mid > 0) >= 2 then 'for' when count(*) filter (mid < 0) >= 2 then 'against' else 'open' end as status from ev2""",
)
def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether at least two budgets agree and none says the opposite."""
    return benchmark.status(benchmark.evidence(_metrics(spark, sf_dir), "structural", "info", "macro_spearman"))


@query("provenance_payload", LAND + """select ord, '{"schema_version":1,"source":"quad5","result":{"ord":' || ord || ',"cells":' || count(*) || ',"rows":' || sum(n_rows)::bigint || '}}' as payload from land group by ord""")
def provenance_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as JSON with where it is from, its numbers unchanged."""
    counts = _main(spark, sf_dir).groupBy("ord").agg(F.count(F.lit(1)).alias("cells"), F.sum("n_rows").alias("rows"))
    return counts.select("ord", audit.payload("quad5", F.struct("ord", "cells", "rows")).alias("payload"))
