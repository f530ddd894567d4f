"""Registered queries of records that hold their own intervals, of schedules, and of a landscape's diagnosis, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import stats
from ..operators import benchmark, resample, selection, transform
from ..sources.tables import table
from . import sql as S
from .catalog import _REPS, INFO, LAND, MAIN, POOL, _boot_sql, _main, _pool, _terms, query
from .evidence import _SEEDED, _arms

#: What an order's terms are measured by: of all, and of those that a selection informs without measuring them whole.
_UNPINNED = "informed and not pinned"
_R_ALL, _R_OPEN = S.pearson("post_eps", "truth"), S.pearson(f"(case when {_UNPINNED} then post_eps end)", f"(case when {_UNPINNED} then truth end)")


@query(
    "order_record",
    _boot_sql(f"round({_R_ALL}, 9) as r, round({_R_OPEN}, 9) as u").replace("select term, t_ord, post_eps,", "select term, t_ord, informed, pinned, post_eps,")
    + f""", ci as (select t_ord, count(r) as n_r, round(case when count(r) >= 3 then quantile_cont(r, 0.025) end, 6) as r_lo, round(case when count(r) >= 3 then quantile_cont(r, 0.975) end, 6) as r_hi,
count(u) as n_u, round(case when count(u) >= 3 then quantile_cont(u, 0.025) end, 6) as u_lo, round(case when count(u) >= 3 then quantile_cont(u, 0.975) end, 6) as u_hi from rs group by t_ord),
fa as (select t_ord, count(*) as n_terms, count(*) filter (informed) as n_informed, count(*) filter (pinned) as n_pinned, round(count(*) filter (informed) / count(*), 6) as coverage, round({_R_ALL}, 6) as r, round({_R_OPEN}, 6) as u from terms group by t_ord)
select * from fa join ci using (t_ord)""",
)
def order_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order: its terms, how many a selection informs or measures whole, and both correlations, each with its interval."""
    terms = _terms(spark, sf_dir)
    open_ = lambda c: F.when(F.expr(_UNPINNED), F.col(c))
    facts = {"r": stats.pearson(F.col("post_eps"), F.col("truth")), "u": stats.pearson(open_("post_eps"), open_("truth"))}
    own = terms.groupBy("t_ord").agg(
        F.count(F.lit(1)).alias("n_terms"), F.count_if("informed").alias("n_informed"), F.count_if("pinned").alias("n_pinned"), F.round(F.count_if("informed") / F.count(F.lit(1)), 6).alias("coverage"),
        *[F.round(c, 6).alias(n) for n, c in facts.items()],
    )
    return own.join(resample.joint_interval(resample.replicate(terms, "term", _REPS, "boot-1", facts, "t_ord"), list(facts), "t_ord"), "t_ord")


_U = "('0x' || substr(sha256({}), 1, 12))::bigint"


@query(
    "seed_interval",
    INFO + _SEEDED + f""", se as (select mean_dg, row_number() over (order by seed) - 1 as idx, count(*) over () as n from arm where arm = 'random'),
dr as (select rep, {_U.format("'boot-3:' || rep || ':' || idx")} % n as idx from se, (select unnest(range({_REPS})) as rep)), me as (select rep, round(avg(mean_dg), 9) as m from dr join se using (idx) group by rep)
select (select count(*) from se) as n_seeds, (select round(avg(mean_dg), 6) from se) as mean, count(m) as n_valid, round(case when count(m) >= 3 then quantile_cont(m, 0.025) end, 6) as lo, round(case when count(m) >= 3 then quantile_cont(m, 0.975) end, 6) as hi from me""",
)
def seed_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over the seeds of the random arm, seeds drawn anew."""
    seeds = _arms(spark, sf_dir).where("arm = 'random'").select("seed", "mean_dg")
    drawn = resample.interval(resample.replicate(seeds, "seed", _REPS, "boot-3", {"m": F.avg("mean_dg")}), "m")
    return seeds.agg(F.count(F.lit(1)).alias("n_seeds"), F.round(F.avg("mean_dg"), 6).alias("mean")).crossJoin(drawn)


def _calibration_sql() -> str:
    r = lambda a, b: f"round({S.pearson(a, b)}, 9)"
    ci = lambda c: f"count({c}) as n_{c}, round(case when count({c}) >= 3 then quantile_cont({c}, 0.025) end, 6) as {c}_lo, round(case when count({c}) >= 3 then quantile_cont({c}, 0.975) end, 6) as {c}_hi"
    return POOL + f""", sl as (select round(coalesce(sum(p.prior * l.dg) / nullif(sum(p.prior * p.prior), 0), 1.0), 9) as slope from pool p join land l using (cell_code) where l.dg is not null),
x as (select p.cell_code, p.prior_var, abs(slope * p.prior - l.dg) as err from pool p join land l using (cell_code), sl where l.dg is not null),
y as (select *, {S.avg_rank('prior_var', '1')} as rv, {S.avg_rank('err', '1')} as re, row_number() over (order by cell_code) - 1 as idx, count(*) over () as n from x),
dr as (select rep, {_U.format("'boot-4:' || rep || ':' || idx")} % n as idx from y, (select unnest(range({_REPS})) as rep)),
rs as (select rep, {r('prior_var', 'err')} as pearson, {r('rv', 're')} as spearman from dr join y using (idx) group by rep),
ci as (select {ci('pearson')}, {ci('spearman')} from rs),
fa as (select count(*) as n, round(avg(err), 6) as mean_error, round({S.pearson('prior_var', 'err')}, 6) as pearson, round({S.pearson('rv', 're')}, 6) as spearman from y)
select n, round(slope, 6) as slope, mean_error, pearson, spearman, n_pearson, pearson_lo, pearson_hi, n_spearman, spearman_lo, spearman_hi from fa, ci, sl"""


@query("calibration_record", _calibration_sql())
def calibration_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the prior's spread tells where the scaled prior is wrong: the slope, the mean error, and both correlations with their intervals; null where a side is constant."""
    rows = _pool(spark, sf_dir).select("cell_code", "prior", "prior_var").join(_main(spark, sf_dir).select("cell_code", "dg").where("dg is not null"), "cell_code")
    slope = rows.agg(F.round(stats.slope(F.col("prior"), F.col("dg")), 9).alias("slope"))
    rows = rows.crossJoin(F.broadcast(slope)).withColumn("err", F.abs(F.col("slope") * F.col("prior") - F.col("dg"))).withColumn("one", F.lit(1))
    rows = rows.withColumn("rv", stats.average_rank("prior_var", "one")).withColumn("re", stats.average_rank("err", "one"))
    facts = {"pearson": stats.pearson(F.col("prior_var"), F.col("err")), "spearman": stats.pearson(F.col("rv"), F.col("re"))}
    own = rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.first("slope"), 6).alias("slope"), F.round(F.avg("err"), 6).alias("mean_error"), *[F.round(c, 6).alias(k) for k, c in facts.items()])
    return own.crossJoin(resample.joint_interval(resample.replicate(rows, "cell_code", _REPS, "boot-4", facts), list(facts)))


@query(
    "landscape_diagnosis",
    S.with_(S.land(MAIN), S.coefs(MAIN)) + """, a as (select sum(coef ** 2) as e, sum(coef ** 2) filter (ord > 0) as v, sum(coef ** 2) filter (ord = 1) as one, sum(coef ** 2) filter (ord <= 2 and ord > 0) as two from coef), b as (select sum(dg ** 2) as s, count(*) as n, var_pop(dg) as var from land)
select n as n_cells, round(e / n, 6) as mean_square, round(var, 6) as variance, abs(e - s) <= 1e-6 * s as whole, round(one / nullif(v, 0), 6) as share_1, round(two / nullif(v, 0), 6) as share_2, v / n <= 1e-12 as flat from a, b""",
)
def landscape_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landscape's energy in its values and in its modes, which must be the same, and how much of its variance the lowest orders hold; null for a flat one."""
    cells = _main(spark, sf_dir)
    return transform.diagnosis(transform.coefficients(cells, "dg"), cells, "dg")


@query(
    "cell_schedule",
    """with f as (select c_mktsegment as method, year(o_orderdate) as budget, o_orderstatus as seed from orders join customer on o_custkey = c_custkey),
m as (select distinct method from f), b as (select distinct budget from f), s as (select distinct seed from f), due as (select budget, method, seed from m, b, s),
seen as (select budget, method, seed, count(*) as n from f group by all)
select (row_number() over (order by budget, method, seed))::int as place, (dense_rank() over (order by budget))::int as block, budget::int as budget, method, seed, coalesce(n, 0) as n, n is null as missing from due left join seen using (budget, method, seed)""",
)
def cell_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of the budgets, methods and seeds that orders show, whether or not it occurs, budget by budget."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.year("o_orderdate").alias("budget"), F.col("c_mktsegment").alias("method"), F.col("o_orderstatus").alias("seed"))
    return benchmark.schedule(rows, ["budget", "method", "seed"])


@query(
    "stable_prefix",
    "select event_type, place::int as place, event_id, round(value, 6) as value from (select *, row_number() over (partition by event_type order by value desc, event_id) as place from events where value is not null) where place <= 48",
)
def stable_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 48 events of each kind with the largest values, equal ones in the order in which they came; the prefix is the feature."""
    return selection.stable_prefix(table(spark, sf_dir, "events").where("value is not null"), "value", "event_id", 48, "event_type").select("event_type", "place", "event_id", F.round("value", 6).alias("value"))


@query("order_labels", LAND + "select case ord when 0 then 'reference' when 1 then 'single' when 2 then 'pairwise' when 3 then 'third-order' else ord || 'th-order' end as label, count(*) as n, format('{:,}', sum(n_rows)::bigint) as n_facts from land group by ord")
def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each order by its name, and the facts behind them."""
    return _main(spark, sf_dir).groupBy("ord").agg(F.count(F.lit(1)).alias("n"), F.format_number(F.sum("n_rows"), 0).alias("n_facts")).select(C.order_label(F.col("ord")).alias("label"), "n", "n_facts")


@query(
    "crossed_pairs",
    INFO + _SEEDED + """, ti as (
  select 'tied' as arm, 'tie' as kind, seed, avg(dg) as value from (select seed, cell_code from (select seed, cell_code, row_number() over (partition by seed order by structural desc, sha256('tie-' || seed || ':' || ident), ident) as rank from pool, (select unnest(range(1, 6))::int as seed)) where rank <= 48) join land using (cell_code) group by seed
), al as (select arm, case when seed is null then 'none' else 'random' end as kind, seed, mean_dg as value from arm union all select arm, kind, seed, value from ti),
pr as (select a.arm as a_arm, b.arm as b_arm, round(a.value - b.value, 9) as delta from al a, al b where case when a.kind = b.kind and a.kind <> 'none' then a.seed = b.seed else true end)
select a_arm, b_arm, count(delta) as n, round(avg(delta), 6) as mean, round(median(delta), 6) as median, round(min(delta), 6) as min, round(max(delta), 6) as max, round(count(*) filter (delta > 0) / nullif(count(delta), 0), 6) as positive_fraction from pr group by all""",
)
def crossed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of three arms, one without seeds and two whose seeds mean different things."""
    cells, pool = _main(spark, sf_dir).select("cell_code", "dg"), _pool(spark, sf_dir)
    arms = _arms(spark, sf_dir).select("arm", F.when(F.col("seed").isNull(), "none").otherwise("random").alias("kind"), "seed", F.col("mean_dg").alias("value"))
    seeded = pool.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(5))))
    order = F.sha2(F.concat(F.lit("tie-"), F.col("seed").cast("string"), F.lit(":"), F.col("ident")), 256)
    top = seeded.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("structural"), order, "ident"))).where("rank <= 48")
    tied = top.select("seed", "cell_code").join(cells, "cell_code").groupBy(F.lit("tied").alias("arm"), F.lit("tie").alias("kind"), "seed").agg(F.avg("dg").alias("value"))
    both = arms.unionByName(tied)
    return benchmark.variability(benchmark.arm_pairs(both, both, "value"))
