"""The registered queries and the SQL that gives the same rows.

``@query(name, sql)`` registers a function of (spark, sf_dir); without SQL the rows alone are checked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import stats
from ..operators import audit, folds, lattice, recovery, resample, selection, transform
from ..sources.landscapes import landscape
from ..sources.tables import table
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MAIN = "quad5"
BUDGET = 48


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import evidence, evidence_trail, intervals, iterative, records, stored  # noqa: F401  register the benchmark cells, and what runs in grouped functions and streams

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import evidence, evidence_trail, intervals, iterative, records, stored  # noqa: F401

    return dict(_SQL)


LAND = S.with_(S.land(MAIN))
CLO = S.with_(S.land(MAIN), S.CLOSURE)
POOL = S.with_(S.land(MAIN), S.POOL)
INFO = S.with_(S.land(MAIN), S.POOL, S.top("structural", BUDGET), S.told("sel"))


def _main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape(spark, sf_dir, MAIN)


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.scored(_main(spark, sf_dir))


def _told(spark: SparkSession, sf_dir: str, score: str = "structural") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The landscape, the selection by ``score``, and the candidates with what is revealed and inferred."""
    cells = _main(spark, sf_dir)
    pool = selection.scored(cells)
    chosen = selection.top(pool, score, BUDGET)
    return cells, chosen, recovery.posterior(pool, recovery.reveal(chosen, cells))


def _terms(spark: SparkSession, sf_dir: str, score: str = "structural") -> DataFrame:
    cells, _, told = _told(spark, sf_dir, score)
    return recovery.term_table(cells, told)


# ---------------------------------------------------------------- landscapes and lattices


def _landscape(name: str) -> None:
    @query(f"landscape_{name}", S.with_(S.land(name)) + "select cell_code, d0, d1, d2, d3, ord, n_rows, measure, dg, prior, prior_var from land")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return landscape(spark, sf_dir, name).select("cell_code", "d0", "d1", "d2", "d3", "ord", "n_rows", "measure", "dg", "prior", "prior_var")


for _name in ("quad5", "mixed225", "mixed150"):
    _landscape(_name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = landscape(spark, sf_dir, "mixed225")
    found = lattice.contrasts(cells.where("ord = 2"), cells.where("ord > 0").select("cell_code", "dg"), "dg", strict=False)
    return found.orderBy(F.desc(F.abs("eps")), "term").limit(10).select("term", "eps")


_QUERIES["top_pairwise_contrasts"] = flagship
_SQL["top_pairwise_contrasts"] = S.with_(S.land("mixed225"), S.CLOSURE) + """
select term, round(sum(sign * dg), 9) as eps from clo join land on member = cell_code where t_ord = 2 group by term order by abs(eps) desc, term limit 10"""


@query("lattice_candidates", LAND + f"select cell_code, ord, {S.IDENT} as ident from land where ord between 1 and 3")
def lattice_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.candidates(_main(spark, sf_dir), 3).select("cell_code", "ord", C.canonical_id(C.assignments(4)).alias("ident"))


@query("lattice_order_counts", LAND + "select ord, count(*) as n from land where ord between 1 and 3 group by ord")
def lattice_order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.candidates(_main(spark, sf_dir), 3).groupBy("ord").agg(F.count(F.lit(1)).alias("n"))


@query("analytic_coverage", POOL + "select ord, min(loops) as n_min, max(loops) as n_max, true as agrees from pool group by ord")
def analytic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = spark.createDataFrame(lattice.analytic_coverage(4, 5, 3), "ord int, stated long")
    counted = _pool(spark, sf_dir).groupBy("ord").agg(F.min("loops").alias("n_min"), F.max("loops").alias("n_max"))
    return counted.join(stated, "ord").select("ord", "n_min", "n_max", ((F.col("n_min") == F.col("stated")) & (F.col("n_max") == F.col("stated"))).alias("agrees"))


@query(
    "canonical_ids",
    LAND + f"select cell_code, {S.IDENT} as ident, coalesce(nullif(array_to_string(list_filter([" + ", ".join(f"case when d{k} > 0 then '{k}:' || w{k} || '>' || v{k} end" for k in range(4)) + "], lambda x: x is not null), ','), ''), 'REF') as short from land",
)
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = C.assignments(4)
    return _main(spark, sf_dir).select("cell_code", C.canonical_id(cell).alias("ident"), C.short_id(cell).alias("short"))


def _hash_sql() -> str:
    out = "0::bigint"
    for k in range(4):
        out = f"(case when d{k} > 0 then (({out}) * {C.HASH_BASE} + {k * C.DIM_ROOM} + d{k}) % {C.MODULUS} else ({out}) end)"
    return out


@query("cell_hash_folds", LAND + f"select cell_code, h as cell_hash, h % 5 as fold from (select cell_code, {_hash_sql()} as h from land)")
def cell_hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _main(spark, sf_dir).select("cell_code", C.cell_hash(4).alias("cell_hash"), recovery.fold(None, 4, 5).alias("fold"))


@query("candidate_set_digest", POOL + "select count(*) as n, sha256(string_agg(ident, chr(10) order by ident)) as digest from pool")
def candidate_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), audit.set_digest(F.col("ident")).alias("digest"))


_LETTERS = "translate(lpad((p_partkey % 100000)::varchar, 5, '0'), '0123456789', 'ACDEFGHIKL')"


@query(
    "sequence_diff",
    f"""with s as (select p_partkey, {_LETTERS} as seq from part)
select p_partkey, seq, len(ds) as ord, array_to_string(list_transform(ds, lambda i: 'A' || i || seq[i]), ' ') as notation, seq as applied
from (select *, list_filter(range(1, 6), lambda i: seq[i] <> 'A') as ds from s)""",
)
def sequence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys written as sequences, told apart from a reference, and put together again."""
    seq = F.translate(F.lpad(F.pmod("p_partkey", F.lit(100000)).cast("string"), 5, "0"), "0123456789", "ACDEFGHIKL")
    cells = table(spark, sf_dir, "part").select("p_partkey", seq.alias("seq")).withColumn("cell", C.diff(F.col("seq"), F.lit("AAAAA")))
    return cells.select("p_partkey", "seq", F.size("cell").alias("ord"), C.notation(F.col("cell")).alias("notation"), C.overlay(F.lit("AAAAA"), F.col("cell")).alias("applied"))


@query(
    "notation_parse",
    """with s as (select p_partkey, upper(split_part(p_name, ' ', 1)) || ' ' || 'A' || (p_partkey % 7 + 1) || chr(66 + (p_size % 20)::int) as spec from part),
t as (select *, list_filter(regexp_split_to_array(trim(spec), '\\s+'), lambda x: x <> '') as ts from s)
select p_partkey, spec, len(list_filter(ts, lambda x: not regexp_matches(x, '^[A-Z][1-9][0-9]*[A-Z]$'))) = 0 as valid,
  case when len(list_filter(ts, lambda x: not regexp_matches(x, '^[A-Z][1-9][0-9]*[A-Z]$'))) = 0 then len(ts) end as ord from t""",
)
def notation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit(" A"), (F.pmod("p_partkey", F.lit(7)) + 1).cast("string"), F.char(F.lit(66) + F.pmod("p_size", F.lit(20))))
    rows = table(spark, sf_dir, "part").select("p_partkey", spec.alias("spec")).withColumn("cell", C.parse_notation(F.col("spec")))
    return rows.select("p_partkey", "spec", F.col("cell").isNotNull().alias("valid"), F.when(F.col("cell").isNotNull(), F.size("cell")).alias("ord"))


# ---------------------------------------------------------------- values


@query(
    "centred_log",
    "with r as (select avg(c_acctbal) as m from customer) select c_custkey, case when c_acctbal > 0 then round(ln(c_acctbal) - ln(m), 6) end as centred, c_acctbal > -1 as trainable, case when c_acctbal > -1 then round(ln(1 + c_acctbal), 6) end as target from customer, r",
)
def centred_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    mean = rows.agg(F.avg("c_acctbal").alias("m"))
    ok = stats.trainable(F.col("c_acctbal"))
    return rows.crossJoin(mean).select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.round(F.ln("c_acctbal") - F.ln("m"), 6)).alias("centred"), ok.alias("trainable"), F.when(ok, F.round(F.log1p("c_acctbal"), 6)).alias("target")
    )


# ---------------------------------------------------------------- contrasts


@query("closure_members", CLO + "select term, t_ord, member, m_ord, sign from clo where t_ord between 1 and 3")
def closure_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.closure(_main(spark, sf_dir).where("ord between 1 and 3"))


def _contrast(order: int, name: str) -> None:
    @query(name, CLO + f"select term, round(sum(sign * dg), 9) as eps from clo join land on member = cell_code where t_ord = {order} group by term")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = _main(spark, sf_dir)
        return lattice.contrasts(cells.where(F.col("ord") == order), cells.where("ord > 0").select("cell_code", "dg"), "dg", strict=False).select("term", "eps")


_contrast(2, "contrast_pairwise")
_contrast(3, "contrast_third")


@query("contrast_predicted", CLO + "select term, t_ord, round(sum(sign * prior), 9) as eps, round(sum(prior_var), 9) as sigma2 from clo join land on member = cell_code where t_ord between 2 and 3 group by term, t_ord")
def contrast_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict: a member without a score is an error."""
    cells = _main(spark, sf_dir)
    return lattice.contrasts(cells.where("ord between 2 and 3"), cells.select("cell_code", "prior", "prior_var"), "prior", strict=True, variance="prior_var")


@query(
    "contrast_truth_with_holes",
    CLO + """select term, t_ord, round(sum(sign * dg), 9) as eps from clo join (select * from land where cell_code % 7 <> 3) l on member = l.cell_code
where t_ord between 2 and 3 group by term, t_ord having count(*) = 2 ** t_ord - 1""",
)
def contrast_truth_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells are missing here: a term that lacks a member is dropped, never filled in."""
    cells = _main(spark, sf_dir)
    return lattice.contrasts(cells.where("ord between 2 and 3"), cells.where("cell_code % 7 <> 3").select("cell_code", "dg"), "dg", strict=False)


@query("contrast_additive_null", CLO + "select t_ord, count(*) as n_terms, true as all_zero from (select distinct term, t_ord from clo where t_ord between 2 and 3) group by t_ord")
def contrast_additive_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null test: values that are sums of single effects have no contrast."""
    cells = _main(spark, sf_dir)
    singles = lattice.closure(cells.where("ord > 0")).where("m_ord = 1").join(cells.select(F.col("cell_code").alias("member"), "dg"), "member")
    additive = singles.groupBy(F.col("term").alias("cell_code")).agg(F.sum("dg").alias("sum"))
    found = lattice.contrasts(cells.where("ord between 2 and 3"), additive, "sum", strict=True)
    return found.groupBy("t_ord").agg(F.count(F.lit(1)).alias("n_terms"), F.bool_and(F.abs("eps") < 1e-8).alias("all_zero"))


# ---------------------------------------------------------------- coverage and selections


@query("coverage_weights", POOL + "select cell_code, ord, loops, info, structural from pool")
def coverage_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).select("cell_code", "ord", "loops", "info", "structural")


@query(
    "posterior_variance",
    S.with_(S.land(MAIN), S.POOL, S.top("info", BUDGET)) + """select term, t_ord, coalesce(round(sum(case when s.cell_code is null then l.prior_var end), 9), 0.0) as variance
from clo join land l on member = l.cell_code left join sel s on member = s.cell_code where t_ord between 2 and 3 group by term, t_ord""",
)
def posterior_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each term's variance once the selection is measured; a term with nothing left stays, at zero."""
    cells = _main(spark, sf_dir)
    chosen = selection.top(selection.scored(cells), "info", BUDGET).select(F.col("cell_code").alias("member"), F.lit(True).alias("got"))
    rows = lattice.with_members(cells.where("ord between 2 and 3"), cells.select("cell_code", "prior_var"), strict=True).join(chosen, "member", "left")
    return rows.groupBy("term", "t_ord").agg(F.coalesce(F.round(F.sum(F.when(F.col("got").isNull(), F.col("prior_var"))), 9), F.lit(0.0)).alias("variance"))


@query(
    "total_uncertainty",
    S.with_(S.land(MAIN), S.POOL, S.top("info", BUDGET)) + "select round(sum(info), 6) as before, round(sum(info) - sum(case when rank is not null then info end), 6) as after from pool left join (select cell_code, rank from sel) using (cell_code)",
)
def total_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uncertainty of all terms is a sum over cells, so what a selection leaves is one subtraction."""
    pool = _pool(spark, sf_dir)
    chosen = selection.top(pool, "info", BUDGET).agg(F.sum("info").alias("got"))
    return pool.agg(F.sum("info").alias("all")).crossJoin(chosen).select(F.round("all", 6).alias("before"), F.round(F.col("all") - F.col("got"), 6).alias("after"))


@query("info_gain", S.with_(S.land(MAIN), S.POOL, S.top("info", BUDGET)) + "select cell_code, case when rank is null then info else 0.0 end as gain from pool left join (select cell_code, rank from sel) using (cell_code)")
def info_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What measuring one more cell would take off; nothing for a cell that is measured."""
    pool = _pool(spark, sf_dir)
    chosen = selection.top(pool, "info", BUDGET).select("cell_code", F.lit(True).alias("got"))
    return pool.join(chosen, "cell_code", "left").select("cell_code", F.when(F.col("got").isNull(), F.col("info")).otherwise(0.0).alias("gain"))


def _select(name: str, score: str, sql_pool: str = "", weight: float | None = None) -> None:
    parts = [S.land(MAIN), S.POOL] + ([sql_pool] if sql_pool else [])
    pool_name = "mix" if sql_pool else "pool"

    @query(name, S.with_(*parts, S.top(score, BUDGET, pool=pool_name)) + f"select cell_code, ident, {score} as score, rank from sel")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pool = _pool(spark, sf_dir)
        pool = selection.varied(pool, "info") if weight is None else selection.blended(pool, weight)
        return selection.top(pool, score, BUDGET).select("cell_code", "ident", F.col(score).alias("score"), "rank")


_select("select_info", "info")
_select("select_structural", "structural")
_select("select_prior", "prior")
_select(
    "select_blend", "blend",
    "mix as (select *, round(0.5 * (info - min(info) over ()) / (max(info) over () - min(info) over ()) + 0.5 * (prior - min(prior) over ()) / (max(prior) over () - min(prior) over ()), 9) as blend from pool)", 0.5,
)


@query("select_random", POOL + f"select cell_code, ident, row_number() over (order by sha256('draw-1:' || ident), ident) as rank from pool qualify rank <= {BUDGET}")
def select_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.random_by_hash(_pool(spark, sf_dir), BUDGET, "draw-1").select("cell_code", "ident", "rank")


@query(
    "select_practice",
    POOL + f""", singles as (select cell_code, row_number() over (order by prior desc, cell_code) as place from pool where ord = 1),
pairs as (
  select p.cell_code, p.ident, p.prior, max(place) as enters
  from pool p join singles s on s.cell_code in (p.d0 * p.r0, p.d1 * p.r1, p.d2 * p.r2, p.d3 * p.r3) where p.ord = 2 group by all
), cnt as (select enters, sum(count(*)) over (order by enters) as total from pairs group by enters),
cut as (select coalesce(min(case when total >= {BUDGET} then enters end), max(enters)) as cut from cnt)
select cell_code, ident, prior, row_number() over (order by prior desc, cell_code) as rank from pairs, cut where enters <= cut qualify rank <= {BUDGET}""",
)
def select_practice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.practice(_pool(spark, sf_dir), BUDGET)


@query(
    "ties_at_cut",
    POOL + """, st as (select structural as score, count(*) as n, sum(count(*)) over (order by structural desc) - count(*) as before from pool group by structural)
select budget, score as boundary_score, n as stratum_size, (budget - before)::bigint as n_taken, budget < before + n as crosses from st, (select unnest([8, 16, 24, 48, 96, 112, 192]) as budget) where before < budget and budget <= before + n""",
)
def ties_at_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ties_at_cut(_pool(spark, sf_dir), "structural", [8, 16, 24, 48, 96, 112, 192])


@query("budget_prefixes", S.with_(S.land(MAIN), S.POOL, S.top("info", 96)) + "select budget, count(*) as n, round(sum(info), 6) as info, max(rank) as last_rank from sel, (select unnest([12, 24, 48, 96]) as budget) where rank <= budget group by budget")
def budget_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ranking at the largest budget serves the smaller ones as prefixes."""
    ranked = selection.top(_pool(spark, sf_dir), "info", 96)
    return ranked.select("rank", "info", F.explode(F.array(*map(F.lit, (12, 24, 48, 96)))).alias("budget")).where("rank <= budget").groupBy("budget").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("info"), 6).alias("info"), F.max("rank").alias("last_rank"))


# ---------------------------------------------------------------- reveal, infer, score


@query("reveal", S.with_(S.land(MAIN), S.POOL, S.top("structural", BUDGET)) + "select cell_code, l.prior, dg from sel join land l using (cell_code) where dg is not null")
def reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _main(spark, sf_dir)
    return recovery.reveal(selection.top(selection.scored(cells), "structural", BUDGET), cells)


@query("posterior_mean", INFO + "select cell_code, measured, base, mu from told")
def posterior_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir)[2].select("cell_code", "measured", "base", "mu")


@query("calibrated_slope", INFO + "select round(slope, 6) as slope, n from fit")
def calibrated_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _main(spark, sf_dir)
    return recovery.slope(recovery.reveal(selection.top(selection.scored(cells), "structural", BUDGET), cells)).select(F.round("slope", 6).alias("slope"), "n")


_FOLDED = f"fr as (select l.cell_code, l.prior, l.dg, {_hash_sql()} % 5 as fold from sel s join land l using (cell_code))".replace("d0", "l.d0").replace("d1", "l.d1").replace("d2", "l.d2").replace("d3", "l.d3")
_CROSS = """ob as (select fold, sum(prior * dg) as xy, sum(prior * prior) as xx, count(*) as n from fr group by fold),
cs as (select fold, round(coalesce((sum(xy) over () - xy) / nullif(sum(xx) over () - xx, 0), 1.0), 9) as slope, (sum(n) over () - n)::bigint as n_fit from ob)"""


def _crossfit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = _main(spark, sf_dir)
    pool = selection.scored(cells)
    seen = recovery.reveal(selection.top(pool, "structural", BUDGET), cells)
    folded = seen.join(pool.select("cell_code", recovery.fold(None, 4, 5).alias("fold")), "cell_code")
    return cells, pool, folded


@query("crossfit_slopes", S.with_(S.land(MAIN), S.POOL, S.top("structural", BUDGET), _FOLDED, _CROSS) + "select fold, round(slope, 6) as slope, n_fit from cs")
def crossfit_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.crossfit_slopes(_crossfit(spark, sf_dir)[2]).select("fold", F.round("slope", 6).alias("slope"), "n_fit")


@query(
    "crossfit_contrasts",
    S.with_(S.land(MAIN), S.POOL, S.top("structural", BUDGET), _FOLDED, _CROSS)
    + f""", mu as (select p.cell_code, coalesce(fr.dg, round(coalesce(cs.slope, 1.0) * p.prior, 9)) as mu from (select *, {_hash_sql()} % 5 as fold from pool) p left join cs using (fold) left join fr using (cell_code))
select term, t_ord, round(sum(sign * mu), 6) as eps from clo join mu on member = cell_code where t_ord between 2 and 3 group by term, t_ord""",
)
def crossfit_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell is priced by the slope of the folds that it isn't in."""
    cells, pool, folded = _crossfit(spark, sf_dir)
    slopes = recovery.crossfit_slopes(folded).select("fold", "slope")
    priced = pool.withColumn("fold", recovery.fold(None, 4, 5)).join(slopes, "fold", "left").join(folded.select("cell_code", "dg"), "cell_code", "left")
    mu = priced.select("cell_code", F.coalesce("dg", F.round(F.coalesce("slope", F.lit(1.0)) * F.col("prior"), 9)).alias("mu"))
    return lattice.contrasts(cells.where("ord between 2 and 3"), mu, "mu", strict=True).select("term", "t_ord", F.round("eps", 6).alias("eps"))


@query("term_table", INFO + "select term, t_ord, n_measured, round(truth, 6) as truth, round(prior_eps, 6) as prior_eps, round(post_eps, 6) as post_eps, round(skeleton, 6) as skeleton, state from terms")
def term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).select("term", "t_ord", "n_measured", *[F.round(c, 6).alias(c) for c in ("truth", "prior_eps", "post_eps", "skeleton")], "state")


_TWICE = ", two as (select *, unnest([t_ord, 0]) as grp from terms)"
_R = S.avg_rank


@query(
    "recovery_by_order",
    INFO + _TWICE + f""", a as (select *, {_R('post_eps', 'grp')} as pr, {_R('truth', 'grp')} as tr from two),
g as (select *, {_R('post_eps', 'grp')} as pr, {_R('truth', 'grp')} as tr from two where informed and not pinned),
p as (select grp, round({S.pearson('post_eps', 'truth')}, 6) as pearson_predicted, round({S.pearson('pr', 'tr')}, 6) as spearman_predicted from g group by grp),
m as (
  select grp, count(*) as n_terms, count(*) filter (informed) as n_informed, count(*) filter (pinned) as n_pinned, round(count(*) filter (informed) / count(*), 6) as coverage_fraction,
         round({S.pearson('post_eps', 'truth')}, 6) as pearson, round({S.pearson('pr', 'tr')}, 6) as spearman,
         round(1.0 - sum((post_eps - truth) ** 2) / nullif(sum((prior_eps - truth) ** 2), 0), 6) as sse_gain from a group by grp
) select grp as t_ord, n_terms, n_informed, n_pinned, coverage_fraction, pearson, spearman, sse_gain, pearson_predicted, spearman_predicted from m left join p using (grp)""",
)
def recovery_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.by_order(_terms(spark, sf_dir))


@query("term_census", INFO + "select t_ord, state, count(*) as n from terms group by grouping sets ((t_ord, state), (state))")
def term_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned, informed and uninformed terms by order, and pooled (t_ord null)."""
    return _terms(spark, sf_dir).groupingSets([["t_ord", "state"], ["state"]], "t_ord", "state").agg(F.count(F.lit(1)).alias("n"))


def _partial_sql() -> str:
    rows = f", a as (select *, {_R('post_eps', 'grp')} as post_eps_rank, {_R('truth', 'grp')} as truth_rank, {_R('skeleton', 'grp')} as skeleton_rank from two)"
    cols = []
    for kind, end in (("pearson", ""), ("spearman", "_rank")):
        x, y, z = f"post_eps{end}", f"truth{end}", f"skeleton{end}"
        cols += [f"{S.pearson(x, y)} as {kind}_xy", f"{S.pearson(x, z)} as {kind}_xz", f"{S.pearson(y, z)} as {kind}_yz"]
    out = [f"round({k}_xy, 6) as {k}_raw, round({k}_xz, 6) as {k}_skeleton, round(case when {k}_xz is null or {k}_yz is null then {k}_xy else ({k}_xy - {k}_xz * {k}_yz) / sqrt((1 - {k}_xz ** 2) * (1 - {k}_yz ** 2)) end, 6) as {k}_partial" for k in ("pearson", "spearman")]
    return INFO + _TWICE + rows + f", c as (select grp, {', '.join(cols)} from a group by grp) select grp as t_ord, {', '.join(out)} from c"


@query("partial_correlation", _partial_sql())
def partial_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.partial_by_order(_terms(spark, sf_dir))


@query("hit_rate", S.with_(S.land(MAIN), S.POOL, S.top("prior", BUDGET)) + f", best as (select cell_code from land where ord between 1 and 3 order by dg desc, cell_code limit {BUDGET}) select count(*) as n_hits, round(count(*) / {BUDGET}, 6) as hit_rate from best semi join sel using (cell_code)")
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _main(spark, sf_dir)
    return recovery.hit_rate(selection.top(selection.scored(cells), "prior", BUDGET), cells, BUDGET)


@query(
    "common_terms",
    S.with_(S.land(MAIN), S.POOL, S.top("structural", BUDGET), S.told("sel"), S.top("prior", BUDGET, name="selb"), S.told("selb", "_b"))
    + """, j as (select a.informed as ia, a.pinned as pa, b.informed as ib, b.pinned as pb from terms a join terms_b b using (term))
select subset, count(*) as n_terms from (select unnest(['all_eligible', case when ia and ib and not pa and not pb then 'common_informed_not_pinned' end, case when not ia and not ib then 'common_uninformed' end]) as subset from j) where subset is not null group by subset""",
)
def common_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.common_terms(_terms(spark, sf_dir, "structural"), _terms(spark, sf_dir, "prior"))


# ---------------------------------------------------------------- folds, ranking metrics, gates


@query("outer_folds", POOL + ", f as (select cell_code, ord, ident, (row_number() over (partition by ord order by sha256('outer-1:' || ident), ident) - 1) % 5 as fold from pool where ord >= 2) select cell_code, ord, fold from f")
def outer_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.deal(_pool(spark, sf_dir).where("ord >= 2"), 5, "outer-1", "ord").select("cell_code", "ord", "fold")


@query("inner_folds", S.with_(S.land(MAIN), S.POOL, S.top("info", BUDGET)) + "select cell_code, (row_number() over (order by sha256('inner-1:' || ident), ident) - 1) % 3 as fold from sel")
def inner_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.deal(selection.top(_pool(spark, sf_dir), "info", BUDGET), 3, "inner-1").select("cell_code", "fold")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-2 and -3 cells with their fold, prior and centred measure as prediction and label."""
    pool = folds.deal(_pool(spark, sf_dir).where("ord >= 2"), 5, "outer-1", "ord").select("cell_code", "ident", "fold", "prior")
    return pool.join(_main(spark, sf_dir).select("cell_code", "dg"), "cell_code")


_JUDGED = ", ju as (select cell_code, ident, prior, dg, (row_number() over (partition by p.ord order by sha256('outer-1:' || ident), ident) - 1) % 5 as fold from pool p join (select cell_code, dg from land) using (cell_code) where p.ord >= 2)"
_REL = ", rel as (select *, case when dg > 0 then round((" + _R("dg", "fold, dg > 0") + ") / count(*) over (partition by fold, dg > 0), 9) else 0.0 end as relevance from ju)"


@query("percentile_relevance", POOL + _JUDGED + _REL + " select cell_code, fold, relevance from rel")
def percentile_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.relevance(_judged(spark, sf_dir), "dg", "fold").select("cell_code", "fold", "relevance")


@query(
    "ndcg_by_fold",
    POOL + _JUDGED + _REL + """, pl as (select *, row_number() over (partition by fold order by prior desc, ident) as mine, row_number() over (partition by fold order by relevance desc, ident) as ideal from rel)
select fold, round(case when max(relevance) = min(relevance) then 1.0 else coalesce(sum(relevance / log2(mine + 1)) filter (mine <= 10) / nullif(sum(relevance / log2(ideal + 1)) filter (ideal <= 10), 0), 0.0) end, 6) as ndcg from pl group by fold""",
)
def ndcg_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.ndcg(folds.relevance(_judged(spark, sf_dir), "dg", "fold"), "prior", "ident", 10, "fold")


_TOP_JUDGED = POOL + _JUDGED.replace("select cell_code, ident,", "select cell_code, p.d0, p.d1, p.d2, p.d3, ident,") + """, pl as (select *, row_number() over (partition by fold order by prior desc, ident) as mine, row_number() over (partition by fold order by dg desc, ident) as best from ju), dv as (
  select a.fold, round(avg((a.d0 <> b.d0)::int + (a.d1 <> b.d1)::int + (a.d2 <> b.d2)::int + (a.d3 <> b.d3)::int), 6) as mean_distance from pl a join pl b on a.fold = b.fold and a.cell_code <> b.cell_code where a.mine <= 10 and b.mine <= 10 group by a.fold
)"""


@query(
    "top_metrics_by_fold",
    _TOP_JUDGED + """
select fold, round(max(dg) filter (mine <= 10), 6) as best_in_top, round(max(dg) - max(dg) filter (mine <= 10), 6) as regret, round(count(*) filter (mine <= 10 and best <= 10) / 10, 6) as hit_rate,
       round(count(*) filter (mine <= 10 and dg > 0) / count(*) filter (mine <= 10), 6) as positive_fraction, count(*) filter (mine <= 10) as n_top, count(distinct (d0 > 0)::int + (d1 > 0)::int + (d2 > 0)::int + (d3 > 0)::int) filter (mine <= 10) as n_orders,
       count(distinct ident) filter (mine <= 10) as n_ids, any_value(mean_distance) as mean_distance from pl join dv using (fold) group by fold""",
)
def top_metrics_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir)
    digits = [f"d{k}" for k in range(4)]
    unlike = folds.top_diversity(rows.join(_main(spark, sf_dir).select("cell_code", *digits), "cell_code"), "prior", "ident", 10, digits, "fold")
    return folds.top_metrics(rows, "prior", "dg", "ident", 10, "fold").join(unlike, "fold")


def _orders_sql(by: str) -> str:
    return f"""with o as (select o_orderpriority, c_mktsegment, month(o_orderdate) as m, year(o_orderdate) as y, count(*) as n, sum(o_totalprice::decimal(18,2))::double as total from orders join customer on o_custkey = c_custkey group by all), g as (
  select y, m % 5 as fold, c_mktsegment as method, sum(total) / sum(n) as value from o group by all
), v as (select *, unnest([1, 2, 4]) as step from g), w as (select y, fold, method, step * 48 as budget, round(value / (1000 * (1 + ln(step))), 6) as value from v){by}"""


def _metric_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric of every (y, fold, method, budget), from orders: a grid of the shape that a benchmark leaves."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = joined.groupBy(F.year("o_orderdate").alias("y"), F.pmod(F.month("o_orderdate"), F.lit(5)).alias("fold"), F.col("c_mktsegment").alias("method")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))
    steps = sums.withColumn("step", F.explode(F.array(*map(F.lit, (1, 2, 4)))))
    return steps.select("y", "fold", "method", (F.col("step") * 48).alias("budget"), F.round(F.col("total") / F.col("n") / (1000 * (1 + F.ln("step"))), 6).alias("value"))


_AUC = ", auc as (select y, fold, method, round(avg(mid), 6) as auc from (select *, (value + lag(value) over (partition by y, fold, method order by budget)) / 2 as mid from w) group by all)"


@query("budget_auc", _orders_sql(_AUC) + " select y, fold, method, auc from auc")
def budget_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.budget_auc(_metric_grid(spark, sf_dir), "value", "budget", "y", "fold", "method")


_DELTA = _AUC + ", dl as (select coalesce(a.y, b.y) - 1992 as partition, coalesce(a.fold, b.fold) as fold, round(a.auc - b.auc, 6) as delta from (select * from auc where method = 'BUILDING') a full join (select * from auc where method = 'MACHINERY') b on a.y = b.y and a.fold = b.fold)"


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    auc = folds.budget_auc(_metric_grid(spark, sf_dir), "value", "budget", "y", "fold", "method")
    sides = [auc.where(F.col("method") == m).select((F.col("y") - 1992).alias("partition"), "fold", "auc") for m in ("BUILDING", "MACHINERY")]
    return folds.paired_deltas(*sides, "auc", ["partition", "fold"])


@query("paired_deltas", _orders_sql(_DELTA) + " select partition, fold, delta from dl")
def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir)


_MEANS = _DELTA + ", me as (select i as partition, count(delta) as n_cells, round(avg(delta), 6) as mean_delta from (select unnest(range(20)) as i) left join dl on partition = i group by i)"


@query("partition_deltas", _orders_sql(_MEANS) + " select partition, n_cells, mean_delta from me")
def partition_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.partition_means(_deltas(spark, sf_dir), 20)


@query(
    "sign_gate",
    _orders_sql(_MEANS) + """ select count(*) as n_partitions, count(*) filter (mean_delta > 0) as n_positive, round(avg(mean_delta), 6) as global_mean, round(quantile_cont(mean_delta, 0.5), 6) as median_mean,
case when count(mean_delta) < count(*) then 'incomplete' when count(*) filter (mean_delta > 0) >= 16 and avg(mean_delta) > 0 and quantile_cont(mean_delta, 0.5) > 0 then 'pass' else 'fail' end as status from me""",
)
def sign_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.sign_gate(folds.partition_means(_deltas(spark, sf_dir), 20), 16)


@query(
    "fisher_z_by_method",
    _orders_sql(", r as (select y, method, corr(budget, value) as r from w group by all)") + " select method, round(tanh(avg(atanh(least(greatest(r, -(1 - 1e-12)), 1 - 1e-12)))), 6) as mean_r from r group by method",
)
def fisher_z_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _metric_grid(spark, sf_dir).groupBy("y", "method").agg(stats.pearson(F.col("budget"), F.col("value")).alias("r"))
    return r.groupBy("method").agg(F.round(stats.fisher_z_mean(F.col("r")), 6).alias("mean_r"))


# ---------------------------------------------------------------- audits


@query(
    "key_audit",
    """with e as (select o_orderkey as l_orderkey, unnest(range(1, 4))::int as l_linenumber from orders),
s as (select l_orderkey, l_linenumber, count(*) as n, count(distinct l_returnflag || '|' || l_linestatus) as kinds from lineitem group by all)
select l_orderkey, l_linenumber, case when n is null then 'missing' when e.l_orderkey is null then 'unexpected' when n > 1 and kinds > 1 then 'divergent' when n > 1 then 'duplicate' end as finding
from e full join s using (l_orderkey, l_linenumber) where n is null or e.l_orderkey is null or n > 1""",
)
def key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers 1 to 3 of every order are due; what is missing, unexpected or there twice."""
    due = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("l_linenumber"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return folds.key_audit(due, lines, ["l_orderkey", "l_linenumber"], F.concat_ws("|", "l_returnflag", "l_linestatus"))


@query(
    "label_buckets",
    """with x as (select c_mktsegment as segment, case when c_custkey % 11 = 0 then null when c_custkey % 13 = 0 then 'nan'::double when c_custkey % 17 = 0 then 'infinity'::double when c_custkey % 19 = 0 then 0.0 when c_acctbal < -500 then c_acctbal else c_acctbal / 1000 end as v from customer),
f as (select *, v is not null and not isnan(v) and not isinf(v) as ok from x)
select segment, count(*) as selected, count(*) filter (ok and v > 0) as positive, count(*) filter (ok and v = 0) as zero, count(*) filter (ok and v < 0 and v > -1) as negative_in_domain,
  count(*) filter (ok and v <= -1) as outside_domain, count(*) filter (v is not null and not ok) as non_finite, count(*) filter (v is null) as missing from f group by segment""",
)
def label_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda m: F.pmod("c_custkey", F.lit(m)) == 0
    label = F.when(key(11), None).when(key(13), F.lit(float("nan"))).when(key(17), F.lit(float("inf"))).when(key(19), 0.0).when(F.col("c_acctbal") < -500, F.col("c_acctbal")).otherwise(F.col("c_acctbal") / 1000)
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), label.alias("v"))
    return audit.label_buckets(rows, F.col("v"), "segment")


@query(
    "value_profile",
    """select event_type, count(value) as n, count(*) filter (value > 0) as n_positive, count(*) filter (value <= 0) as n_nonpositive, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std,
  round(quantile_cont(value, 0.05), 6) as q05, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q75, round(quantile_cont(value, 0.95), 6) as q95 from events group by event_type""",
)
def value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.value_profile(table(spark, sf_dir, "events"), "value", "event_type")


@query(
    "duplicate_profile",
    """with g as (select md5(text) as ident, count(*) as n, count(quality) as there, count(distinct quality) as kinds from documents left join labels using (doc_id) group by md5(text)),
f as (select *, n > 1 and (kinds > 1 or (there > 0 and there < n)) as conflict from g)
select sum(n)::bigint as n_rows, count(*) as n_unique, count(*) filter (n > 1) as n_duplicate, count(*) filter (n > 1 and not conflict) as n_identical, count(*) filter (conflict) as n_conflicting,
  (select string_agg(ident, ',' order by ident) from (select ident from f where conflict order by ident limit 20)) as samples from f""",
)
def duplicate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once, and whether their quality labels agree."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("ident"))
    return audit.duplicates(texts.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left"), "ident", "quality")


@query("level_coverage", "select dim, count(distinct level) as n_levels, array_to_string(list_sort(list(distinct level)), '|') as levels from (select unnest(['o_orderpriority', 'o_orderstatus']) as dim, unnest([o_orderpriority, o_orderstatus]) as level from orders) group by dim")
def level_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.level_coverage(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])


_STATUSES = ("ok", "missing_text", "too_short", "bad_host", "truncated")


@query(
    "raw_status_counts",
    """with s as (select case when html is null then 'missing_text' when length(html) < 200 then 'too_short' when not regexp_matches(url, '^https?://[a-z0-9.-]+/') then 'bad_host' when not contains(html, '</html>') then 'truncated' else 'ok' end as status from pages)
select status, count(s.status) as n from (select unnest(['ok', 'missing_text', 'too_short', 'bad_host', 'truncated']) as status) left join s using (status) group by status""",
)
def raw_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a raw page breaks decides its status; no row is dropped."""
    html = F.col("html")
    status = F.when(html.isNull(), "missing_text").when(F.length(html) < 200, "too_short").when(~F.col("url").rlike("^https?://[a-z0-9.-]+/"), "bad_host").when(~html.contains("</html>"), "truncated").otherwise("ok")
    return audit.status_counts(table(spark, sf_dir, "pages"), status, list(_STATUSES))


@query("universe_diff", "select doc_id, 'missing' as finding from (select distinct doc_id from documents) anti join labels using (doc_id) union all select doc_id, 'unexpected' from (select distinct doc_id from labels) anti join documents using (doc_id)")
def universe_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.universe_diff(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("exact_duplicates", "select o_custkey, count(*) as n, count(distinct o_orderstatus || '|' || o_orderpriority) = 1 as exact from orders group by o_custkey having count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.collapse_exact(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"), "o_custkey", F.concat_ws("|", "o_orderstatus", "o_orderpriority"))


@query("chain_links", "select conv_id, turn, sha256(role || ':' || text) as digest, lag(sha256(role || ':' || text)) over w as parent, coalesce(turn = lag(turn) over w + 1, turn = 0) as contiguous from conversations window w as (partition by conv_id order by turn)")
def chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.chain(table(spark, sf_dir, "conversations"), "turn", F.concat("role", F.lit(":"), "text"), "conv_id")


@query("chain_audit", "with c as (select conv_id, turn, sha256(role || ':' || text) as digest, coalesce(turn = lag(turn) over w + 1, turn = 0) as contiguous from conversations window w as (partition by conv_id order by turn)) select conv_id, count(*) as n, count(*) filter (not contiguous) as gaps, max_by(digest, turn) as tip from c group by conv_id")
def chain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.chain_audit(audit.chain(table(spark, sf_dir, "conversations"), "turn", F.concat("role", F.lit(":"), "text"), "conv_id"), "turn", "conv_id")


@query("json_pointer", "select event_id, props->>'$.k' as k, props->>'$.missing' as missing from events")
def json_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", audit.pointed(F.col("props"), "/k").alias("k"), audit.pointed(F.col("props"), "/missing").alias("missing"))


@query(
    "claims",
    """with s as (select c_mktsegment as segment, count(*) as n, round(sum(c_acctbal::decimal(18,2))::double / count(*), 6) as mean, round(count(*) filter (c_acctbal > 0) / count(*), 6) as share from customer group by all)
select segment, replace(printf('%+.2f', mean), '-', '−') as mean, printf('%.1f%%', share * 100) as share, format('{:,}', n) as n from s""",
)
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)), 6).alias("mean"), F.round(F.count_if(F.col("c_acctbal") > 0) / F.count(F.lit(1)), 6).alias("share")
    )
    return rows.select("segment", audit.claim(F.col("mean"), "round", 2, signed=True).alias("mean"), audit.claim(F.col("share"), "ratio", 1).alias("share"), audit.claim(F.col("n"), "grouped").alias("n"))


# ---------------------------------------------------------------- transform


def _coefs(spark: SparkSession, sf_dir: str, name: str = MAIN) -> DataFrame:
    return transform.coefficients(landscape(spark, sf_dir, name), "dg")


def _spectrum(name: str) -> None:
    means = []
    for mask in range(16):
        keys = [f"d{k}" for k in range(4) if mask >> k & 1]
        means.append(f"select {mask} as mask, avg(m * m) as ms from (select avg(dg) as m from land {'group by ' + ', '.join(keys) if keys else ''})")
    moebius = """, ms as ({}), en as (
  select bit_count(a.mask)::int as ord, sum(case when bit_count(a.mask & ~b.mask) % 2 = 0 then b.ms else -b.ms end) as e from ms a join ms b on (b.mask & a.mask) = b.mask group by a.mask
), pe as (select ord, sum(e) as e from en group by ord), nm as (select ((d0 > 0)::int + (d1 > 0)::int + (d2 > 0)::int + (d3 > 0)::int)::int as ord, count(*) as n_modes from land group by all)
select ord, n_modes, round(e, 9) as energy, round(case when ord > 0 then e / sum(e) filter (ord > 0) over () end, 6) as share from pe join nm using (ord)""".format(" union all ".join(means))

    @query(f"spectrum_{name}", "with " + S.land(name) + moebius)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return transform.spectrum(_coefs(spark, sf_dir, name))


_spectrum("quad5")
_spectrum("mixed225")


@query("pairwise_coefficients", S.with_(S.land(MAIN), S.coefs(MAIN)) + "select k0, k1, k2, k3, round(coef, 6) as coef from coef where ord = 2")
def pairwise_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coefs(spark, sf_dir).where("ord = 2").select("k0", "k1", "k2", "k3", F.round("coef", 6).alias("coef"))


@query("effective_counts", S.with_(S.land(MAIN), S.coefs(MAIN)) + ", e as (select coef ** 2 as e, row_number() over w as rn, sum(coef ** 2) over (w rows unbounded preceding) as upto, sum(coef ** 2) over () as total from coef where ord > 0 window w as (order by coef ** 2 desc, k0, k1, k2, k3)) select share::double as share, min(rn)::int as n from e, (select unnest([0.9, 0.95, 0.99]::double[]) as share) where upto >= share * total - 1e-12 group by share")
def effective_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.effective_counts(_coefs(spark, sf_dir), [0.9, 0.95, 0.99])


@query("magnitude_quantiles", S.with_(S.land(MAIN), S.coefs(MAIN)) + "select ord, round(quantile_cont(abs(coef), 0.5), 6) as q50, round(quantile_cont(abs(coef), 0.9), 6) as q90, round(quantile_cont(abs(coef), 0.99), 6) as q99, round(max(abs(coef)), 6) as max from coef where ord > 0 group by ord")
def magnitude_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.magnitude_quantiles(_coefs(spark, sf_dir))


@query(
    "order_kernels",
    S.with_(S.land(MAIN), S.POOL, S.top("structural", 24)) + ", z as (select l.cell_code as u, s.cell_code as v, " + ", ".join(f"(l.d{k} = s.d{k})::int - 0.2::double as z{k}" for k in range(4)) + " from land l, sel s) select u, v, round(z0 + z1 + z2 + z3, 9) as k1, round(z0*z1 + z0*z2 + z0*z3 + z1*z2 + z1*z3 + z2*z3, 9) as k2 from z",
)
def order_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells against a selection."""
    cells = _main(spark, sf_dir)
    return transform.order_kernels(cells, selection.top(selection.scored(cells), "structural", 24), 4, 5)


@query("feature_design", CLO + "select term as row, member as col, m_ord as col_ord from clo where m_ord <= 2")
def feature_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.features(_main(spark, sf_dir))


@query("linear_prediction", CLO + "select term as row, round(0.5 + sum(prior), 6) as pred from clo join land on member = cell_code where m_ord <= 2 group by term")
def linear_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priors of the sub-cells as weights."""
    cells = _main(spark, sf_dir)
    weights = cells.where("ord between 1 and 2").select(F.col("cell_code").alias("col"), F.col("prior").alias("weight"))
    return transform.predict(transform.features(cells), weights, 0.5).select("row", F.round("pred", 6).alias("pred"))


# ---------------------------------------------------------------- resampling

_REPS = 200


def _boot_sql(values: str) -> str:
    return INFO + f""", nb as (select term, t_ord, post_eps, prior_eps, truth, row_number() over (partition by t_ord order by term) - 1 as idx, count(*) over (partition by t_ord) as n from terms),
dr as (select t_ord, rep, (('0x' || substr(sha256('boot-1:' || t_ord || ':' || rep || ':' || idx), 1, 12))::bigint % n) as idx from nb, (select unnest(range({_REPS})) as rep)),
rs as (select t_ord, rep, {values} from dr join nb using (t_ord, idx) group by t_ord, rep)"""


@query("bootstrap_interval", _boot_sql(f"round({S.pearson('post_eps', 'truth')}, 9) as r") + " select t_ord, count(r) as n_valid, round(case when count(r) >= 3 then quantile_cont(r, 0.025) end, 6) as lo, round(case when count(r) >= 3 then quantile_cont(r, 0.975) end, 6) as hi from rs group by t_ord")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.correlation_interval(_terms(spark, sf_dir), "post_eps", "truth", "term", _REPS, "boot-1", "t_ord")


@query("paired_bootstrap", _boot_sql(f"round({S.pearson('post_eps', 'truth')} - {S.pearson('prior_eps', 'truth')}, 9) as d") + " select t_ord, count(d) as n_valid, round(case when count(d) >= 3 then quantile_cont(d, 0.025) end, 6) as lo, round(case when count(d) >= 3 then quantile_cont(d, 0.975) end, 6) as hi from rs group by t_ord")
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of two correlations on the same resamples."""
    r = lambda c: stats.pearson(F.col(c), F.col("truth"))
    reps = resample.replicate(_terms(spark, sf_dir), "term", _REPS, "boot-1", {"d": r("post_eps") - r("prior_eps")}, "t_ord")
    return resample.interval(reps, "d", "t_ord")


_U = "('0x' || substr(sha256({}), 1, 12))::bigint"


@query(
    "hierarchical_bootstrap",
    POOL + _JUDGED + f""", er as (select fold, ident, abs(prior - dg) as err, row_number() over (partition by fold order by ident) - 1 as idx, count(*) over (partition by fold) as n from ju),
gr as (select fold, row_number() over (order by fold) - 1 as idx, count(*) over () as n from (select distinct fold from er)),
ou as (select rep, row_number() over (partition by rep order by gr.idx, gr.fold) as turn, gr.fold from (select rep, {_U.format("'boot-2:' || rep || ':' || idx")} % n as idx from gr, (select unnest(range({_REPS})) as rep)) join gr using (idx)),
inn as (select rep, turn, fold, {_U.format("'boot-2:' || rep || ':' || turn || ':' || fold || ':' || er.idx")} % n as idx from ou join er using (fold)),
me as (select rep, round(avg(m), 9) as mean from (select rep, turn, avg(err) as m from inn join er using (fold, idx) group by rep, turn) group by rep)
select count(mean) as n_valid, round(quantile_cont(mean, 0.025), 6) as lo, round(quantile_cont(mean, 0.975), 6) as hi from me""",
)
def hierarchical_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds are drawn, then cells within each drawn fold."""
    return resample.hierarchical(_judged(spark, sf_dir).withColumn("err", F.abs(F.col("prior") - F.col("dg"))), "fold", "err", "ident", _REPS, "boot-2")


@query("calibration_scatter", POOL + f", x as (select p.prior, l.dg, p.prior_var, abs(p.prior - l.dg) as err from pool p join (select cell_code, dg from land) l using (cell_code)), y as (select *, {_R('prior_var', '1')} as rv, {_R('err', '1')} as re from x) select count(*) as n, round(sum(prior * dg) / sum(prior * prior), 6) as slope, round(avg(err), 6) as mean_error, round({S.pearson('prior_var', 'err')}, 6) as pearson, round({S.pearson('rv', 're')}, 6) as spearman from y")
def calibration_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the prior's variance tell where the prior is wrong?"""
    rows = _pool(spark, sf_dir).select("cell_code", "prior", "prior_var").join(_main(spark, sf_dir).select("cell_code", "dg"), "cell_code").withColumn("err", F.abs(F.col("prior") - F.col("dg"))).withColumn("one", F.lit(1))
    rows = rows.withColumn("rv", stats.average_rank("prior_var", "one")).withColumn("re", stats.average_rank("err", "one"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(stats.slope(F.col("prior"), F.col("dg")), 6).alias("slope"), F.round(F.avg("err"), 6).alias("mean_error"), F.round(stats.pearson(F.col("prior_var"), F.col("err")), 6).alias("pearson"), F.round(stats.pearson(F.col("rv"), F.col("re")), 6).alias("spearman"))


# ---------------------------------------------------------------- scoring plan, samples, decisions

_PASSES = 4


def _plan_sql() -> str:
    coin = lambda k: f"('0x' || substr(sha256('mask-1:' || ident || ':' || pass || ':{k}'), 1, 8))::bigint % 2 = 1"
    shown = ", ".join(f"case when d{k} = 0 and pass > 0 and {coin(k)} then '*' else d{k}::varchar end as s{k}" for k in range(4))
    ask = " union all ".join(f"select cell_code, pass, {k} as dim, concat_ws(',', s0, s1, s2, s3) as pattern, concat_ws(',', {', '.join(repr('0') if j == k else f's{j}' for j in range(4))}) as base from pl where d{k} > 0" for k in range(4))
    digit = ", ".join(f"case when (m >> {k}) & 1 = 1 then '*' else d{k}::varchar end" for k in range(4))
    return POOL + f""", pl as (select cell_code, pass, d0, d1, d2, d3, {shown} from pool, (select unnest(range({_PASSES + 1})) as pass)),
ask as ({ask}), mg as (select concat_ws(',', {digit}) as pattern, round(avg(prior), 9) as mean from land, (select unnest(range(16))::int as m) group by 1),
un as (select distinct pattern, base from ask), sc as (select un.pattern, un.base, round(a.mean - b.mean, 9) as gain from un join mg a using (pattern) join mg b on un.base = b.pattern),
su as (select cell_code, pass, round(sum(gain), 9) as total from ask join sc using (pattern, base) group by all)"""


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..operators import scoring

    cells = _main(spark, sf_dir)
    return scoring.plan(selection.scored(cells), _PASSES, "mask-1"), scoring.marginals(cells, "prior")


@query("scoring_plan_rows", _plan_sql() + " select (select count(*) from ask) as planned, (select count(*) from un) as n_unique")
def scoring_plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import scoring

    planned, _ = _planned(spark, sf_dir)
    return planned.agg(F.count(F.lit(1)).alias("planned")).crossJoin(scoring.unique(planned).agg(F.count(F.lit(1)).alias("n_unique")))


@query("masked_scores", _plan_sql() + " select cell_code, round(max(total) filter (pass = 0), 6) as score, round(coalesce(var_pop(total) filter (pass > 0), 0), 6) as variance from su group by cell_code")
def masked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import scoring

    planned, means = _planned(spark, sf_dir)
    return scoring.finalize(planned, scoring.score(scoring.unique(planned), means))


@query("stratified_sample", "select c_custkey, c_mktsegment, c_nationkey, rn from (select *, row_number() over (partition by c_mktsegment, c_nationkey order by sha256('draw-2:' || c_custkey), c_custkey) as rn from customer) where rn <= 2")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows of every stratum without replacement, by a seeded order; the sampling is the feature."""
    from pyspark.sql import Window

    w = Window.partitionBy("c_mktsegment", "c_nationkey").orderBy(C.stable_order("draw-2", F.col("c_custkey").cast("string")), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("c_custkey", "c_mktsegment", "c_nationkey", "rn")


@query(
    "recovery_decision",
    _orders_sql(_AUC) + " select method, round(median(auc), 6) as median_auc, round(min(auc), 6) as min_auc, round(max(auc), 6) as max_auc, count(*) filter (auc > 120) as n_over, case when count(auc) < count(*) then 'incomplete' when median(auc) > 120 then 'pass' else 'fail' end as decision from auc group by method",
)
def recovery_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and ranges by method against a threshold; an undefined value leaves the decision open."""
    auc = folds.budget_auc(_metric_grid(spark, sf_dir), "value", "budget", "y", "fold", "method")
    decision = F.when(F.count("auc") < F.count(F.lit(1)), "incomplete").when(F.median("auc") > 120, "pass").otherwise("fail")
    return auc.groupBy("method").agg(F.round(F.median("auc"), 6).alias("median_auc"), F.round(F.min("auc"), 6).alias("min_auc"), F.round(F.max("auc"), 6).alias("max_auc"), F.count_if(F.col("auc") > 120).alias("n_over"), decision.alias("decision"))


#: Upper 97.5 per cent points of Student's t for 1 to 9 degrees of freedom, and of the normal distribution; fixed values.
T_975 = (12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157)
Z_975 = 1.959963984540054


def t_975_terms(z: float = Z_975) -> list[float]:
    """Coefficients of 1, 1/df, .. 1/df^4 of the expansion of t's quantile around the normal one; from 10 degrees of freedom on it is right to five places."""
    return [
        z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]


_T_SQL = f"case when n < 2 then null when n <= 10 then {list(T_975)}[n - 1] else " + " + ".join(f"{c!r}::double / (n - 1) ** {k}" for k, c in enumerate(t_975_terms())) + " end"


@query(
    "corrected_interval",
    _orders_sql(_DELTA) + f""", s as (select n, m, v, ({_T_SQL})::double as t from (select count(delta) as n, avg(delta) as m, var_samp(delta) as v from dl))
select n, round(m, 6) as mean, round(sqrt(v * (1.0 / n + 0.25)), 6) as se, round(m - t * sqrt(v * (1.0 / n + 0.25)), 6) as lo, round(m + t * sqrt(v * (1.0 / n + 0.25)), 6) as hi from s""",
)
def corrected_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of paired deltas with the variance that overlapping training sets call for; null below two deltas."""
    s = _deltas(spark, sf_dir).agg(F.count("delta").alias("n"), F.avg("delta").alias("m"), F.var_samp("delta").alias("v"))
    df = F.col("n") - 1
    t = F.when(df < 1, None).when(df <= len(T_975), F.get(F.array(*map(F.lit, T_975)), (df - 1).cast("int"))).otherwise(sum((F.lit(c) / F.pow(df, F.lit(k)) for k, c in enumerate(t_975_terms())), F.lit(0.0)))
    se = F.sqrt(F.col("v") * (1.0 / F.col("n") + 0.25))
    return s.select("n", F.round("m", 6).alias("mean"), F.round(se, 6).alias("se"), F.round(F.col("m") - t * se, 6).alias("lo"), F.round(F.col("m") + t * se, 6).alias("hi"))


_CLAIM = r"(Licensed under|Released under|licensed under)[^\n]*"


@query("claim_audit", f"select doc_id, line, contains(text, 'All rights reserved') as forbidden, sha256(line) as digest from (select doc_id, text, unnest(regexp_extract_all(text, '{_CLAIM}', 0)) as line from documents)")
def claim_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that claims something, whether a literal that may not stand beside it does, and its digest."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(_CLAIM))
    lines = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_CLAIM), 0)).alias("line"), F.col("text").contains("All rights reserved").alias("forbidden"))
    return lines.withColumn("digest", F.sha2("line", 256))
