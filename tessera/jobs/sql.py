"""SQL of the registered queries for another engine, from common table expressions that queries share."""

from __future__ import annotations

from math import sqrt

from ..operators.selection import SEED
from ..operators.transform import helmert
from ..sources.landscapes import REGISTRY

N = 4
D = [f"d{k}" for k in range(N)]


def _cols(pattern: str) -> str:
    return ", ".join(pattern.format(k=k) for k in range(N))


def _plus(pattern: str) -> str:
    return " + ".join(pattern.format(k=k) for k in range(N))


def land(name: str) -> str:
    """``land``: the landscape; without the leading ``with``."""
    spec = REGISTRY[name]
    regions = """
    join nation cn on c_nationkey = cn.n_nationkey join region cr on cn.n_regionkey = cr.r_regionkey
    join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey join region sr on sn.n_regionkey = sr.r_regionkey"""
    names = [{"c_region": "cr.r_name", "s_region": "sr.r_name"}.get(d, d) for d in spec.dims]
    return f"""base as (
  select {", ".join(f"{c} as v{k}" for k, c in enumerate(names))}, l_linenumber,
         sum(l_extendedprice::decimal(18,2)) as price, sum(l_quantity::decimal(18,2)) as qty, count(*) as n
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey{regions if spec.regions else ""}
  group by all
), cell as (
  select {_cols("v{k}")}, sum(n)::bigint as n_rows, sum(price)::double / sum(n) as price, sum(qty)::double / sum(n) as qty, var_pop(ln(qty::double / n)) as spread
  from base group by all
), digit as (
  select *, {_cols("(dense_rank() over (order by v{k}) - 1)::int as d{k}")} from cell
), room as (
  select 1::bigint as r0, (max(d0) + 1)::bigint as r1, ((max(d0) + 1) * (max(d1) + 1))::bigint as r2, ((max(d0) + 1) * (max(d1) + 1) * (max(d2) + 1))::bigint as r3 from digit
), zero as (
  select price as price0, qty as qty0, {_cols("v{k} as w{k}")} from digit where {" and ".join(f"d{k} = 0" for k in range(N))}
), land as (
  select ({_plus("d{k} * r{k}")})::bigint as cell_code, {_cols("d{k}")}, {_cols("r{k}")}, {_cols("v{k}")}, {_cols("w{k}")},
         ({_plus("(d{k} > 0)::int")})::int as ord, n_rows, round(price, 6) as measure, round(ln(price) - ln(price0), 9) as dg,
         round(ln(qty) - ln(qty0), 9) as prior, round(spread, 9) as prior_var
  from digit, room, zero
)"""


IDENT = "'[' || array_to_string(list_filter([" + ", ".join(f"case when d{k} > 0 then '[{k},\"' || w{k} || '\",\"' || v{k} || '\"]' end" for k in range(N)) + "], lambda x: x is not null), ',') || ']'"

#: ``loops``, ``pool``: needs ``land``. ``clo``: the closure of all cells.
CLOSURE = f"""clo as (
  select cell_code as term, ord as t_ord, ({_plus("((mask >> {k}) & 1) * d{k} * r{k}")})::bigint as member, bit_count(mask)::int as m_ord,
         case when (ord - bit_count(mask)) % 2 = 0 then 1.0 else -1.0 end::double as sign
  from land, (select unnest(range(1, 16))::int as mask)
  where {" and ".join(f"(((mask >> {k}) & 1) = 0 or d{k} > 0)" for k in range(N))}
)"""
POOL = f"""{CLOSURE}, loops as (
  select member, count(*) as loops from clo where t_ord between 2 and 3 group by member
), pool as (
  select cell_code, ord, {_cols("d{k}")}, {_cols("r{k}")}, prior, prior_var, {IDENT} as ident, coalesce(loops, 0) as loops,
         round(prior_var * coalesce(loops, 0), 9) as info, coalesce(loops, 0)::double as structural
  from land left join loops on cell_code = member where ord between 1 and 3
)"""


def top(score: str, budget: int, seed: str = SEED, name: str = "sel", pool: str = "pool") -> str:
    return f"""{name} as (
  select * from (select *, row_number() over (order by {score} desc, sha256('{seed}:' || ident), ident) as rank from {pool}) where rank <= {budget}
)"""


def told(sel: str, end: str = "") -> str:
    """``rev``, ``fit``, ``told`` and ``terms`` of a selection, each with ``end`` in its name."""
    return f"""rev{end} as (select s.cell_code, l.prior, l.dg from {sel} s join land l using (cell_code) where dg is not null),
fit{end} as (select round(coalesce(sum(prior * dg) / nullif(sum(prior * prior), 0), 1.0), 9) as slope, count(*) as n from rev{end}),
told{end} as (
  select p.cell_code, p.ord, p.ident, p.prior, r.dg as measured, round(slope * p.prior, 9) as base, coalesce(r.dg, round(slope * p.prior, 9)) as mu, slope
  from pool p left join rev{end} r using (cell_code), fit{end}
), raw{end} as (
  select term, t_ord, count(*) as n_members, count(measured) as n_measured, round(sum(sign * dg), 9) as truth, round(sum(sign * base), 9) as prior_eps,
         round(sum(sign * mu), 9) as post_eps, coalesce(round(sum(sign * measured), 9), 0.0) as skeleton
  from clo join told{end} t on member = t.cell_code join land l on member = l.cell_code where t_ord between 2 and 3 group by term, t_ord
), terms{end} as (
  select *, n_measured > 0 as informed, n_measured = n_members as pinned,
         case when n_measured = n_members then 'pinned' when n_measured > 0 then 'informed' else 'uninformed' end as state from raw{end}
)"""


def pearson(x: str, y: str) -> str:
    """Guarded as in the library: null below three points and for a side that is constant."""
    flat = lambda c: f"max({c}) - min({c}) <= 1e-12 * greatest(1.0, max(abs({c})))"
    return f"case when count({x}) >= 3 and not ({flat(x)}) and not ({flat(y)}) then covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) end"


def avg_rank(x: str, by: str) -> str:
    return f"rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0"


def coefs(name: str) -> str:
    """``coef``: the transform with the same Helmert basis, for the numbers of levels of ``name``."""
    sizes = {"quad5": (5, 5, 5, 5), "mixed225": (3, 5, 5, 3), "mixed150": (3, 2, 5, 5)}[name]
    bases = ", ".join(f"b{k}(k{k}, d{k}, x{k}) as (values {', '.join(f'({i}, {j}, {b!r}::double)' for i, row in enumerate(helmert(q)) for j, b in enumerate(row))})" for k, q in enumerate(sizes))
    return f"""{bases}, coef as (
  select k0, k1, k2, k3, (k0 > 0)::int + (k1 > 0)::int + (k2 > 0)::int + (k3 > 0)::int as ord, round(sum(x0 * x1 * x2 * x3 * dg), 9) as coef
  from land join b0 using (d0) join b1 using (d1) join b2 using (d2) join b3 using (d3) group by all
)"""


def with_(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


SQRT2 = sqrt(2)
