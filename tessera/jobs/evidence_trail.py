"""Registered queries that trace claims to what they cite, compare configurations, and profile tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import artifacts, audit, conformance, profile
from ..sources.tables import table
from .catalog import query

# ---------------------------------------------------------------- claims


def _trail(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, manifest and claims about the events of each kind: artifacts are their counts, documents state some of them, not all rightly."""
    k = F.get_json_object("props", "$.k").cast("long")
    facts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("s"), F.min(k).alias("lo"), F.max(k).alias("hi"))
    content = F.format_string('{"type":"%s","n":%d,"k":{"sum":%d,"a/b":%d},"range":[%d,%d],"zero":0}', "t", "n", "s", "n", "lo", "hi")
    facts = facts.withColumn("artifact", F.concat(F.lit("artifacts/"), "t", F.lit(".json"))).withColumn("document", F.concat(F.lit("docs/"), "t", F.lit(".md"))).withColumn("json", content)
    text = F.concat(F.lit("There are "), F.format_string("%,d", F.col("n")), F.lit(" of them, "), F.format_string("%.2f", F.col("s") / F.col("n")), F.lit(" on average, up to "), F.col("hi").cast("string"), F.lit(". ![Counts](figures/"), "t", F.lit(".png)"))
    files = facts.select(F.col("artifact").alias("path"), F.col("json").alias("content")).unionByName(facts.select(F.col("document").alias("path"), text.alias("content")))
    changed = F.when(F.col("n") % 3 == 0, F.concat("json", F.lit(" "))).otherwise(F.col("json"))
    manifest = facts.where("n % 5 <> 0").select(F.col("artifact").alias("path"), F.sha2(changed, 256).alias("sha256"), F.lit("data").alias("kind"), F.lit(None).cast("string").alias("renderer"))
    said = [
        ("count", "/n", "grouped", 0, None, F.format_string("%,d", F.col("n")), F.concat(F.lit("There are "), F.format_string("%,d", F.col("n")))),
        ("mean", "/k/sum", "ratio", 2, "/n", F.format_string("%.2f", F.col("s") / F.col("n")), F.concat(F.format_string("%.2f", F.col("s") / F.col("n")), F.lit(" on average"))),
        ("top", "/range/1", "identity", 0, None, F.col("hi").cast("string"), F.concat(F.lit("up to "), F.col("hi").cast("string"))),
        ("escaped", "/k/a~1b", "round", 1, None, F.format_string("%.1f", F.col("n").cast("double")), F.format_string("%.1f", F.col("n").cast("double"))),
        ("lost", "/k/missing", "round", 1, None, F.lit("1.0"), F.lit("1.0")),
        ("text", "/type", "round", 1, None, F.lit("1.0"), F.lit("1.0")),
        ("nought", "/n", "ratio", 1, "/zero", F.lit("1.0"), F.lit("1.0")),
        ("wrong", "/range/0", "round", 0, None, F.lit("-7"), F.lit("-7")),
    ]
    one = [
        F.struct(F.concat("t", F.lit(f"-{name}")).alias("id"), "document", "artifact", F.lit(p).alias("pointer"), F.lit(how).alias("transform"), F.lit(d).alias("digits"), F.lit(False).alias("plus"), F.lit(True).alias("minus"),
                 F.lit(over).cast("string").alias("denominator"), shown.alias("rendered"), anchor.alias("anchor"))
        for name, p, how, d, over, shown, anchor in said
    ]
    return files, manifest, facts.select(F.explode(F.array(*one)).alias("c")).select("c.*")


@query(
    "claim_resolution",
    """with f as (
  select event_type as t, count(*) as n, sum((props->>'$.k')::bigint)::bigint as s, min((props->>'$.k')::bigint) as lo, max((props->>'$.k')::bigint) as hi from events group by event_type
), g as (
  select *, n % 5 <> 0 as listed, n % 3 <> 0 as whole, format('{:,}', n) as grouped, printf('%.2f', (s / n)::double) as mean from f
), c as (
  select *, unnest(['count', 'mean', 'top', 'escaped', 'lost', 'text', 'nought', 'wrong']) as name, unnest([grouped, mean, hi::varchar, printf('%.1f', n::double), null, null, null, lo::varchar]) as expected from g
)
select t || '-' || name as id, case when listed then expected end as expected, case when not listed then 'unlisted artifact' when not whole then 'checksum differs'
  else case name when 'escaped' then 'not in its document' when 'lost' then 'pointer not found' when 'text' then 'not a number' when 'nought' then 'invalid denominator' when 'wrong' then 'renders otherwise' else 'ok' end end as status from c""",
)
def claim_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim about the events, resolved; what is expected of claims on an artifact that isn't listed is nobody's business."""
    files, manifest, claims = _trail(spark, sf_dir)
    found = artifacts.audit_claims(claims, manifest, files)
    return found.select("id", F.when(F.col("status") != "unlisted artifact", F.col("expected")).alias("expected"), "status")


@query("figure_audit", "select 'figures/' || event_type || '.png' as path, 'unlisted figure' as status from events group by event_type")
def figure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures that documents show, against the manifest."""
    files, manifest, claims = _trail(spark, sf_dir)
    return artifacts.audit_figures(files.where("path like 'docs/%'"), manifest, files, claims, "figures")


_FORBIDDEN = ["All rights reserved", "Licensed under", "lorem ipsum"]


@query("forbidden_literals", f"select doc_id::varchar as path, literal from documents, (select unnest({_FORBIDDEN}) as literal) where contains(text, literal)")
def forbidden_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each literal that it may not hold."""
    return artifacts.forbidden(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")), _FORBIDDEN)


# ---------------------------------------------------------------- digests at any size


def _tree_sql(name: str, ids: str) -> str:
    """``name``: n, digest of the set of ``ids`` (one column, x)."""
    out = [f"""{name}_i as (select distinct sha256(x::varchar) as d from ({ids}) where x is not null), {name}_n as (select count(*) as n from {name}_i),
{name}_9 as (select p, sha256(string_agg(d, '' order by d)) as d from (select d, substr(d, 1, {' + '.join(f"(n > {audit.LEAF_IDS * 16**k})::int" for k in range(audit.MOST_DIGITS))}) as p from {name}_i, {name}_n) group by p)"""]
    for k in range(audit.MOST_DIGITS, 0, -1):
        out.append(f"{name}_{k} as (select substr(p, 1, {k - 1}) as p, sha256(string_agg(d, '' order by p)) as d from {name}_{k + 1} where length(p) = {k} group by substr(p, 1, {k - 1}) union all select p, d from {name}_{k + 1} where length(p) < {k})")
    return ",\n".join(out) + f", {name} as (select n, d as digest from {name}_1, {name}_n)"


@query(
    "tree_digests",
    "with " + _tree_sql("s", "select o_orderkey as x from orders") + ", " + _tree_sql("m", "select o_orderkey || chr(9) || o_orderkey % 5 as x from orders") + f""", q0 as (
  select event_id // {audit.NODE_PLACES} as pos, sha256(string_agg(sha256(event_type), '' order by event_id)) as d from events group by 1
), q1 as (select pos // {audit.NODE_PLACES} as pos, sha256(string_agg(d, '' order by pos)) as d from q0 group by 1), q2 as (select pos // {audit.NODE_PLACES} as pos, sha256(string_agg(d, '' order by pos)) as d from q1 group by 1),
e as (select count(*) as n from events), q as (select n, d as digest from q0, e where n <= {audit.NODE_PLACES} union all select n, d from q1, e where n > {audit.NODE_PLACES} and n <= {audit.NODE_PLACES**2} union all select n, d from q2, e where n > {audit.NODE_PLACES**2})
select 'set' as kind, n, digest from s union all select 'fold_map', n, digest from m union all select 'sequence', n, digest from q""",
)
def tree_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of a set, of a sequence and of a map of folds, by trees that no task holds whole."""
    orders, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    parts = {
        "set": audit.tree_digest(orders, F.col("o_orderkey")), "fold_map": audit.map_digest(orders, F.col("o_orderkey"), F.col("o_orderkey") % 5),
        "sequence": audit.sequence_digest(events, "event_id", F.col("event_type")),
    }
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("kind"), "n", "digest")
        out = df if out is None else out.unionByName(df)
    return out


# ---------------------------------------------------------------- conformance


#: What every run is to have; scale may be smaller in a trial.
PROTOCOL = [("version", "v1", None), ("budgets", "12,24,48,96", None), ("max_order", "3", None), ("partitions", "5", 5), ("seeds", "0,1", 2)]
_PROTOCOL_SQL = "(values " + ", ".join(f"('{f}', '{v}', {s or 'null'}::int)" for f, v, s in PROTOCOL) + ") as p(field, expected, expected_size)"


@query(
    "conformance",
    f"""with o as (
  select o_custkey as run, o_orderpriority as part, o_orderkey % 2 as seed, o_orderstatus as st, year(o_orderdate) as y, c_mktsegment as seg, c_acctbal as bal, o_totalprice as price from orders join customer on o_custkey = c_custkey
), c as (
  select run, count(distinct part) as parts, array_to_string(list_sort(list(distinct seed)), ',') as seeds, count(distinct seed) as n_seeds, any_value(seg) as seg, any_value(bal) as bal, avg(price) as mean from o group by run
), f as (
  select run, unnest(['version', 'budgets', 'max_order', 'partitions', 'seeds']) as field,
         unnest([case when seg = 'MACHINERY' and bal > 5000 then 'v2' else 'v1' end, case when bal < 0 then '96,48,24,12' else '12,24,48,96' end, case when bal > 9000 then null else '3' end, parts::varchar, seeds]) as observed, unnest([null, null, null, parts, n_seeds]::int[]) as size from c
), j as (
  select run, p.field, f.observed is distinct from p.expected as off, coalesce(f.size < expected_size, false) as smaller from {_PROTOCOL_SQL} join f using (field)
), m as (
  select run, coalesce(array_to_string(list_sort(list(field) filter (off)), ','), '') as mismatches, count(*) filter (off) as n_off, bool_and(not off or smaller) as only_smaller from j group by run
), r as (
  select run, count(*) filter (n > 1) as n_repeated, count(distinct part) - count(distinct part) filter (st = 'F') as n_missing from (select run, part, seed, st, y, count(*) as n from o group by all) group by run
)
select m.run, mismatches, n_off = 0 as conforming, n_missing, n_repeated,
       case when n_off > 0 then case when only_smaller and n_missing = 0 and n_repeated = 0 then 'smoke_or_exploratory_profile' else 'nonconforming_protocol_profile' end
            when n_repeated > 0 then 'nonconforming_protocol_profile' when n_missing > 0 then 'insufficient_valid_partitions' when c.mean > 260000 then 'pass' else 'fail' end as status
from m join r using (run) join c using (run)""",
)
def conformance_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer as a run: its configuration against the protocol, its records against what is due, and the status that is left."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("part"), (F.col("o_orderkey") % 2).alias("seed"), F.col("o_orderstatus").alias("st"), F.year("o_orderdate").alias("y"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"), "o_totalprice")
    c = o.groupBy("run").agg(F.count_distinct("part").cast("int").alias("parts"), F.array_sort(F.collect_set("seed")).alias("seeds"), F.first("seg").alias("seg"), F.first("bal").alias("bal"), F.avg("o_totalprice").alias("mean"))
    machines = (F.col("seg") == "MACHINERY") & (F.col("bal") > 5000)
    observed = {
        "version": (F.when(machines, "v2").otherwise("v1"), None), "budgets": (F.when(F.col("bal") < 0, "96,48,24,12").otherwise("12,24,48,96"), None), "max_order": (F.when(F.col("bal") > 9000, None).otherwise("3"), None),
        "partitions": (F.col("parts").cast("string"), F.col("parts")), "seeds": (F.array_join(F.col("seeds").cast("array<string>"), ","), F.size("seeds")),
    }
    configs = conformance.unpivoted(c, "run", observed)
    found = conformance.compared(configs, spark.createDataFrame(PROTOCOL, "field string, expected string, expected_size int"), "run")
    records = o.groupBy("run", "part", "seed", "st", "y").agg(F.count(F.lit(1)).alias("n")).groupBy("run")
    records = records.agg(F.count_if(F.col("n") > 1).alias("n_repeated"), (F.count_distinct("part") - F.count_distinct(F.when(F.col("st") == "F", F.col("part")))).alias("n_missing"))
    own = F.when(F.col("mean") > 260000, "pass").otherwise("fail")
    rows = found.join(records, "run").join(c.select("run", own.alias("own")), "run")
    return rows.select("run", "mismatches", "conforming", "n_missing", "n_repeated", conformance.status(F.col("own")).alias("status"))


# ---------------------------------------------------------------- a profile in one row


_DIMS = ["o_orderstatus", "o_orderpriority"]


@query(
    "composite_profile",
    """with s as (select string_agg(o_orderstatus || ':' || n, ',' order by o_orderstatus) as d0, count(*) as l0 from (select o_orderstatus, count(*) as n from orders group by 1)),
p as (select string_agg(o_orderpriority || ':' || n, ',' order by o_orderpriority) as d1, count(*) as l1 from (select o_orderpriority, count(*) as n from orders group by 1)),
k as (select count(*) as n_keys, count(*) filter (n > 1) as n_repeated_keys, max(n) as most_of_a_key from (select o_custkey, count(*) as n from orders group by 1)),
t as (select count(*) as n_rows, count(o_totalprice) as n_labels, count(*) filter (o_totalprice > 200000) as n_positive, round(min(o_totalprice), 2) as least, round(max(o_totalprice), 2) as largest, round(sum(o_totalprice::decimal(18,2))::double / count(*), 4) as mean from orders),
c as (select count(*) as n_cells from (select distinct o_orderstatus, o_orderpriority from orders))
select n_rows, n_labels, n_positive, least, largest, mean, d0 as o_orderstatus, l0 as n_o_orderstatus, d1 as o_orderpriority, l1 as n_o_orderpriority, n_cells, n_cells = l0 * l1 as complete, n_keys, n_repeated_keys, most_of_a_key from s, p, k, t, c""",
)
def composite_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in one row: counts, levels of each dimension, cells, labels and repeated keys, from one scan."""
    rows = table(spark, sf_dir, "orders").withColumn("label", F.col("o_totalprice") - 200000)
    p = profile.profile(rows, _DIMS, "o_custkey", F.col("o_totalprice"), F.col("label") > 0)
    levels = lambda d: F.array_join(F.transform(F.col(f"p.levels.{d}"), lambda x: F.concat(x["level"], F.lit(":"), x["n"].cast("string"))), ",").alias(d)
    return p.select(
        "p.n_rows", "p.labels.n_labels", "p.labels.n_positive", F.round("p.labels.least", 2).alias("least"), F.round("p.labels.largest", 2).alias("largest"), F.round("p.labels.mean", 4).alias("mean"),
        *[c for d in _DIMS for c in (levels(d), F.size(f"p.levels.{d}").cast("long").alias(f"n_{d}"))], "p.n_cells", "p.complete", "p.keys.n_keys", "p.keys.n_repeated_keys", "p.keys.most_of_a_key",
    )
