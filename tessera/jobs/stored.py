"""Registered queries of the text-shaped sources: files written from the given tables and read again, with SQL that gives the same rows from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.tables import new_folder, table
from .catalog import LAND, _main, query

#: The reference of the sequences made from orders, the places that may differ from it, and the letters that may stand there.
REFERENCE, SITES, LEVELS = "O1B0", [0, 1, 2], "FOP12345ABHM0"


@query(
    "raw_file_classes",
    """with r as (
  select o_orderkey as k, o_orderstatus || substr(o_orderpriority, 1, 1) || substr(c_mktsegment, 1, 1) || case when o_orderkey % 17 = 0 then 'F' when o_orderkey % 19 = 0 then 'Z' else '0' end || case when o_orderkey % 23 = 0 then 'x' else '' end as s,
         case when o_orderkey % 13 = 0 then null when o_orderkey % 29 = 0 then null else o_totalprice end as v from orders join customer on o_custkey = c_custkey
), c as (
  select *, case when length(s) <> 4 then 'wrong_length' when substr(s, 4, 1) = 'Z' then 'invalid_level' when substr(s, 4, 1) <> '0' then 'off_site' when v is null then 'missing_label' else 'ok' end as status from r
)
select status, count(*) as n, count(v) as n_values, round(sum(v::decimal(18,2))::double, 2) as total from c group by status""",
)
def raw_file_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a raw table of sequences and labels: every row of the file with the first rule that it breaks."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = lambda m: F.col("o_orderkey") % m == 0
    sequence = F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1), F.substring("c_mktsegment", 1, 1), F.when(key(17), "F").when(key(19), "Z").otherwise("0"), F.when(key(23), "x").otherwise(""))
    label = F.when(key(13), F.lit(" ")).when(key(29), F.lit("nan")).otherwise(F.col("o_totalprice").cast("string"))
    path = new_folder(spark)
    o.select(F.lit("extra").alias("note"), sequence.alias("sequence"), label.alias("label")).write.option("header", True).csv(path)
    rows = files.classify(files.read_raw(spark, path), REFERENCE, SITES, LEVELS)
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total"))


@query("score_store", LAND + "select cell_code, prior as score, prior_var as variance from land where ord > 0")
def score_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prior's scores, written once as a store of lines and read with its checks."""
    path = new_folder(spark)
    files.write_once(_main(spark, sf_dir).where("ord > 0").select("cell_code", F.col("prior").alias("score"), F.col("prior_var").alias("variance")), path)
    return files.read_store(spark, path)


@query("torn_store", "select c_custkey as cell_code, c_acctbal as score, c_nationkey::double as variance from customer where c_custkey < (select max(c_custkey) from customer)")
def torn_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a store whose writer died in its last line."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_code"), F.col("c_acctbal").alias("score"), F.col("c_nationkey").cast("double").alias("variance"))
    last = rows.agg(F.max("cell_code").alias("last"))
    line = F.to_json(F.struct("cell_code", "score", "variance"))
    path = new_folder(spark)
    # a store of lines is one file
    rows.crossJoin(F.broadcast(last)).coalesce(1).sortWithinPartitions("cell_code").select(F.when(F.col("cell_code") == F.col("last"), F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return files.read_torn_store(spark, path)


_SPEC = "chr((65 + o_orderkey % 26)::int) || (o_orderkey % 97 + 1) || chr((65 + o_custkey % 26)::int)"


@query(
    "spec_file",
    f"""with s as (select {_SPEC} || case when o_orderkey % 3 = 0 then ' ' || {_SPEC} when o_orderkey % 11 = 0 then ' bad' else '' end as spec, o_orderkey % 11 = 0 and o_orderkey % 3 <> 0 as bad, case when o_orderkey % 3 = 0 then 2 else 1 end as n from orders)
select spec, case when not bad then n end as n_tokens, count(*) as n from s group by all""",
)
def spec_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a file of specifications, some malformed: what is read of each, and how often it stands there."""
    letter = lambda c: F.chr(65 + F.col(c) % 26)
    spec = F.concat(letter("o_orderkey"), (F.col("o_orderkey") % 97 + 1).cast("string"), letter("o_custkey"))
    line = F.concat(spec, F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), spec)).when(F.col("o_orderkey") % 11 == 0, F.lit(" bad")).otherwise(""), F.lit(","), F.col("o_totalprice").cast("string"))
    path = new_folder(spark)
    table(spark, sf_dir, "orders").select(line.alias("value")).unionByName(spark.createDataFrame([("variant,score",), ("",)], "value string")).write.text(path)
    return files.read_specs(spark, path).groupBy("spec", F.size("cell").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n")).withColumn("n_tokens", F.when(F.col("n_tokens") >= 0, F.col("n_tokens")))
