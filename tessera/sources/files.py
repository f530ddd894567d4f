"""Reading and writing of text-shaped inputs: raw tables, score stores, sequences, specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C

RAW = "sequence string, label string"
STORE = "cell_code long, score double, variance double"
#: In the order in which they are looked for.
STATUSES = ("wrong_length", "invalid_level", "off_site", "missing_label", "ok")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every row of a CSV with a header, as text: sequence, label. Other columns are not read, and no row is dropped."""
    header = spark.read.option("header", True).csv(path).columns
    lacking = {"sequence", "label"} - set(header)
    if lacking:
        raise ValueError(f"{path} lacks the columns {sorted(lacking)}")
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path).select("sequence", "label")


def classify(raw: DataFrame, reference: str, sites: list[int], levels: str) -> DataFrame:
    """``raw`` with cell, value and status: the first rule that a row breaks decides."""
    value = F.expr("try_cast(trim(label) as double)")
    value = F.when(~F.isnan(value), value)
    fits = F.length("sequence") == len(reference)
    cell = F.when(fits, F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(reference) - 1)), lambda i: F.struct(i.alias("dim"), F.substring(F.lit(reference), i + 1, F.lit(1)).alias("ref"), F.substring(F.col("sequence"), i + 1, F.lit(1)).alias("level"))), lambda x: x["ref"] != x["level"]))
    rows = raw.withColumn("cell", cell).withColumn("value", value)
    bad_level = F.exists("cell", lambda x: ~F.array_contains(F.array(*map(F.lit, levels)), x["level"]))
    off_site = F.exists("cell", lambda x: ~F.array_contains(F.array(*map(F.lit, sites)), x["dim"]))
    status = F.when(~F.coalesce(fits, F.lit(False)), "wrong_length").when(bad_level, "invalid_level").when(off_site, "off_site").when(F.col("value").isNull(), "missing_label").otherwise("ok")
    return rows.withColumn("status", status)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines store of scores. A key that is there twice is an error, and so is a line that can't be read."""
    rows = spark.read.schema(f"{STORE}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where(F.assert_true(F.col("_bad").isNull(), F.concat(F.lit("unreadable: "), F.col("_bad"))).isNull()).drop("_bad")
    copies = rows.groupBy("cell_code").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(copies, "cell_code").where(F.assert_true(F.col("n") == 1, F.concat(F.lit("twice in the store: "), F.col("cell_code").cast("string"))).isNull()).drop("n")


def read_torn_store(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_store``, but the last line may be torn: a writer that died leaves one line without its end.

    Lines are told apart by their place in the file, so this is for stores of one file.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where("trim(value) <> ''")
    last = lines.agg(F.max("at").alias("last"))
    rows = lines.crossJoin(last).select("at", "last", "value", F.from_json("value", STORE).alias("r"), F.col("value").rlike(r"^\s*\{.*\}\s*$").alias("whole"))
    # one condition, as of two the optimizer could take the second first and never meet a torn line in the middle
    torn = F.assert_true(F.col("at") == F.col("last"), F.concat(F.lit("unreadable: "), F.col("value"))).isNotNull()
    return rows.where(F.when(F.col("whole"), True).otherwise(torn)).select("r.*")


def write_once(df: DataFrame, path: str) -> None:
    """Writes JSON to a new folder; what is there already stays, and that is an error."""
    df.write.mode("errorifexists").json(path)


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """The one record of a FASTA file: name, sequence in upper case."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"^>([^\n]*)", 1).alias("name"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^>[^\n]*\n", ""), r"\s", "")).alias("sequence"))
    return text.where(F.assert_true(~F.col("sequence").contains(">"), F.lit("more than one record")).isNull())


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """One specification a line, up to the first comma; a header line and blank ones are passed over: spec, cell."""
    spec = F.trim(F.split_part("value", F.lit(","), F.lit(1)))
    rows = spark.read.text(path).select(spec.alias("spec")).where("spec <> '' and lower(spec) not in ('spec', 'variant', 'mutations')")
    return rows.withColumn("cell", C.parse_notation(F.col("spec")))
