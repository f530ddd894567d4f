"""What the operators of this subpackage share: reading, row keys, checkpoints, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: space and the five ASCII controls from tab to carriage return.
WORD_BREAKS = r"[\x20\x09-\x0D]+"
BREAK_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where none is named, a local master gets a temporary folder; a cluster must name one that all its machines share.
    """
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Lets Spark remove the shuffle files of each query that runs in here as soon as it ends, and puts the session's setting back.

    For loops of many small queries, whose files would otherwise stay on the executors' disks until the driver happens to collect its garbage.
    """
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, *superseded: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: later queries read the columns that they need.

    Tables that were ``written`` before and that nothing reads any more, now that this one is there, are removed.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    for old in superseded:
        for folder in {f.rpartition("/")[0] for f in old.inputFiles()}:
            if "/table-" in folder:
                at = spark._jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker at once, so that very long texts don't make batches of any size.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, its session's Arrow batches bounded in bytes unless the user has set a lower bound."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH_SETTING, str(BATCH_BYTES + 1)).rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def fits(df: DataFrame, limit_bytes: int, row_bytes: Column | int) -> bool:
    """Whether ``df`` takes at most ``limit_bytes``, by a count of its own: the check before a broadcast."""
    total = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0]
    return (total or 0) <= limit_bytes


def words(text: Column) -> Column:
    """The words of a text, in order; null for a null text."""
    return F.filter(F.split(text, WORD_BREAKS), lambda w: w != "")


def without_breaks(text: Column) -> Column:
    """The text without the characters that end a word."""
    return F.translate(text, BREAK_CHARS, "")


def digest(text: Column) -> Column:
    """128 bits that stand for a text, as two longs; a null text differs from an empty one."""
    return F.struct(
        F.xxhash64(F.coalesce(text, F.lit("")), F.lit(1), text.isNull()).alias("a"),
        F.xxhash64(F.lit(2), F.coalesce(text, F.lit("")), F.lit(3)).alias("b"),
    )


def text_id(df: DataFrame, name: str = "doc_id") -> Column:
    """The id as text: pandas has no null among whole numbers, and as floats large ids would lose digits."""
    return df[name].cast("string").alias(name)


def typed_id(df: DataFrame, like: DataFrame, name: str = "doc_id") -> DataFrame:
    """``df`` with the id, so far text, of the type that it has in ``like``."""
    return df.withColumn(name, F.col(name).cast(like.schema[name].dataType))
