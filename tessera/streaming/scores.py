"""An incremental store of scores: only what is missing is scored, batch by batch, and each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def missing(wanted: DataFrame, stored: DataFrame, key: str = "cell_code") -> DataFrame:
    """The wanted keys, once each, that the store lacks."""
    return wanted.select(key).distinct().join(stored.select(key), key, "left_anti")


def score_stream(source: DataFrame, store: str, scorer: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "cell_code") -> StreamingQuery:
    """Scores each key of a stream of candidates once and adds it to the Parquet folder ``store``.

    A batch writes to a folder of its own number and replaces it if it runs again, so a batch that an
    executor's loss interrupts leaves nothing twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.option("basePath", store).parquet(f"{store}/batch=*").where(f"batch <> {number}").select(key)
        except AnalysisException:  # the first batch finds no store
            stored = batch.select(key).limit(0)
        scorer(missing(batch, stored, key)).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
