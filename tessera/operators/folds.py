"""Stratified folds, ranking metrics, budget curves and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import stats


def deal(rows: DataFrame, folds: int, salt: str, by: str | None = None) -> DataFrame:
    """``rows`` (with ident) with ``fold``: dealt in a salted order of ids, within ``by`` if given. Identity alone decides."""
    if folds < 2:
        raise ValueError(f"two folds at least, not {folds}")
    window = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy(C.stable_order(salt, F.col("ident")), "ident")
    return rows.withColumn("fold", F.pmod(F.row_number().over(window) - 1, F.lit(folds)))


def relevance(rows: DataFrame, label: str, *by: str) -> DataFrame:
    """``relevance``: 0 for labels that aren't positive, else the average rank among the positives over their number."""
    positive = F.col(label) > 0
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, positive))
    return rows.withColumn("relevance", F.when(positive, F.round(stats.average_rank(label, *by, positive) / n, 9)).otherwise(0.0))


def ndcg(rows: DataFrame, pred: str, ident: str, k: int, *by: str) -> DataFrame:
    """``by``, ndcg at ``k`` of ``relevance``: ties by id; 1 if every relevance is the same."""
    mine, ideal = Window.partitionBy(*by).orderBy(F.desc(pred), ident), Window.partitionBy(*by).orderBy(F.desc("relevance"), ident)
    placed = rows.withColumn("mine", F.row_number().over(mine)).withColumn("ideal", F.row_number().over(ideal))
    gain = lambda place: F.sum(F.when(F.col(place) <= k, F.col("relevance") / F.log2(F.col(place) + 1)))
    same = F.max("relevance") == F.min("relevance")
    return placed.groupBy(*by).agg(F.round(F.when(same, 1.0).otherwise(F.coalesce(F.try_divide(gain("mine"), gain("ideal")), F.lit(0.0))), 6).alias("ndcg"))


def top_metrics(rows: DataFrame, pred: str, label: str, ident: str, k: int, *by: str) -> DataFrame:
    """``by``, the best label among the predicted top ``k``, its regret against the best of all, the hits, the positive share."""
    mine, best = Window.partitionBy(*by).orderBy(F.desc(pred), ident), Window.partitionBy(*by).orderBy(F.desc(label), ident)
    placed = rows.withColumn("mine", F.row_number().over(mine)).withColumn("best", F.row_number().over(best))
    within = F.col("mine") <= k
    return placed.groupBy(*by).agg(
        F.round(F.max(F.when(within, F.col(label))), 6).alias("best_in_top"),
        F.round(F.max(label) - F.max(F.when(within, F.col(label))), 6).alias("regret"),
        F.round(F.count_if(within & (F.col("best") <= k)) / k, 6).alias("hit_rate"),
        F.round(F.count_if(within & (F.col(label) > 0)) / F.count_if(within), 6).alias("positive_fraction"),
    )


def top_diversity(rows: DataFrame, pred: str, ident: str, k: int, digits: list[str], *by: str) -> DataFrame:
    """``by``, n_top, n_orders, n_ids, mean_distance: how unlike each other the predicted top ``k`` are.

    Orders are the numbers of digits that aren't zero; the distance of two is the number of digits in which they differ, its mean null below two.
    Only the top ``k`` of a group meet.
    """
    mine = Window.partitionBy(*by).orderBy(F.desc(pred), ident)
    order = sum(((F.col(d) > 0).cast("int") for d in digits), F.lit(0))
    top = rows.withColumn("mine", F.row_number().over(mine)).where(F.col("mine") <= k).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_top"), F.count_distinct(order).alias("n_orders"), F.count_distinct(ident).alias("n_ids"), F.collect_list(F.array(*[F.col(d).cast("int") for d in digits])).alias("cells")
    )
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    # each pair is met from both sides, and a cell is at no distance from itself
    total = F.aggregate(F.transform("cells", lambda a: F.aggregate(F.transform("cells", lambda b: apart(a, b)), F.lit(0), lambda s, x: s + x)), F.lit(0), lambda s, x: s + x)
    return top.select(*by, "n_top", "n_orders", "n_ids", F.round(F.try_divide(total, F.col("n_top") * (F.col("n_top") - 1)), 6).alias("mean_distance"))


def budget_auc(rows: DataFrame, value: str, budget: str, *by: str) -> DataFrame:
    """``by``, auc: the normalised trapezoid of a metric over log2(budget), for equally spaced grids; null if a value is."""
    w = Window.partitionBy(*by).orderBy(budget)
    step = rows.withColumn("gap", F.round(F.log2(budget) - F.log2(F.lag(budget).over(w)), 9)).withColumn("mid", (F.col(value) + F.lag(value).over(w)) / 2)
    whole = (F.count(value) == F.count(F.lit(1))) & (F.count(F.lit(1)) >= 2)
    even = F.assert_true(F.coalesce(F.max("gap") == F.min("gap"), F.lit(True)), F.lit("budgets are not equally spaced on log2"))
    return step.groupBy(*by).agg(F.when(whole & even.isNull(), F.round(F.avg("mid"), 6)).alias("auc"))


def paired_deltas(a: DataFrame, b: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Keys, delta: of the cells that either side has; null where one side lacks it."""
    return a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys, "full").select(*keys, F.round(F.col("a") - F.col("b"), 6).alias("delta"))


def partition_means(deltas: DataFrame, expected: int) -> DataFrame:
    """One row for each of the expected partitions, whether or not it has deltas: partition, n_cells, mean_delta."""
    spark = deltas.sparkSession
    return spark.range(expected).select(F.col("id").alias("partition")).join(deltas.groupBy("partition").agg(F.count("delta").alias("n_cells"), F.round(F.avg("delta"), 6).alias("mean_delta")), "partition", "left").select(
        "partition", F.coalesce("n_cells", F.lit(0).cast("long")).alias("n_cells"), "mean_delta"
    )


def sign_gate(means: DataFrame, least_positive: int) -> DataFrame:
    """One row: positives, global mean, median, and the verdict; any partition without a mean closes the gate."""
    complete = F.count("mean_delta") == F.count(F.lit(1))
    positive = F.count_if(F.col("mean_delta") > 0)
    opened: Column = complete & (positive >= least_positive) & (F.avg("mean_delta") > 0) & (F.expr("percentile(mean_delta, 0.5)") > 0)
    return means.agg(
        F.count(F.lit(1)).alias("n_partitions"), positive.alias("n_positive"), F.round(F.avg("mean_delta"), 6).alias("global_mean"), F.round(F.expr("percentile(mean_delta, 0.5)"), 6).alias("median_mean"),
        F.when(~complete, "incomplete").when(opened, "pass").otherwise("fail").alias("status"),
    )


def key_audit(expected: DataFrame, observed: DataFrame, keys: list[str], payload: Column) -> DataFrame:
    """One row for every key that is missing, unexpected, or there more than once: keys, finding.

    A repeated key is an exact duplicate if all its payloads are the same, else divergent.
    """
    seen = observed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.sha2(payload.cast("string"), 256)).alias("kinds"))
    both = expected.select(*keys).distinct().withColumn("due", F.lit(True)).join(seen, keys, "full")
    finding = F.when(F.col("n").isNull(), "missing").when(F.col("due").isNull(), "unexpected").when((F.col("n") > 1) & (F.col("kinds") > 1), "divergent").when(F.col("n") > 1, "duplicate")
    return both.select(*keys, finding.alias("finding")).where("finding is not null")
