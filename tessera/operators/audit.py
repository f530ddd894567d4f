"""Integrity audits: labels, duplicates, universes, chains, documents and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The limits of so many groups are broadcast; those of more are joined by a shuffle.
FEW_GROUPS = 10_000


def label_buckets(rows: DataFrame, label: Column, *by: str) -> DataFrame:
    """Six buckets that don't overlap and that add up to the rows, by ``by``; a null label is missing."""
    finite = label.isNotNull() & ~F.isnan(label) & (F.abs(label) < float("inf"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("selected"),
        F.count_if(finite & (label > 0)).alias("positive"), F.count_if(finite & (label == 0)).alias("zero"),
        F.count_if(finite & (label < 0) & (label > -1)).alias("negative_in_domain"), F.count_if(finite & (label <= -1)).alias("outside_domain"),
        F.count_if(label.isNotNull() & ~finite).alias("non_finite"), F.count_if(label.isNull()).alias("missing"),
    )


def value_profile(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Counts by sign, moments (population) and exact, interpolated quantiles."""
    out = rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.count_if(F.col(value) > 0).alias("n_positive"), F.count_if(F.col(value) <= 0).alias("n_nonpositive"),
        F.round(F.min(value), 6).alias("min"), F.round(F.max(value), 6).alias("max"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_pop(value), 4).alias("std"),
    )
    shares = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}
    return out.join(quantiles(rows, value, shares, *by), list(by), "left").select(*by, "n", "n_positive", "n_nonpositive", "min", "max", "mean", "std", *[F.round(c, 6).alias(c) for c in shares])


#: A sketch's places are off by a share of one in so many at most.
ACCURACY = 10_000
#: Groups of fewer values are ordered whole; in larger ones five parts in ``ACCURACY`` are many places.
FEW_VALUES = 10 * ACCURACY


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """``by`` and a column for each share: exact quantiles, between two values in proportion, of groups of any size and any distribution.

    A sketch of each group, made where the rows are read, gives two values around each wanted place that follow the data, so no
    outlier widens them. What lies below is counted, and only the values between, counted first, are ordered: about one in a thousand of a
    large group, all of one with fewer than ``FEW_VALUES``. A place that weren't between would be an error. Nulls and NaN are left out.
    """
    x = F.col(value).cast("double")
    there = rows.select(*by, x.alias("x")).where(x.isNotNull() & ~F.isnan(x))
    clip = lambda q: F.lit(float(min(max(q, 0.0), 1.0)))
    sketch = F.percentile_approx("x", F.array(*[clip(q + d * 5 / ACCURACY) for q in shares.values() for d in (-1, 1)]), ACCURACY)
    limits = there.groupBy(*by).agg(sketch.alias("cuts"), F.count(F.lit(1)).alias("n"))
    low = lambda k, q: F.when((F.col("n") < FEW_VALUES) | F.lit(q <= 5 / ACCURACY), F.lit(float("-inf"))).otherwise(F.col("cuts")[2 * k])
    high = lambda k, q: F.when((F.col("n") < FEW_VALUES) | F.lit(q >= 1 - 5 / ACCURACY), F.lit(float("inf"))).otherwise(F.col("cuts")[2 * k + 1])
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), low(k, q).alias("low"), high(k, q).alias("high"), F.floor((F.col("n") - 1) * q).alias("place"), ((F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)).alias("part")) for k, (name, q) in enumerate(shares.items())])
    limits = limits.select(*by, "n", F.explode(wanted).alias("w")).select(*by, "n", "w.*")
    few = not by or limits.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    # values are counted before they meet their limits
    counted = there.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("c"))
    placed = counted.join(F.broadcast(limits) if few else limits, list(by)) if by else counted.crossJoin(F.broadcast(limits))
    key = [*by, "name"]
    below = placed.where("x < low").groupBy(*key).agg(F.sum("c").alias("below"))
    inside = placed.where("x >= low and x <= high").withColumn("upto", F.sum("c").over(Window.partitionBy(*key).orderBy("x"))).join(below, key, "left")
    inside = inside.withColumn("upto", F.col("upto") + F.coalesce("below", F.lit(0)))
    holds = lambda at: (F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)
    ends = inside.groupBy(*key).agg(*[F.max(F.when(holds(F.least(F.col("place") + up, F.col("n") - 1)), F.col("x"))).alias(c) for up, c in ((0, "a"), (1, "b"))], F.first("part").alias("part"))
    sure = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("a quantile lies outside its limits"))).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return ends.select(*by, "name", sure.alias("q")).groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col("q"))).alias(k) for k in shares])


def duplicates(rows: DataFrame, ident: str, label: str, samples: int = 20) -> DataFrame:
    """One row: ids, ids there more than once, whether their labels agree, and the first conflicting ids.

    Labels conflict if two that are there differ, or if some are there and some are missing.
    """
    groups = rows.groupBy(ident).agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("there"), F.count_distinct(label).alias("kinds"))
    conflict = (F.col("n") > 1) & ((F.col("kinds") > 1) | ((F.col("there") > 0) & (F.col("there") < F.col("n"))))
    counted = groups.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.count_if(F.col("n") > 1).alias("n_duplicate"),
        F.count_if((F.col("n") > 1) & ~conflict).alias("n_identical"), F.count_if(conflict).alias("n_conflicting"),
    )
    first = groups.where(conflict).select(ident).orderBy(ident).limit(samples).agg(F.array_join(F.array_sort(F.collect_list(ident)), ",").alias("samples"))
    return counted.crossJoin(first)


def level_coverage(rows: DataFrame, dims: list[str]) -> DataFrame:
    """dim, n_levels, levels: what each dimension shows."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("level")) for d in dims])).alias("x")).select("x.*").distinct()
    return long.groupBy("dim").agg(F.count("level").alias("n_levels"), F.array_join(F.array_sort(F.collect_list("level")), "|").alias("levels"))


def status_counts(rows: DataFrame, status: Column, known: list[str]) -> DataFrame:
    """status, n: a row for each known status, also where it never occurs."""
    spark = rows.sparkSession
    all_ = spark.createDataFrame([(s,) for s in known], "status string")
    return all_.join(rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def universe_diff(requested: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """key, finding: what one side has and the other lacks."""
    missing = requested.select(key).distinct().join(stored.select(key), key, "left_anti").withColumn("finding", F.lit("missing"))
    return missing.unionByName(stored.select(key).distinct().join(requested.select(key), key, "left_anti").withColumn("finding", F.lit("unexpected")))


def collapse_exact(rows: DataFrame, key: str, payload: Column) -> DataFrame:
    """key, n, exact: repeated keys, and whether their payloads are all the same so that one row may stand for them."""
    seen = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.sha2(payload.cast("string"), 256)).alias("kinds"))
    return seen.where("n > 1").select(key, "n", (F.col("kinds") == 1).alias("exact"))


def chain(rows: DataFrame, seq: str, payload: Column, *by: str) -> DataFrame:
    """``by``, seq, digest, parent: each entry with the digest of the one before it, and whether the numbers run on."""
    w = Window.partitionBy(*by).orderBy(seq)
    out = rows.select(*by, seq, F.sha2(payload, 256).alias("digest"))
    return out.select(*by, seq, "digest", F.lag("digest").over(w).alias("parent"), F.coalesce(F.col(seq) == F.lag(seq).over(w) + 1, F.col(seq) == 0).alias("contiguous"))


def chain_audit(chained: DataFrame, seq: str, *by: str) -> DataFrame:
    """``by``, n, gaps, tip: a summary of each chain."""
    return chained.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("contiguous")).alias("gaps"), F.max_by("digest", seq).alias("tip"))


def pointer_path(pointer: str) -> str:
    """The JSONPath of an RFC 6901 pointer."""
    steps = [s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/")[1:]]
    return "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps)


def pointed(document: Column, pointer: str) -> Column:
    """What a JSON document holds at a pointer, as text; null if nothing is there."""
    return F.get_json_object(document, pointer_path(pointer))


def claim(value: Column, kind: str, digits: int = 3, signed: bool = False) -> Column:
    """A number as a claim states it: rounded, as a percentage, or grouped, with a proper minus sign."""
    plus = "+" if signed else ""
    shown = {"round": F.format_string(f"%{plus}.{digits}f", value), "ratio": F.format_string(f"%{plus}.{digits}f%%", value * 100), "grouped": F.format_string(f"%{plus},d", value.cast("long"))}[kind]
    return F.replace(shown, F.lit("-"), F.lit("−"))


def set_digest(ids: Column) -> Column:
    """A digest of a set of ids that doesn't depend on their order: of as many ids as a lattice has, not of a fact table."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(ids)), "\n"), 256)


#: Ids of a leaf of a digest's tree, on average, and places of one node of an ordered digest.
LEAF_IDS, NODE_PLACES = 512, 1_024
#: Digits that a leaf's name has at most: enough for 2 to the 41 ids.
MOST_DIGITS = 8


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def tree_digest(rows: DataFrame, ident: Column, *by: str) -> DataFrame:
    """``by``, n, digest: of a set of ids of any size, repeated ones once; the same whatever the order and the partitions.

    Ids are dealt by the first hexadecimal digits of their own digests, as many as make leaves of some 512 ids; a leaf is the digest of its
    ids' digests in order, and a node that of its 16 parts at most. No task holds more than a few leaves. Nulls are left out.
    """
    ids = rows.select(*by, F.sha2(ident.cast("string"), 256).alias("d")).where("d is not null").distinct()
    sizes = ids.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    digits = sum(((F.col("n") > LEAF_IDS * 16**k).cast("int") for k in range(MOST_DIGITS)), F.lit(0))
    sizes = sizes.withColumn("digits", digits)
    most = sizes.agg(F.max("digits")).first()[0] or 0
    told = ids.join(F.broadcast(sizes), list(by)) if by else ids.crossJoin(F.broadcast(sizes))
    in_order = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x["d"])
    nodes = told.groupBy(*by, "n", F.expr("substring(d, 1, digits)").alias("p")).agg(_joined(in_order("d")).alias("d"))
    for k in range(most, 0, -1):
        # of groups with fewer digits the nodes wait until it is their turn
        nodes = nodes.groupBy(*by, "n", F.when(F.length("p") == k, F.substring("p", 1, k - 1)).otherwise(F.col("p")).alias("q")).agg(
            F.when(F.max(F.length("p")) == k, _joined(in_order("p", "d"))).otherwise(F.max("d")).alias("d")
        ).withColumnRenamed("q", "p")
    return nodes.select(*by, "n", F.col("d").alias("digest"))


def sequence_digest(rows: DataFrame, place: str, ident: Column) -> DataFrame:
    """n, digest: one row, of a sequence of any length whose items have their places, from 0 on without a gap.

    Nodes of 1,024 consecutive places, then of 1,024 nodes, until one is left. A gap or a place that is there twice is an error; an empty sequence gives no row.
    """
    nodes = rows.select(F.col(place).cast("long").alias("at"), F.sha2(F.coalesce(ident.cast("string"), F.lit("")), 256).alias("d"))
    facts = nodes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("at").alias("places"), F.min("at").alias("low"), F.max("at").alias("high")).first()
    n = facts["n"]
    if n and (facts["low"] != 0 or facts["high"] != n - 1 or facts["places"] != n):
        raise ValueError(f"places that aren't 0 to {n - 1}, once each")
    left = n
    while left > 1 or (left == 1 and n == 1 and left == n):
        nodes = nodes.groupBy(F.floor(F.col("at") / NODE_PLACES).alias("at")).agg(_joined(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"])).alias("d"))
        if left == 1:
            break
        left = -(-left // NODE_PLACES)
    return nodes.select(F.lit(n).cast("long").alias("n"), F.col("d").alias("digest"))


def map_digest(rows: DataFrame, key: Column, value: Column, *by: str) -> DataFrame:
    """``by``, n, digest: of a map, such as of ids to folds, as the set of its pairs."""
    return tree_digest(rows, F.concat_ws("\t", key.cast("string"), value.cast("string")), *by)


def payload(source: str, result: Column, schema_version: int = 1) -> Column:
    """A result as JSON, wrapped with its source and the version of this form."""
    return F.to_json(F.struct(F.lit(schema_version).alias("schema_version"), F.lit(source).alias("source"), result.alias("result")))
