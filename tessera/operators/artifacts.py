"""Claims in documents, traced strictly to the artifacts that they cite: manifest, checksum, pointer, rendering, place.

All are tables: ``files`` (path, content), ``manifest`` (path, sha256, kind, renderer), ``claims`` (id, document, artifact, pointer, transform, digits,
plus, minus, denominator, rendered, anchor). A finding is a row; ``strict`` makes the first one an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK = "ok"
#: What a document shows: an image by its target.
_IMAGE = r"!\[[^\]]*\]\(([^)#\s]+)"


def at_pointer(document: Column, pointer: Column) -> Column:
    """What a variant holds at an RFC 6901 pointer, as a variant; null if nothing is there.

    A step is a key of an object, or else, if it is a number, a place in an array. The empty pointer is the whole document; one
    that doesn't begin with a slash points nowhere.
    """
    steps = F.transform(F.slice(F.split(pointer, "/"), 2, 1_000_000), lambda s: F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    quote = lambda s: F.when(F.contains(s, F.lit("'")), F.lit('"')).otherwise(F.lit("'"))
    by_key = lambda v, s: F.try_variant_get(v, F.concat(F.lit("$["), quote(s), s, quote(s), F.lit("]")), "variant")
    by_place = lambda v, s: F.when(s.rlike("^[0-9]{1,9}$"), F.try_variant_get(v, F.concat(F.lit("$["), F.when(s.rlike("^[0-9]{1,9}$"), s).otherwise("0"), F.lit("]")), "variant"))
    found = F.aggregate(steps, document, lambda v, s: F.coalesce(by_key(v, s), by_place(v, s)))
    return F.when(pointer == "", document).when(F.startswith(pointer, F.lit("/")), found)


def rendered(value: Column, over: Column) -> Column:
    """The value as its claim's transform shows it; null if it can't be shown. ``over`` is the denominator of a ratio."""
    x = F.try_variant_get(value, "$", "double")
    number = F.when(F.col("transform") == "ratio", F.try_divide(x, F.try_variant_get(over, "$", "double"))).otherwise(x)
    shown = F.expr("concat('%', if(plus, '+', ''), '.', cast(digits as string), 'f')")
    grouped = F.format_string("%,d", number.cast("long"))
    text = F.when(F.col("transform") == "identity", F.try_variant_get(value, "$", "string")).when(F.col("transform") == "grouped", grouped).otherwise(F.format_string("%s", F.call_function("format_string", shown, number)))
    return F.when((F.col("transform") == "identity") | number.isNotNull(), F.when(F.col("minus"), F.replace(text, F.lit("-"), F.lit("−"))).otherwise(text))


def checked_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, status: whether each listed file is there and has the digest that the manifest states."""
    there = files.select("path", F.sha2("content", 256).alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing artifact").when(F.col("actual") != F.col("sha256"), "checksum differs").otherwise(OK)
    return manifest.join(there, "path", "left").select("path", status.alias("status"))


def audit_claims(claims: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """id, expected, status: each claim's artifact must be listed and whole, its pointer lead to a value that renders as the claim says, and its document hold the anchor that holds it.

    The first thing that is wrong is the status; expected is null where nothing could be rendered.
    """
    listed = checked_manifest(manifest, files).select(F.col("path").alias("artifact"), F.col("status").alias("of_artifact"))
    content = files.select(F.col("path").alias("artifact"), F.col("content").alias("source"))
    text = files.select(F.col("path").alias("document"), F.col("content").alias("text"))
    rows = claims.join(listed, "artifact", "left").join(content, "artifact", "left").join(text, "document", "left")
    rows = rows.withColumn("doc", F.try_parse_json("source"))
    rows = rows.withColumn("value", at_pointer(F.col("doc"), F.col("pointer"))).withColumn("over", at_pointer(F.col("doc"), F.coalesce("denominator", F.lit("none"))))
    rows = rows.withColumn("expected", rendered(F.col("value"), F.col("over")))
    no_number = (F.col("transform") != "identity") & F.try_variant_get("value", "$", "double").isNull()
    over = F.try_variant_get("over", "$", "double")
    status = (
        F.when(F.col("of_artifact").isNull(), "unlisted artifact").when(F.col("of_artifact") != OK, F.col("of_artifact"))
        .when(F.col("doc").isNull(), "not a JSON document").when(F.col("value").isNull(), "pointer not found").when(no_number, "not a number")
        .when((F.col("transform") == "ratio") & (over.isNull() | (over == 0)), "invalid denominator").when(F.col("expected").isNull() | (F.col("expected") != F.col("rendered")), "renders otherwise")
        .when(F.col("text").isNull(), "missing document").when(~F.contains("text", "anchor") | ~F.contains("anchor", "rendered"), "not in its document").otherwise(OK)
    )
    return rows.select("id", "expected", status.alias("status"))


def audit_figures(documents: DataFrame, manifest: DataFrame, files: DataFrame, claims: DataFrame, folder: str) -> DataFrame:
    """path, status: each figure in ``folder`` that a document shows must be listed, of a stated kind and whole; one that shows a result needs a renderer that is there, and a claim."""
    shown = documents.select(F.explode(F.regexp_extract_all("content", F.lit(_IMAGE), 1)).alias("path")).where(F.startswith("path", F.lit(folder + "/"))).distinct()
    whole = checked_manifest(manifest, files).withColumnRenamed("status", "of_artifact")
    rows = shown.join(manifest.select("path", "kind", "renderer", F.lit(True).alias("listed")), "path", "left").join(whole, "path", "left")
    rows = rows.join(files.select(F.col("path").alias("renderer"), F.lit(True).alias("rendered")), "renderer", "left").join(claims.select(F.col("artifact").alias("path")).distinct().withColumn("claimed", F.lit(True)), "path", "left")
    status = (
        F.when(F.col("listed").isNull(), "unlisted figure").when(F.col("kind").isNull(), "figure of no kind").when(F.col("of_artifact") != OK, F.col("of_artifact")).when(F.col("kind") == "illustration", OK)
        .when(F.col("renderer").isNull(), "no renderer").when(F.col("rendered").isNull(), "missing renderer").when(F.col("claimed").isNull(), "no claim").otherwise(OK)
    )
    return rows.select("path", status.alias("status"))


def forbidden(documents: DataFrame, literals: list[str]) -> DataFrame:
    """path, literal: each document that holds what none may hold."""
    return documents.select("path", F.explode(F.filter(F.array(*map(F.lit, literals)), lambda x: F.contains(F.col("content"), x))).alias("literal"))


def strict(found: DataFrame, key: str) -> DataFrame:
    """``found``, but a status that isn't ``OK`` is an error that says what is wrong with what."""
    told = F.assert_true(F.col("status") == OK, F.concat(F.col(key), F.lit(": "), F.col("status")))
    return found.where(told.isNull())
