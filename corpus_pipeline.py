"""From raw documents to packed token sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, language, lines, minhash, quality, tokens


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose language stays ambiguous; if nothing can be learned, only the former.

    Null and empty texts have no letter. Other columns may hold nulls or be missing but for doc_id, text and lang, and
    keep their names and values; rows that repeat share a fate; an empty table gives no rows.
    """
    model = language.fit(docs)
    judged = language.identify(docs, model, [F.struct(*[docs[c] for c in docs.columns]).alias("doc")])
    if model is None:
        judged = judged.where(F.coalesce(F.col("doc.text"), F.lit("")).rlike(r"\p{L}"))
    else:
        judged = judged.where((F.col("lang_pred") != language.UNDETERMINED) & ~F.col("ambiguous"))
    return judged.select("doc.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; lines that too many documents of a host share are taken out of the others.

    Null and empty texts fail; a null source is a host of its own; rows that repeat share a fate; an empty table gives no rows.
    """
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of whole lines that stand in an earlier document are taken out; documents with nothing left by that go.

    Null and empty texts stay as they are; rows equal in doc_id and text are one document; an empty table gives no rows.
    """
    return lines.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays.

    Null texts stay, each; empty texts are one class; of rows that repeat one stays; an empty table gives no rows.
    """
    return minhash.representatives(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents in sequences of 2,048; null texts are their end token; an empty table gives no rows."""
    return tokens.pack_by_byte_bpe(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: The classifier and the signatures cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the table ``documents``."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.keep(docs)
    return docs
