"""Quality rules: facts of each text, and lines that too many documents of one host share.

Lines are normalised (lower case, one space between words) and hashed; per host, the distinct texts
that hold a line are counted. Lines above the host's limit are removed, and a document that loses most
of its words that way is rejected, as are documents that fail the base rules. A host is a ``source``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """A line is removed in a host where more than ``host_texts`` texts hold it, and more than ``host_percent`` of the host's or ``host_roots`` times their root.

    So a few texts are a floor in hosts of any size; above it counts a share, or, in large hosts, a number that grows more slowly.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    host_texts: int = 3
    host_percent: int = 10
    #: None leaves the share alone.
    host_roots: int | None = 5
    #: Whether each document counts, or, so that a document's own copies make none of its lines common, each different text.
    count_copies: bool = False
    #: A document keeps its place if at least this share of its words is left.
    min_left_percent: int = 50


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(common.BREAK_CHARS)) != "")


def _covered(starts: Column, width: int) -> Column:
    """How many places the windows at the sorted starts cover."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, p: F.struct((acc["n"] + p + width - F.greatest(acc["end"], p)).alias("n"), (p + width).alias("end"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def facts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, host, the digest of the text, and the counts that the base rules use.

    A null text counts as empty. Windows of eight words are compared by 64-bit hashes within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    staged = docs.select("doc_id", _host().alias("host"), common.digest(F.col("text")).alias("digest"), text.alias("text"), common.words(text).alias("w"))
    staged = staged.select(
        "doc_id", "host", "digest",
        F.size("w").cast("long").alias("n_words"),
        F.length(common.without_breaks(F.col("text"))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _lines(F.col("text")).alias("lines"),
        F.when(F.size("w") >= WINDOW, F.transform("w", lambda w: F.xxhash64(w))).alias("v"),
    )
    # each word is hashed once, then each window's eight hashes
    staged = staged.withColumn("h", F.transform(F.sequence(F.lit(0), F.size("v") - WINDOW), lambda i: F.xxhash64(*[F.get("v", i + k) for k in range(WINDOW)])))
    ordered = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))))
    staged = staged.withColumn("o", F.when(F.size(F.array_distinct("h")) < F.size("h"), ordered))
    again = F.filter("o", lambda e, k: (e["x"] == F.get("o", k - 1)["x"]) | (e["x"] == F.get("o", k + 1)["x"]))
    return staged.select(
        "doc_id", "host", "digest", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_covered(F.sort_array(F.transform(again, lambda e: e["i"])), WINDOW), F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def _host() -> Column:
    return F.coalesce(F.col("source"), F.lit("\u0000"))


def common_lines(docs: DataFrame, rules: Rules) -> DataFrame:
    """The lines to remove: doc_id, host, digest, line (its number from 0), words. One row per line of a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(
        "doc_id", _host().alias("host"), common.digest(F.col("text")).alias("digest"), F.posexplode(F.split(text, "\n")).alias("line", "raw")
    ).select("doc_id", "host", "digest", "line", common.words(F.col("raw")).alias("w"))
    lines = lines.where(F.size("w") > 0).select(
        "doc_id", "host", "digest", "line", F.xxhash64(F.lower(F.array_join("w", " "))).alias("h"), F.size("w").cast("long").alias("words")
    )
    counted = ["digest", "doc_id"] if rules.count_copies else ["digest"]
    hosts = docs.select(_host().alias("host"), common.digest(F.col("text")).alias("digest"), "doc_id").select("host", *counted).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    held = lines.select("host", "h", *counted).distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rules.host_texts)
    above = F.col("n") * 100 > F.col("texts") * rules.host_percent
    if rules.host_roots is not None:
        above |= F.col("n") * F.col("n") > F.col("texts") * rules.host_roots**2
    over = held.join(hosts, "host").where(above).select("host", "h")
    return lines.join(over, ["host", "h"]).groupBy("doc_id", "host", "digest", "line").agg(F.first("words").alias("words"))


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs``: its key (doc_id, host, digest), its facts, the lines to remove, the verdict.

    Null and empty texts have no words and fail; exact copies count once in a line's frequency unless
    ``rules.count_copies``, so copies alone make no line common; rows that repeat get a verdict each; an empty table gives none.
    """
    removed = common_lines(docs, rules).groupBy("doc_id", "host", "digest").agg(F.collect_set("line").alias("removed"), F.sum("words").alias("words_removed"))
    # written, as a filter on the verdict would else be put under the scan with all that makes the facts, many times over
    found = common.keep(facts(docs)).alias("f")
    removed = removed.select(F.col("doc_id").alias("r_id"), F.col("host").alias("r_host"), F.col("digest").alias("r_digest"), "removed", "words_removed")
    joined = found.join(removed, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("host") == F.col("r_host")) & (F.col("digest") == F.col("r_digest")), "left")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.coalesce(F.col("words_removed"), F.lit(0))
    return joined.select(
        "doc_id", "host", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed",
        F.coalesce(F.col("words_removed"), F.lit(0).cast("long")).alias("n_common_words"),
        failed.alias("base_failed"), (~failed & (100 * left >= rules.min_left_percent * F.col("n_words"))).alias("kept"),
    )


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` without the rejected ones, common lines taken out of the texts of the others.

    All columns stay; ``n_chars``, where there is one, follows a text that changes. Null and empty texts go, as they have no
    words; rows that repeat stay as often as they were; an empty table gives no rows.
    """
    verdicts = judge(docs, rules).where("kept").groupBy("doc_id", "host", "digest").agg(F.first("removed").alias("removed"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col("doc_id").alias("d_id"), _host().alias("d_host"), common.digest(F.col("text")).alias("d_digest"))
    both = rows.join(verdicts, F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_host") == F.col("host")) & (F.col("d_digest") == F.col("digest")))
    text = F.when(
        F.col("removed").isNotNull(), F.array_join(F.filter(F.split(F.col("doc.text"), "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    ).otherwise(F.col("doc.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("removed").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return both.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's facts and verdict by ``Rules()``; edge cases as ``judge`` states."""
    return judge(common.read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words"
    )


OP8_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(source, chr(0)) as host,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
         text is null as absent
  from documents
), win as (
  select r, i, array_to_string(w[i:i + 7], ' ') as x from (select r, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)
), rep as (
  select r, i from (select r, i, count(*) over (partition by r, x) as n from win) where n > 1
), cov as (
  select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from rep) group by r
), line as (
  select r, host, t, absent, lower(array_to_string(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), ' ')) as l,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) as n
  from (select r, host, t, absent, unnest(lines) as l from d)
), hosts as (
  select host, count(*) as texts from (select distinct host, t, absent from d) group by host
), held as (
  select host, l from (select host, l, count(*) as n from (select distinct host, l, t, absent from line) group by host, l) join hosts using (host)
  where n > 3 and (n * 100 > texts * 10 or n * n > texts * 25)
), gone as (
  select r, sum(n) as n from line join held using (host, l) group by r
), f as (
  select doc_id, len(w)::bigint as n_words, coalesce(len(array_to_string(w, '')), 0)::bigint as word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(cov.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as n_common_words
  from d left join cov using (r) left join gone using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * (n_words - n_common_words) >= 50 * n_words as kept,
       n_common_words
from f
"""
