"""Line dedup over content-defined chunks: repeated runs of lines are removed wherever they stand.

A rolling hash over the hashes of neighbouring lines decides where a chunk ends, so an insertion moves
only the boundaries next to it and the same passage falls into the same chunks in every document. A
line of at least ``LONG_WORDS`` words is a chunk of its own. Chunks of several lines, and long lines,
are grouped by their bytes over the whole corpus; all but the first of each group are removed. So does
``dedup_lines``; ``clean``, for the pipeline, takes out runs of the same chunks with ``LONG_WORDS`` words, then,
by an exact check of the lines that no such run holds, what they leave of every run of whole lines with so many
words that stands earlier, and nothing shorter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A chunk ends after a line, on average, once in so many lines that may end one.
DIVISOR = 3
LONG_WORDS = 50
MIN_LINES = 2


def with_chunks(df: DataFrame) -> DataFrame:
    """``df`` (with ``text`` that isn't null) with ``lines`` and ``chunks``: an array of (start, n)."""
    df = df.withColumn("lines", F.split("text", "\n"))
    df = df.withColumn("h", F.transform("lines", lambda x: F.md5(x.cast("binary")))).withColumn("long", F.transform("lines", lambda x: F.size(common.words(x)) >= LONG_WORDS))
    rolled = F.transform("h", lambda x, i: F.conv(F.substring(F.md5(F.concat(F.coalesce(F.get("h", i - 1), F.lit("")), x).cast("binary")), 1, 7), 16, 10).cast("int") % DIVISOR == 0)
    df = df.withColumn("b", rolled)
    # after a line that may end a chunk, unless the one before it may too: chunks have two lines at least
    ends = lambda i: F.get("b", i) & ~F.coalesce(F.get("b", i - 1), F.lit(False))
    begins = lambda i: (i == 0) | F.coalesce(ends(i - 1), F.lit(False)) | F.get("long", i) | F.coalesce(F.get("long", i - 1), F.lit(False))
    df = df.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), begins))
    chunks = F.transform("starts", lambda s, k: F.struct(s.alias("start"), (F.coalesce(F.get("starts", k + 1), F.size("lines")) - s).alias("n")))
    return df.withColumn("chunks", chunks).drop("h", "long", "b", "starts")


def repeated(docs: DataFrame) -> DataFrame:
    """The chunks to remove: doc_id, digest, start. All but the first by (doc_id, start) of those with the same bytes."""
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", common.digest(F.col("text")).alias("digest"), "text")
    # outer, as else the optimizer puts a filter on the chunks, with all that makes them, under the scan
    chunks = with_chunks(rows).select("doc_id", "digest", "lines", F.explode_outer("chunks").alias("c"))
    chunks = chunks.select("doc_id", "digest", F.col("c.start").alias("start"), F.col("c.n").alias("n"), F.array_join(F.slice("lines", F.col("c.start") + 1, F.col("c.n")), "\n").alias("t"))
    word_count = F.size(common.words(F.col("t")))
    chunks = chunks.where((word_count >= LONG_WORDS) | ((F.col("n") >= MIN_LINES) & (word_count > 0)))
    key = [F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(1), "t").alias("k2"), F.octet_length("t").alias("k3")]
    # grouping by the text itself compares bytes; the keys, which stand for it from here on, have 160 bits
    groups = chunks.groupBy("t").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    groups = groups.where("copies > 1").select(*key, "first_doc", "unnamed")
    places = chunks.select(*key, "doc_id", "digest", "start")
    held = places.join(groups, ["k1", "k2", "k3"])
    at_first = F.when(F.col("unnamed"), F.col("doc_id").isNull()).otherwise(F.col("doc_id") == F.col("first_doc"))
    first = held.where(at_first).groupBy("k1", "k2", "k3").agg(F.min(F.struct("digest", "start")).alias("first"))
    return (
        held.join(first, ["k1", "k2", "k3"])
        .where(~(at_first & (F.struct("digest", "start") == F.col("first"))))
        .groupBy("doc_id", "digest", "start").agg(F.lit(True).alias("gone"))
        .select("doc_id", "digest", "start")
    )


def _joined(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as ``doc`` with ``text`` after removal and the counts of what went."""
    gone = repeated(docs).groupBy("doc_id", "digest").agg(F.collect_set("start").alias("gone"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col("doc_id").alias("d_id"), common.digest(F.col("text")).alias("d_digest"))
    # one path for all rows, as two would shuffle the texts twice; a text that loses nothing is not cut up
    both = rows.join(gone, F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_digest") == F.col("digest")), "left").select("doc", "gone", F.when(F.col("gone").isNotNull(), F.col("doc.text")).alias("text"))
    cut = with_chunks(both)
    left = F.filter("chunks", lambda c: ~F.array_contains("gone", c["start"]))
    n_lines = F.size(F.split(F.coalesce("doc.text", F.lit("")), "\n"))
    lost = F.coalesce(F.size("lines") - F.aggregate(left, F.lit(0), lambda a, c: a + c["n"]), F.lit(0))
    # through a generator, as a filter on the result would else be put below with all that makes it, many times over
    return cut.select("doc", F.inline_outer(F.array(F.struct(
        F.coalesce(F.array_join(F.flatten(F.transform(left, lambda c: F.slice("lines", c["start"] + 1, c["n"]))), "\n"), F.col("doc.text")).alias("text"),
        n_lines.cast("long").alias("n_lines"), F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0).cast("long").alias("n_removed_chunks"), lost.cast("long").alias("n_removed_lines"),
    ))))


def _lines(df: DataFrame) -> DataFrame:
    """The lines with words of each text that isn't null, as units: doc_id, digest, and of each its number ``first`` and ``last``, its words ``w``, its hash ``h``."""
    rows = df.where(F.col("text").isNotNull()).select("doc_id", common.digest(F.col("text")).alias("digest"), F.split("text", "\n").alias("x"))
    rows = rows.withColumn("w", F.transform("x", lambda x: F.size(common.words(x))))
    rows = rows.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i) > 0))
    return rows.select("doc_id", "digest", F.col("at").alias("first"), F.col("at").alias("last"), F.transform("at", lambda i: F.get("w", i)).alias("w"), F.transform("at", lambda i: F.md5(F.get("x", i).cast("binary"))).alias("h"))


def _chunks(df: DataFrame) -> DataFrame:
    """The chunks with words of each text that isn't null, as units; blank lines at their ends, and within them, don't count."""
    rows = with_chunks(df.where(F.col("text").isNotNull()).select("doc_id", common.digest(F.col("text")).alias("digest"), "text"))
    rows = rows.select("doc_id", "digest", "lines", "chunks", F.transform("lines", lambda x: F.size(common.words(x))).alias("w"))
    spoken = lambda c: F.filter(F.sequence(c["start"], c["start"] + c["n"] - 1), lambda i: F.get("w", i) > 0)
    rows = rows.select("doc_id", "digest", "lines", "w", F.filter(F.transform("chunks", spoken), lambda at: F.size(at) > 0).alias("units"))
    return rows.select(
        "doc_id", "digest", F.transform("units", lambda at: F.get(at, F.lit(0))).alias("first"), F.transform("units", lambda at: F.element_at(at, -1)).alias("last"),
        F.transform("units", lambda at: F.aggregate(at, F.lit(0), lambda n, i: n + F.get("w", i))).alias("w"),
        F.transform("units", lambda at: F.md5(F.array_join(F.transform(at, lambda i: F.md5(F.get("lines", i).cast("binary"))), "").cast("binary"))).alias("h"),
    )


def _windows(rows: DataFrame) -> DataFrame:
    """doc_id, digest, and of each window of the units its key ``k`` and first and last line (from 0).

    A window is the shortest run that has ``LONG_WORDS`` words and begins, or ends, at a unit. If two texts share a
    run of so many words, they share all windows inside it, and these cover it: those that begin at its units from
    its first unit on, those that end at them to its last.
    """
    rows = rows.withColumn("back", F.reverse("w"))
    zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
    step = lambda a, w: F.when(a["words"] >= LONG_WORDS, a).otherwise(F.struct((a["words"] + w).alias("words"), (a["n"] + 1).alias("n")))
    # from each place on, how many units have so many words; null where the text ends before
    ahead = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 1), lambda i: F.aggregate(F.slice(c, i + 1, LONG_WORDS), zero, step, lambda a: F.when(a["words"] >= LONG_WORDS, a["n"])))
    some = F.aggregate("w", F.lit(0), lambda a, w: a + w) >= LONG_WORDS
    # place and length in one number, as arrays of structs are made distinct by comparing all pairs
    begin = F.transform(ahead("w"), lambda n, i: i * 64 + n)
    end = F.transform(ahead("back"), lambda n, i: (F.size("w") - i - n) * 64 + n)
    rows = rows.withColumn("codes", F.when(some, F.filter(F.array_union(begin, end), lambda c: c.isNotNull())))
    place = lambda c: F.shiftright(c, 6)
    window = lambda c: F.struct(
        F.unhex(F.md5(F.array_join(F.slice("h", place(c) + 1, c % 64), "").cast("binary"))).alias("k"),
        F.get("first", place(c)).alias("start"), F.get("last", place(c) + c % 64 - 1).alias("end"),
    )
    whole = (F.size("h") == F.size("first")) & (F.size("h") == F.size("last"))
    rows = rows.select("doc_id", "digest", F.when(whole, F.transform("codes", window)).alias("windows"))
    return rows.select("doc_id", "digest", F.explode_outer("windows").alias("c")).select("doc_id", "digest", "c.k", "c.start", "c.end").where("k is not null")


def _again(places: DataFrame) -> DataFrame:
    """(doc_id, digest, spans): the windows that an earlier text (by doc_id, then digest) holds too, or the same text wholly before."""
    groups = places.groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "digest", "start", "end")).alias("first")).where("copies > 1").drop("copies")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    held = places.join(groups, "k").where(~same | (F.col("start") > F.col("first.end")))
    return held.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, spans): first and last lines of the runs of chunks with ``LONG_WORDS`` words that stand earlier."""
    return _again(_windows(_chunks(docs)))


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, digest, ``gone``: the numbers of the lines to remove.

    A line goes if it is in a run of whole lines with ``LONG_WORDS`` words and more that an earlier text (by doc_id,
    then digest) holds too, or the same text wholly before it. Each such line stays in the first of these places.
    Chunks find them first; windows of lines then settle what crosses the ends of those runs or fills no chunk. Those
    inside a run that went need no look: they stand in its first place too, so no other text has them from here.
    """
    by_chunks = common.written(repeated_runs(docs))
    places, runs = _windows(_lines(docs)), by_chunks.select(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("spans").alias("runs"))
    inside = F.exists("runs", lambda r: (r["start"] <= F.col("start")) & (F.col("end") <= r["end"]))
    rest = places.join(runs, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").where(~F.coalesce(inside, F.lit(False)))
    spans = by_chunks.unionByName(_again(rest.select(places.columns))).groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return spans.select("doc_id", "digest", F.array_distinct(F.flatten(F.transform("spans", lambda e: F.sequence(e["start"], e["end"])))).alias("gone"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages taken out of their texts; a document that has nothing left by that goes.

    All columns stay; ``n_chars``, where there is one, follows a text that changes. Null and empty texts stay as they are, and a
    row without a doc_id comes before all others; rows that repeat are one document and stay; an empty table gives no rows.
    """
    gone = passages(docs)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col("doc_id").alias("d_id"), common.digest(F.col("text")).alias("d_digest"))
    both = rows.join(gone, F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_digest") == F.col("digest")), "left")
    both = both.select("doc", "gone", F.when(F.col("gone").isNotNull(), F.split("doc.text", "\n")).alias("lines"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i))
    # through a generator, for the reason given in _joined
    rows = both.select("doc", F.inline_outer(F.array(F.struct(F.coalesce(F.array_join(left, "\n"), F.col("doc.text")).alias("text"), F.col("gone").isNotNull().alias("cut")))))
    rows = rows.where(~F.col("cut") | (common.without_breaks(F.col("text")) != ""))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars"))
    return rows.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the text that is left, n_lines, n_removed_chunks, n_removed_lines.

    A null text stays null with one line and nothing removed, and an empty one stays empty; texts of any length are
    cut whole; rows equal in doc_id and text count as one document and share its result; a row without a
    doc_id comes before all others; an empty table gives no rows.
    """
    return _joined(docs).select(F.col("doc.doc_id").alias("doc_id"), "text", "n_lines", "n_removed_chunks", "n_removed_lines")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated chunks; edge cases as ``dedup_lines`` states."""
    return dedup_lines(common.read(spark, sf_dir, "documents"))


OP2_SQL = rf"""
with d as (
  select distinct doc_id, text as t, string_split(text, chr(10)) as lines from documents where text is not null
), m as (
  select doc_id, t, lines, list_transform(lines, lambda x: md5(x)) as h,
         list_transform(lines, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= {LONG_WORDS}) as lo
  from d
), r as (
  select *, list_transform(range(1, len(h) + 1), lambda i: ('0x' || substr(md5(coalesce(h[nullif(i - 1, 0)], '') || h[i]), 1, 7))::bigint % {DIVISOR} = 0) as b from m
), s as (
  select doc_id, t, lines, list_filter(range(1, len(lines) + 1), lambda i: i = 1 or (b[i - 1] and not coalesce(b[nullif(i - 2, 0)], false)) or lo[i] or lo[i - 1]) as starts from r
), c as (
  select doc_id, t, starts[k]::bigint as start, array_to_string(lines[starts[k]:coalesce(starts[k + 1], len(lines) + 1) - 1], chr(10)) as x,
         (coalesce(starts[k + 1], len(lines) + 1) - starts[k])::bigint as n
  from (select *, unnest(range(1, len(starts) + 1)) as k from s)
), q as (
  select *, (w >= {LONG_WORDS} or (n >= {MIN_LINES} and w > 0)) as able
  from (select *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as w from c)
), g as (
  select doc_id, t, start, x, n, able and row_number() over (partition by able, x order by doc_id nulls first, start) > 1 as gone from q
), o as (
  select doc_id, t, coalesce(string_agg(x, chr(10) order by start) filter (not gone), '') as text, sum(n)::bigint as n_lines,
         count(*) filter (gone) as n_removed_chunks, coalesce(sum(n) filter (gone), 0)::bigint as n_removed_lines
  from g group by doc_id, t
)
select documents.doc_id, case when documents.text is null then null else o.text end as text, coalesce(n_lines, 1) as n_lines,
       coalesce(n_removed_chunks, 0) as n_removed_chunks, coalesce(n_removed_lines, 0) as n_removed_lines
from documents left join o on documents.doc_id is not distinct from o.doc_id and documents.text = o.t
"""
