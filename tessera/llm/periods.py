"""Runs of words that repeat with a period, by maximal pairs.

A suffix array over the words of a text and the lengths of the prefixes that neighbours share make a tree of intervals: the
places in one interval begin with the same words, as many as the interval says and no more for places of two of its
parts. The tree is walked from the leaves; each interval keeps its places by the word to their left. Two places of different parts
with different words to their left are a maximal pair: what they share can't be extended to either side. If what they share is at
least twice as long as they are apart, the text between the first place and the end of the second one's share is a run whose
period is the distance, as wide as it can be. Conversely a run of period q and its first q words left out make such a pair.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A run has at least so many words, and its period at least so many times.
MIN_WORDS, MIN_TIMES = 24, 3
_U = np.uint64


def _shared(min_words: int, min_times: int) -> int:
    """The fewest words that the two places of a run's pair share: at least (times - 1) of the distance, and with it the least length."""
    return -(-min_words * (min_times - 1) // min_times)


def _may_repeat(words: list[bytes], width: int) -> bool:
    """Whether some ``width`` words in a row may stand twice in a text; never wrong if it says no."""
    if len(words) <= width:
        return False
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(_U)
    done = 1
    while done < width:
        step = min(done, width - done)
        mixed = h[:-step] * _U(0x9E3779B97F4A7C15) + (h[step:] ^ (h[step:] >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        h, done = mixed ^ (mixed >> _U(32)), done + step
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a sequence in order, and how many items each shares with the one before it (0 for the first)."""
    n = len(ids)
    rank, levels, k = np.unique(ids, return_inverse=True)[1].astype(np.int64), [], 1
    order = np.argsort(rank, kind="stable")
    while True:
        levels.append(rank.astype(np.int32))
        if k >= n or rank[order[-1]] == n - 1:
            break
        second = np.zeros(n, dtype=np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        k *= 2
    i, j, shared = order[:-1].copy(), order[1:].copy(), np.zeros(n, dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        padded = np.append(levels[level], [-1])
        # two windows are equal if both lie inside the text and have one rank
        width = 1 << level
        fits = np.maximum(i, j) + width <= n
        same = fits & (padded[np.minimum(i, n)] == padded[np.minimum(j, n)])
        i, j, shared[1:] = i + width * same, j + width * same, shared[1:] + width * same
    return order, shared


class _Places:
    """The places of an interval, in order, and by the word to their left."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int) -> None:
        self.places, self.classes = [place], {left: [place]}


def _pairs(a: _Places, b: _Places, shared: int, left: list[int], reach: int, least: int) -> Iterator[tuple[int, int]]:
    """Maximal pairs of a place in each of two parts of an interval, ``least`` to ``reach`` words apart.

    What the places share has ``shared`` words. Occurrences of the same words within reach of each other, less than half their
    length, lie a period apart, and all but the leftmost have the same word to their left, the period's last.
    So only one class can stand to the right of a place with another class, and only the leftmost one can to its left.
    """
    if len(a.places) > len(b.places):
        a, b = b, a
    for place in a.places:
        own = left[place]
        k = bisect_left(b.places, place)
        if k < len(b.places) and b.places[k] - place <= reach and left[b.places[k]] != own:
            others = b.classes[left[b.places[k]]]
            for other in others[bisect_left(others, place + least) : bisect_right(others, place + reach)]:
                yield place, other
        if k > 0 and place - b.places[k - 1] <= reach:
            other = b.places[bisect_left(b.places, place - reach, 0, k)]
            if place - other >= least and left[other] != own:
                yield other, place


def _joined(a: _Places, b: _Places) -> _Places:
    """The places of both; those of the part with fewer places move."""
    if len(a.places) > len(b.places):
        a, b = b, a
    for place in a.places:
        insort(b.places, place)
    for left, places in a.classes.items():
        known = b.classes.setdefault(left, [])
        for place in places:
            insort(known, place)
    return b


def runs(words: list[bytes], min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period.

    A run has its smallest period at least ``min_times`` (two or more) times, ``min_words`` words or more, and no neighbouring word
    extends it.
    """
    width = _shared(min_words, min_times)
    if not _may_repeat(words, width):
        return []
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for w in words]
    order, shared = (x.tolist() for x in suffix_array(np.array(ids)))
    left = [-1, *ids]
    found: dict[tuple[int, int], int] = {}

    def meet(a: _Places, b: _Places, common_: int) -> _Places:
        for first, second in _pairs(a, b, common_, left, common_ // (min_times - 1), max(1, min_words - common_)):
            # a stretch has each multiple of its period that fits, and the smallest is its own
            key, apart = (first, second + common_), second - first
            found[key] = min(apart, found.get(key, apart))
        return _joined(a, b)

    open_: list[tuple[int, _Places]] = []
    for k, place in enumerate(order):
        following = shared[k + 1] if k + 1 < len(order) else 0
        if following < width and not open_:
            continue
        part = _Places(place, left[place])
        while open_ and open_[-1][0] > following:
            depth, before = open_.pop()
            part = meet(before, part, depth)
        if following >= width:
            if open_ and open_[-1][0] == following:
                part = meet(open_.pop()[1], part, following)
            open_.append((following, part))
    return sorted(((start, end - start, period) for (start, end), period in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(words, kept) if k]


_RUNS = "doc_id string, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, ``runs`` (start, length, period in words) and the text ``collapsed`` to one period each.

    Words end at white space and are joined by single spaces. A null text counts as empty: no words, no runs, an empty text.
    Texts of any length are read whole; rows that repeat give rows that repeat; an empty table gives none; other columns are not looked at.
    """
    rows = common.bound_batches(docs).select(common.text_id(docs), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            counts, all_runs, texts = [], [], []
            for text in batch.column("text").to_pylist():
                words = text.split()
                here = runs(words, min_words, min_times)
                counts.append(len(words))
                all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in here])
                texts.append(b" ".join(collapsed(words, here)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(all_runs, kind), pa.array(texts, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    return common.typed_id(rows.mapInArrow(find, _RUNS).withColumn("collapsed", F.col("collapsed").cast("string")), docs)


def strongest(found: Column) -> Column:
    """The run with the greatest exact quotient of length and period; of equal ones the first, then the one with the smaller period."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(found, F.get(found, F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a))


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where one text in ten repeats itself from some word on, by the checksum of its id."""
    words = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, common.words(F.col("text"))))
    g, n = F.expr("h div 10"), F.size("w")
    begin = (g % n).cast("int")
    told = words.withColumn("a", F.when(n > 0, begin)).withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + g % 8)).cast("int")))
    repeated = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < F.col("a"), F.get("w", i)).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return told.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, some planted, as digests, and the strongest; edge cases as ``periodic_runs`` states, and a null doc_id plants nothing."""
    found = periodic_runs(planted(common.read(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
