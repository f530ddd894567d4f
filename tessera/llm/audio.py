"""Chroma audio fingerprints, and the alignment of recordings by them.

A recording becomes frames of twelve pitch classes; sixteen filters, sums of rectangles of an integral
image over those frames, give two bits each, and so every frame one packed 32-bit integer. Recordings
with the same integers are one class. Keys of some bits of several frames are looked up for each class that
asks; their places make a histogram of offsets, and every offset in it is verified by the bit errors of all
frames that overlap there.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

RATE = 4_000
FRAME, HOP = 960, 240
#: Pitch classes are taken from this range of Hz.
LOWEST, HIGHEST = 120.0, 1_900.0
FILTERS, WIDEST = 16, 12
#: A filter's two sums are told apart in three steps at these logarithms of their ratio.
STEPS = (-0.35, 0.0, 0.35)
GRAY = (0, 1, 3, 2)
#: An alignment needs so many frames that overlap, and no more wrong bits than this share.
MIN_OVERLAP, MAX_BIT_ERRORS = 24, 0.15
#: A key takes so many bits of each of the frames at these distances; each table takes other bits.
KEY_FRAMES, KEY_BITS, TABLES = (0, 4, 8, 12), 8, 6
#: So many classes that ask, and of all, are compared at once; so many frames are indexed, and so many places are looked at.
ASKED_BLOCK, BLOCK, INDEXED, PLACES = 4_096, 1_024, 1 << 19, 1 << 22
#: The classes that ask are broadcast up to this size; beyond it the product of the blocks is made by tasks.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Filter:
    """Rectangles to add and to take away: (first frame, width, first pitch class, height)."""

    plus: tuple[tuple[int, int, int, int], ...]
    minus: tuple[tuple[int, int, int, int], ...]


def filter_bank() -> list[Filter]:
    """Four shapes (low against high, before against after, a checkerboard, middle against sides) at four places and sizes."""
    out = []
    for k in range(FILTERS):
        shape, size = k % 4, k // 4
        w, h = (4, 6, 8, WIDEST)[size], (4, 6, 8, 6)[(size + shape) % 4]
        y, w2, h2 = (5 * k) % (13 - h), w // 2, h // 2
        if shape == 0:
            out.append(Filter(((0, w, y, h2),), ((0, w, y + h2, h - h2),)))
        elif shape == 1:
            out.append(Filter(((0, w2, y, h),), ((w2, w - w2, y, h),)))
        elif shape == 2:
            out.append(Filter(((0, w2, y, h2), (w2, w - w2, y + h2, h - h2)), ((0, w2, y + h2, h - h2), (w2, w - w2, y, h2))))
        else:
            out.append(Filter(((w // 4, w2, y, h),), ((0, w // 4, y, h), (w // 4 + w2, w - w // 4 - w2, y, h))))
    return out


_BANK = filter_bank()


def _pitch_map() -> np.ndarray:
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    use = (hz >= LOWEST) & (hz <= HIGHEST)
    out = np.zeros((len(hz), 12), dtype=np.float32)
    out[np.flatnonzero(use), np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12] = 1
    return out


_PITCHES = _pitch_map()
_WINDOW = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames of twelve pitch classes, each frame scaled to one; a silent frame is even. Too short a recording has none."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP] * _WINDOW
    power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2 @ _PITCHES
    total = power.sum(axis=1, keepdims=True)
    return np.where(total > 1e-6, power / np.maximum(total, 1e-6), 1.0 / 12).astype(np.float64)


def packed(frames: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each place where the widest filter fits."""
    n = len(frames) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    area = lambda t, w, y, h: image[t + w : t + w + n, y + h] - image[t : t + n, y + h] - image[t + w : t + w + n, y] + image[t : t + n, y]
    out = np.zeros(n, dtype=np.uint32)
    for f in _BANK:
        ratio = np.log((1e-2 + sum(area(*r) for r in f.plus)) / (1e-2 + sum(area(*r) for r in f.minus)))
        out = (out << np.uint32(2)) | np.array(GRAY, dtype=np.uint32)[np.searchsorted(STEPS, ratio)]
    return out.view(np.int32)


def decode_wav(raw: bytes | None) -> np.ndarray:
    """The samples of a mono or mixed-down 16-bit WAV at ``RATE``; none if there is nothing that can be read so."""
    try:
        with wave.open(io.BytesIO(raw or b"")) as w:
            if w.getsampwidth() != 2 or w.getframerate() != RATE:
                return np.zeros(0)
            return np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32768
    except (wave.Error, EOFError):
        return np.zeros(0)


def fingerprints(df: DataFrame, rec_id: Column, audio: Column, decode: Callable = decode_wav) -> DataFrame:
    """rec_id and ``fp``, the packed integers, of each row. ``decode`` makes samples of a value and its id."""
    rows = common.bound_batches(df).select(rec_id.alias("rec_id"), audio.alias("audio"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [packed(chroma(decode(a))) for a in batch.column("audio").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in fps])])
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *fps]))
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["rec_id", "fp"])

    return rows.mapInArrow(read, rows.select("rec_id").schema.add("fp", T.ArrayType(T.IntegerType())))


def _slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to ``limit`` at most, or that hold a single larger one."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, to
        at = to


def _each(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _key_masks() -> np.ndarray:
    """Which bits of each of its frames a table's keys take: (table, frame)."""
    r = np.random.default_rng(1)
    return np.array([[sum(1 << int(b) for b in r.permutation(32)[:KEY_BITS]) for _ in KEY_FRAMES] for _ in range(TABLES)], dtype=np.uint32)


_MASKS = _key_masks()


def keys(fp: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of each table (table, place), and the recording and the frame of each place where a key fits."""
    n = max(0, len(fp) - KEY_FRAMES[-1])
    at = _each(sizes)
    fits = np.flatnonzero(at[:n] + KEY_FRAMES[-1] < np.repeat(sizes, sizes)[:n])
    out = np.zeros((TABLES, len(fits)), dtype=np.uint64)
    for k, distance in enumerate(KEY_FRAMES):
        out = (out ^ (fp[fits + distance] & _MASKS[:, k : k + 1])) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out, np.repeat(np.arange(len(sizes)), sizes)[fits], at[fits]


@dataclass(frozen=True)
class Index:
    """The sorted keys of each table with their recordings and frames, of one slice of the recordings that ask."""

    keys: list[np.ndarray]
    owners: list[np.ndarray]
    places: list[np.ndarray]


def index(a: np.ndarray, a_sizes: np.ndarray) -> list[Index]:
    """An index for each ``INDEXED`` frames of recordings, given as their integers, one after the other, and their sizes."""
    out, starts = [], np.cumsum(a_sizes) - a_sizes
    for q0, q1 in _slices(a_sizes, INDEXED):
        of, owner, place = keys(a.view(np.uint32)[starts[q0] : starts[q0] + a_sizes[q0:q1].sum()], a_sizes[q0:q1])
        orders = [np.argsort(k) for k in of]
        out.append(Index([k[o] for k, o in zip(of, orders)], [(owner[o] + q0).astype(np.int32) for o in orders], [place[o].astype(np.int32) for o in orders]))
    return out


def _hits(known: Index, of: np.ndarray, owner: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Which that asks, which of the others, offset: for each key of the others that is in the index, in slices."""
    for t in range(TABLES):
        order = np.argsort(of[t])
        first = np.searchsorted(known.keys[t], of[t][order], "left")
        n = np.searchsorted(known.keys[t], of[t][order], "right") - first
        there = np.flatnonzero(n)
        first, n, at = first[there], n[there], order[there]
        for f0, f1 in _slices(n, PLACES):
            k = np.repeat(first[f0:f1], n[f0:f1]) + _each(n[f0:f1])
            yield known.owners[t][k], np.repeat(owner[at[f0:f1]], n[f0:f1]), np.repeat(place[at[f0:f1]], n[f0:f1]) - known.places[t][k]


def compare(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, indexes: list[Index] | None = None) -> tuple[np.ndarray, ...]:
    """Which of the first recordings, which of the second, offset, error, votes: all alignments with a key in common.

    Recordings are given as their integers, one after the other, and their sizes. Votes are the keys that fall on the offset.
    """
    indexes = index(a, a_sizes) if indexes is None else indexes
    a, b = a.view(np.uint32), b.view(np.uint32)
    a_starts, b_starts = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    found, (of, owner, place) = [], keys(b, b_sizes)
    for known in indexes:
        # the histogram of offsets: each with its votes once
        parts: list[tuple[np.ndarray, ...]] = []
        for q, r, offset in _hits(known, of, owner, place):
            parts.append(_counted(q, r, offset, np.ones(len(q), np.int64)))
        if not parts:
            continue
        q, r, offset, votes = _counted(*(np.concatenate(v) for v in zip(*parts)))
        start, end = np.maximum(0, -offset), np.minimum(a_sizes[q], b_sizes[r] - offset)
        long = end - start >= MIN_OVERLAP
        q, r, offset, votes, start, end = (v[long] for v in (q, r, offset, votes, start, end))
        for c0, c1 in _slices(end - start, PLACES):
            size = (end - start)[c0:c1]
            left, right = a_starts[q[c0:c1]] + start[c0:c1], b_starts[r[c0:c1]] + start[c0:c1] + offset[c0:c1]
            step = _each(size)
            wrong = np.add.reduceat(np.bitwise_count(a[np.repeat(left, size) + step] ^ b[np.repeat(right, size) + step]), np.cumsum(size) - size, dtype=np.int64)
            error = wrong / (32 * size)
            good = error <= MAX_BIT_ERRORS
            found.append((q[c0:c1][good], r[c0:c1][good], offset[c0:c1][good], error[good], votes[c0:c1][good]))
    if not found:
        return (*[np.zeros(0, np.int64)] * 3, np.zeros(0), np.zeros(0, np.int64))
    return tuple(np.concatenate(v) for v in zip(*found))


def _counted(q: np.ndarray, r: np.ndarray, offset: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each different (q, r, offset) once, its votes summed."""
    order = np.lexsort((offset, r, q))
    q, r, offset, votes = q[order], r[order], offset[order], votes[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1]) | (offset[1:] != offset[:-1])
    at = np.flatnonzero(new)
    return q[at], r[at], offset[at], np.add.reduceat(votes, at) if len(at) else votes


def _alignments(kinds: DataFrame) -> DataFrame:
    """q, r, r_class, offset, error, votes: the alignments of the classes that ask with all others, by blocks of both."""
    asking = common.keep(kinds.where("asked").select("print", "fp"))
    n_asking, n_all = asking.count(), kinds.count()
    dealt = lambda df, n, name, *columns: df.groupBy(F.pmod(F.xxhash64("print"), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list(F.struct(*columns)).alias(name))
    asked, among = dealt(asking, n_asking // ASKED_BLOCK + 1, "a", "print", "fp"), dealt(kinds, n_all // BLOCK + 1, "b", "print", "class_id", "fp").drop("b_block")
    small = common.fits(asking, BROADCAST_BYTES, F.size("fp") * 4 + 64)
    # ordered, so that a task indexes each block of those that ask once
    pairs = common.bound_batches(among.crossJoin(F.broadcast(asked) if small else asked)).sortWithinPartitions("a_block")

    def flat(column: pa.ListArray, k: int) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
        rows = column[k].values
        fp = rows.field("fp")
        return rows, fp.flatten().to_numpy(zero_copy_only=False), fp.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                (a_rows, *a), (b_rows, *b) = flat(batch.column("a"), k), flat(batch.column("b"), k)
                if block != (block := batch.column("a_block")[k].as_py()) or not known:
                    known = index(*a)
                q, r, offset, error, votes = compare(*a, *b, known)
                q, r = pa.array(q), pa.array(r)
                yield pa.RecordBatch.from_arrays(
                    [a_rows.field("print").take(q), b_rows.field("print").take(r), b_rows.field("class_id").take(r), pa.array(offset, pa.int32()), pa.array(error), pa.array(votes)], names=["q", "r", "r_class", "offset", "error", "votes"]
                )

    schema = T.StructType([T.StructField("q", T.StringType()), T.StructField("r", T.StringType()), T.StructField("r_class", kinds.schema["class_id"].dataType), T.StructField("offset", T.IntegerType()), T.StructField("error", T.DoubleType()), T.StructField("votes", T.LongType())])
    return pairs.mapInArrow(read, schema).where("q <> r")


def align(prints: DataFrame, asked: Column) -> DataFrame:
    """One row per row of ``prints`` (rec_id, fp): rec_id, class_id, n_frames, n_matches, best_class, best_offset, best_error, best_votes.

    A class holds the recordings with the same integers, its id the least rec_id; a recording too short for
    any is in a class of its own row. Classes with a row for which ``asked`` holds are compared with all
    others; for the rest the last five are null. Copies are not expanded: a match is between classes. Null
    recordings have no integers; rows that repeat get equal results; an empty table gives no rows.
    """
    rows = common.keep(prints.select("rec_id", "fp", F.coalesce(asked, F.lit(False)).alias("asked"), F.when(F.size("fp") > 0, F.md5(F.array_join("fp", ",").cast("binary"))).alias("print")))
    kinds = common.keep(rows.where("print is not null").groupBy("print").agg(F.min("rec_id").alias("class_id"), F.max("asked").alias("asked"), F.first("fp").alias("fp")))
    matches = _alignments(kinds)
    told = matches.groupBy("q").agg(F.countDistinct("r").alias("n"), F.min(F.struct(F.round("error", 6).alias("error"), F.col("r_class").alias("r_class"), "offset", "votes")).alias("best"))
    out = rows.join(kinds.select("print", "class_id", F.col("asked").alias("any")), "print", "left").join(told.withColumnRenamed("q", "print"), "print", "left")
    return out.select(
        "rec_id", F.when(F.col("print").isNull(), F.col("rec_id")).otherwise(F.col("class_id")).alias("class_id"), F.size("fp").alias("n_frames"),
        F.when(F.coalesce("any", "asked"), F.coalesce("n", F.lit(0).cast("long"))).alias("n_matches"),
        F.col("best.r_class").alias("best_class"), F.col("best.offset").alias("best_offset"), F.col("best.error").alias("best_error"), F.col("best.votes").alias("best_votes"),
    )


NOTE = 480
_SEMITONES = 24
_TUNE = np.sin(2 * np.pi * 261.63 * 2 ** (np.arange(_SEMITONES)[:, None] / 12) * np.arange(NOTE) / RATE) * np.hanning(NOTE) ** 0.25


def melody(vector: list[float] | None, lead: int = 0, noise: float = 0.0, seed: int = 0) -> np.ndarray:
    """Samples of a recording derived from a vector: a note for each number, higher for larger ones, after ``lead`` other notes."""
    v = np.nan_to_num(np.array([x for x in vector or [] if x is not None], dtype=np.float64))
    if not len(v):
        return np.zeros(0)
    notes = np.clip((v - v.min()) / max(np.ptp(v), 1e-12) * _SEMITONES, 0, _SEMITONES - 1).astype(int)
    samples = _TUNE[np.concatenate([(np.arange(lead) * 7 + lead) % _SEMITONES, notes])].ravel()
    return samples + noise * np.random.default_rng(seed).standard_normal(len(samples)) if noise else samples


def _audio(vector: Column, noise: float) -> Column:
    return F.struct(vector.alias("vector"), F.coalesce(F.pmod("vec_id", F.lit(5)), F.lit(0)).cast("int").alias("lead"), F.lit(noise).alias("noise"), F.coalesce(F.abs("vec_id"), F.lit(0)).alias("seed"))


def own_recordings(vectors: DataFrame) -> DataFrame:
    """rec_id and ``audio`` (vector, lead, noise, seed) for each row of ``embeddings``, of its own vector, as no table holds sound."""
    return vectors.select(F.col("vec_id").alias("rec_id"), _audio(F.col("embedding"), 0.0).alias("audio"))


def recordings(vectors: DataFrame) -> DataFrame:
    """Recordings with something to find, for tests.

    Rows whose id leaves 1 or 2 by twenty are later, noisy takes of the row at the multiple of twenty before
    them, where there is one; all others are recordings of their own vector. Takes begin at different notes.
    """
    place = F.pmod("vec_id", F.lit(20))
    first = vectors.where(place == 0).groupBy("vec_id").agg(F.first("embedding").alias("first")).select(F.col("vec_id").alias("of"), "first")
    takes = vectors.where(place.isin(1, 2)).select("vec_id", "embedding", (F.col("vec_id") - place).alias("of")).join(first, "of", "left")
    own = own_recordings(vectors.where(F.coalesce(~place.isin(1, 2), F.lit(True))))
    return own.unionByName(takes.select(F.col("vec_id").alias("rec_id"), _audio(F.coalesce("first", "embedding"), 0.05).alias("audio")))


def op7_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth recording asks for its matches among all."""
    sounds = own_recordings(common.read(spark, sf_dir, "embeddings"))
    prints = fingerprints(sounds, F.col("rec_id"), F.col("audio"), lambda a: melody(**a))
    return align(prints, F.col("rec_id") % 20 == 0).withColumnRenamed("rec_id", "vec_id")
