"""Near-duplicate documents by ProbMinHash.

A text is the multiset of its word shingles. Every distinct shingle sends arrivals of a Poisson process
whose rate is its count, each to a random one of the signature's components; a component keeps its first
arrival's shingle, and a shingle stops when its next arrival is later than every component's first. Two
components agree with the probability Jaccard of the two texts. Bands of components make buckets; pairs
from the buckets are verified by the exact probability Jaccard, and linked texts form classes.

No bucket is expanded into all pairs. Its members are compared with one representative, a head, the one that
meets most others over all buckets; then, as long as that settles some, those in other components with a new
head. One minus the probability Jaccard is a metric, so afterwards only pairs remain that lie in different
components and whose distances to no head differ by more than a link's. Two texts have at most as many shingles in common
as the smaller of their shares of a head, and the smaller of what else they hold that a third text may hold too; pairs that
need more are settled by that count, which grows with the texts, not with the pairs. Of the others, each in the first bucket
that its two texts share, the pairs whose signatures agree nearly often enough are compared one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components

SHINGLE_WORDS = 5
#: Texts that are shingled together: so many bytes and so many texts at most, whatever a batch holds.
_BLOCK_BYTES, _BLOCK_TEXTS = 1 << 20, 2_048
#: Bytes that are hashed together, as each takes some longs while it is.
_PIECE_BYTES = 1 << 16
#: Keys of the texts to compare are broadcast up to this size; beyond it the texts are shuffled to them.
BROADCAST_BYTES = 8 << 20
#: Texts on either side of a block of pairs, on average; those of the v side are held in memory, those of the u side pass by.
BLOCK_U, BLOCK_V = 4_096, 256
#: Bytes of a long: so many components, a byte of each, stand for a band when signatures are compared.
_PACKED = 8
#: What ``_counts`` tells of a text.
_COUNTED = ("shingles", "repeats", "shared")
_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    """A pair of similarity ``threshold`` meets in a bucket with probability 1 - (1 - threshold ** rows) ** bands."""

    bands: int = 40
    rows: int = 8
    threshold: float = 0.8
    #: A signature's estimate may fall short of the threshold by so many standard deviations (four: one pair in 30,000 falls shorter).
    deviations: float = 4.0
    #: So many heads a bucket at most before its remaining pairs are looked at; fewer if the last one settled little.
    rounds: int = 6

    def __post_init__(self) -> None:
        if not 1 <= self.rows <= _PACKED:
            raise ValueError(f"a band has 1 to {_PACKED} rows, not {self.rows}")

    @property
    def size(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """So many components agree at least."""
        t = self.threshold
        return int(self.size * (t - self.deviations * (t * (1 - t) / self.size) ** 0.5))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_BASE, _PLACES = _U(0xD6E8FEB86659FD93), _mix(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03)) | _U(1)


def _powers(base: int) -> np.ndarray:
    known = np.full(_PIECE_BYTES, base, dtype=np.uint64)
    known[0] = 1
    return np.cumprod(known)


_UP, _DOWN = _powers(int(_BASE)), _powers(pow(int(_BASE), -1, 1 << 64))


def _words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, piece by piece of the bytes: what is held for a byte doesn't grow with the data, nor with a word."""
    out = np.zeros(len(begins), dtype=np.uint64)
    for at in range(0, len(data), _PIECE_BYTES):
        piece = data[at : at + _PIECE_BYTES]
        i, j = np.searchsorted(ends, at, side="right"), np.searchsorted(begins, at + len(piece))
        if i == j:
            continue
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[piece] * _UP[: len(piece)], out=sums[1:])
        first, last = np.maximum(begins[i:j] - at, 0), np.minimum(ends[i:j] - at, len(piece))
        part = (sums[last] - sums[first]) * _DOWN[first]
        # none but the first may have begun before the piece
        part[:1] *= _U(pow(int(_BASE), max(at - int(begins[i]), 0), 1 << 64))
        out[i:j] += part
    return _mix(out)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), ordered, of texts that lie end to end in ``data``.

    Words end at white space; a shingle is a 64-bit hash of five words in order. A text of fewer words is one shingle; one
    without words has none.
    """
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = np.flatnonzero(solid & (edge[:n] | ~np.concatenate([[False], solid[:-1]])))
    ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    words = _words(data, begins, ends)
    text = np.searchsorted(offsets, begins, side="right") - 1
    per_text = np.bincount(text, minlength=len(offsets) - 1)
    m = len(words) - SHINGLE_WORDS + 1
    if m > 0:
        h = np.zeros(m, dtype=np.uint64)
        for k in range(SHINGLE_WORDS):
            h += words[k : k + m] * _PLACES[k]
        same = text[:m] == text[SHINGLE_WORDS - 1 :]
        owner, h = text[:m][same], h[same]
    else:
        owner, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    few = np.flatnonzero((per_text > 0) & (per_text < SHINGLE_WORDS))
    if len(few):
        first = np.searchsorted(text, few)
        low = np.array([(words[s : s + c] * _PLACES[:c]).sum() + _U(c) for s, c in zip(first, per_text[few])], dtype=np.uint64)
        owner, h = np.concatenate([owner, few]), np.concatenate([h, low])
    h = _mix(h)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """The ProbMinHash signature of each text: for each component the shingle that arrives first. Texts without shingles get zeros."""
    first = np.full(texts * size, np.inf)
    out = np.zeros(texts * size, dtype=np.uint64)
    seed, now, w, drawn = _mix(shingle + _U(11)), np.zeros(len(shingle)), weight.astype(np.float64), 0
    while len(owner):
        # one arrival at a time while many shingles go on, then several at once for the few that are left
        steps = max(1, min(16, 40_000 // len(owner)))
        # an arrival depends on the shingle and its number alone, whatever other texts are at hand
        draws = _mix(seed[:, None] + np.arange(drawn + 1, drawn + steps + 1, dtype=np.uint64) * _GOLDEN)
        gaps = -np.log(((draws >> _U(11)).astype(np.float64) + 0.5) / 2.0**53)
        times = now[:, None] + np.cumsum(gaps, axis=1) / w[:, None]
        slot = owner[:, None] * size + (_mix(draws + _U(7)) % _U(size)).astype(np.int64)
        np.minimum.at(first, slot.ravel(), times.ravel())
        won = times == first[slot]
        out[slot[won]] = np.broadcast_to(shingle[:, None], slot.shape)[won]
        last = first.reshape(texts, size).max(axis=1)
        drawn, now = drawn + steps, times[:, -1]
        on = now < last[owner]
        owner, shingle, w, seed, now = owner[on], shingle[on], w[on], seed[on], now[on]
    return out.reshape(texts, size)


def _column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text begins."""
    column = batch.column(name).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8), offsets


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of ``_BLOCK_TEXTS`` texts and ``_BLOCK_BYTES`` at most; a longer text is a run of its own."""
    i = 0
    while i < len(offsets) - 1:
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + _BLOCK_BYTES, side="right")) - 1), i + _BLOCK_TEXTS)
        yield i, j
        i = j


def band_keys(data: np.ndarray, offsets: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """For each text the keys of its buckets, one for each band, and a byte of each component of its signature, a long for each band.

    A text without words has zeros.
    """
    out, packed = [np.zeros((0, params.bands), dtype=np.int64)], [np.zeros((0, params.bands), dtype=np.int64)]
    place = _mix(np.arange(1, params.rows + 1, dtype=np.uint64)) | _U(1)
    for i, j in _blocks(offsets):
        owner, shingle, count = shingles(data, offsets[i : j + 1])
        s = signatures(owner, shingle, count, j - i, params.bands * params.rows).reshape(j - i, params.bands, params.rows)
        keys = _mix((s * place).sum(axis=2) + np.arange(1, params.bands + 1, dtype=np.uint64) * _GOLDEN)
        keys[np.bincount(owner, minlength=j - i) == 0] = 0
        out.append(keys.view(np.int64))
        low = ((s >> _U(17)) & _U(255)).astype(np.int64)
        packed.append((low << (8 * np.arange(params.rows))).sum(axis=2))
    return np.concatenate(out), np.concatenate(packed)


def distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, in order; where each text's begin; and of each text how many shingles repeat one before."""
    held, lengths, repeats = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
    for i, j in _blocks(offsets):
        owner, shingle, count = shingles(data, offsets[i : j + 1])
        held.append(shingle)
        lengths.append(np.bincount(owner, minlength=j - i))
        repeats.append(np.bincount(owner, weights=count - 1, minlength=j - i).astype(np.int64))
    return np.concatenate(held), np.cumsum(np.concatenate(lengths)), np.concatenate(repeats)


def agreeing(a: str, b: str, size: int) -> Column:
    """In how many bytes two packed signatures of ``size`` components are equal: each byte's bits are folded into its lowest."""

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for shift, mask in ((4, "0f"), (2, "03"), (1, "01")):
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift)).bitwiseAND(F.lit(int(mask * _PACKED, 16)))
        return F.bit_count(d)

    return size - F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda n, x: n + x)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, float]:
    """How many distinct shingles two multisets, each as ordered distinct shingles and their counts, share, and their exact probability Jaccard."""
    common_, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common_):
        return 0, 0.0
    x, y = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio, back, _ = np.unique(x / y, return_inverse=True, return_counts=True)
    by_x, by_y = np.bincount(back, weights=x), np.bincount(back, weights=y)
    upper = by_x[::-1].cumsum()[::-1] + only_x  # from shingles whose ratio is at least this one
    lower = np.concatenate([[0.0], by_y.cumsum()[:-1]]) + only_y
    return len(common_), float((x / (upper[back] + ratio[back] * lower[back])).sum())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard of two multisets."""
    return overlap(a, b)[1]


def _node() -> Column:
    """The 16 bytes that stand for a text."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _texts(docs: DataFrame) -> DataFrame:
    return common.bound_batches(docs).where(F.col("text").isNotNull()).select(_node().alias("node"), "text")


def _buckets(docs: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """(node, sig) of every text, and (key, band, node, n) of every bucket with ``n`` texts, two or more."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel())) for x in band_keys(*_column(batch, "text"), params)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *lists], names=["node", "keys", "sig"])

    nodes = common.written(_texts(docs).mapInArrow(bands, "node binary, keys array<long>, sig array<long>").groupBy("node").agg(F.first("keys").alias("keys"), F.first("sig").alias("sig")))
    placed = nodes.select("node", F.posexplode("keys").alias("band", "key")).where("key <> 0")
    full = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return nodes.select("node", "sig"), common.written(placed.join(full, "key").select("key", "band", "node", "n"))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the distinct nodes ``wanted``."""
    small = common.fits(wanted, BROADCAST_BYTES, 64)
    return _texts(docs).join(F.broadcast(wanted) if small else wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def _counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of each of the distinct nodes ``wanted``: its distinct ``shingles``, its ``repeats`` beyond them, and how many of them are ``shared`` with another of these nodes."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingle, ends, repeats = distinct(*_column(batch, "text"))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(shingle.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists, pa.array(np.diff(ends)), pa.array(repeats)], names=["node", "held", "shingles", "repeats"])

    rows = common.written(_texts_of(docs, wanted).mapInArrow(counted, "node binary, held array<long>, shingles long, repeats long"))
    # those of one text are counted and taken off, as a join would deal a shingle's texts to one task
    own = rows.select("node", F.explode("held").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("texts"), F.min("node").alias("node")).where("texts = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    return common.written(rows.drop("held").join(own, "node", "left").select("node", "shingles", "repeats", (F.col("shingles") - F.coalesce("own", F.lit(0))).alias("shared")), rows)


def _unlike(u: Callable[[str], Column], v: Callable[[str], Column], near: float) -> Column:
    """Whether what is known of two texts of a bucket rules out that their distance is ``near``: exact, as far as it is known.

    ``dist`` and ``common`` are by head. With c shingles in common and r repeats, a probability Jaccard is at most
    (c + r) / (all shingles - c + r): each shingle's part of it is at most its larger count by the sum of the larger counts.
    """
    far = F.exists(F.zip_with(u("dist"), v("dist"), lambda x, y: F.abs(x - y) > near), lambda far: F.coalesce(far, F.lit(False)))
    # a null, of a text that wasn't compared with the head, leaves the other text's shared shingles
    by_head = F.zip_with(u("common"), v("common"), lambda x, y: F.least(x, y) + F.least(u("shared") - x, v("shared") - y))
    most, repeats = F.least(F.array_min(by_head), u("shared"), v("shared")), u("repeats") + v("repeats")
    few = most + repeats < (1.0 - near) * (u("shingles") + v("shingles") - most + repeats)
    return far | F.coalesce(few, F.lit(False))


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with ``distance`` and the number of shingles in ``common``, by their whole texts.

    Pairs are dealt by a block of some ``BLOCK_V`` of the v and one of some ``BLOCK_U`` of the u, so that a text moves once to
    each block that it has a pair in, and neither a text with many pairs nor many pairs among few texts meet in one task.
    """
    pairs = common.written(pairs)
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    sizes = pairs.agg(F.approx_count_distinct("u").alias("u"), F.approx_count_distinct("v").alias("v")).first()
    texts = _texts_of(docs, wanted)
    cells = pairs.select("u", "v", F.pmod(F.xxhash64("u"), F.lit(sizes["u"] // BLOCK_U + 1)).alias("bu"), F.pmod(F.xxhash64("v"), F.lit(sizes["v"] // BLOCK_V + 1)).alias("bv"))
    # the v of a cell come first
    told = cells.groupBy("bu", "bv", F.col("v").alias("node")).agg(F.array().cast("array<binary>").alias("others"), F.lit(0).alias("asks"))
    asks = cells.groupBy("bu", "bv", F.col("u").alias("node")).agg(F.collect_list("v").alias("others"), F.lit(1).alias("asks"))
    rows = told.unionByName(asks).join(texts, "node").repartition("bu", "bv").sortWithinPartitions("bu", "bv", "asks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, known = None, {}
        for batch in batches:
            u, v, shared, out = [], [], [], []
            data, offsets = _column(batch, "text")
            for k, (bu, bv, node, others, asks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bu", "bv", "node", "others", "asks")))):
                if cell != (bu, bv):
                    cell, known = (bu, bv), {}
                own = shingles(data, offsets[k : k + 2])[1:]
                if not asks:
                    known[node] = own
                for other in others:
                    u.append(node)
                    v.append(other)
                    n, like = overlap(own, known[other])
                    shared.append(n)
                    out.append(1.0 - like)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(out, pa.float64()), pa.array(shared, pa.int64())], names=["u", "v", "distance", "common"])

    return common.written(rows.mapInArrow(compare, "u binary, v binary, distance double, common long"), pairs)


def _among(comps: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with ``comp``: that of their node, or the node itself."""
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _settle(docs: DataFrame, members: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """Components by links to heads; and the members of buckets that still have several.

    The latter are (key, band, node, comp, heads, dist, common, main), with the columns of ``_counts``: the bucket's heads so
    far, the distances to them and the shingles in common (null to those of the same component or ruled out), and whether the
    component is that of the first. All pairs of a bucket's first head are compared, and of later ones those not ruled out.
    """
    near = 1.0 - params.threshold + 1e-12
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    live = members.drop("n").join(degree, "node").select("key", "band", "node", "degree", F.col("node").alias("comp"), F.array().cast("array<binary>").alias("heads"), F.array().cast("array<double>").alias("dist"), F.array().cast("array<long>").alias("common"), F.lit(True).alias("open"), *[F.lit(None).cast("long").alias(c) for c in _COUNTED])
    comps, left, start = None, live.count(), live
    buckets = live.select("key").distinct().count()
    for _ in range(params.rounds):
        known = ["comp", "dist", "common", *_COUNTED]
        head = live.where("open").groupBy("key").agg(F.max(F.struct("degree", "node", *known)).alias("h")).select("key", F.col("h.node").alias("head"), *[F.col(f"h.{c}").alias(f"head_{c}") for c in known])
        before, live = live, common.written(live.join(head, "key", "left"))
        asked = live.where("head is not null and comp <> head_comp").where(~_unlike(F.col, lambda c: F.col(f"head_{c}"), near)).select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
        tested = _verified(docs, asked)
        links = tested.where(F.col("distance") <= near).select("u", "v")
        if comps is None:
            comps = components(links)
        elif links.take(1):
            comps = components(comps.select(F.col("node").alias("u"), F.col("comp").alias("v")).unionByName(links))
        told = live.join(tested.select(F.col("u").alias("node"), F.col("v").alias("head"), "distance", F.col("common").alias("shares")), ["node", "head"], "left")
        longer = lambda a, x: F.when(F.col("head").isNull(), F.col(a)).otherwise(F.concat(a, F.array(x))).alias(a)
        told = told.select("key", "band", "node", "degree", longer("heads", "head"), longer("dist", "distance"), longer("common", "shares"), *_COUNTED)
        told = common.written(_among(comps, told), live, tested, *([before] if before is not start else []))
        # of each bucket with several components: the components of its heads, the first head's first
        of_heads = told.where(F.array_contains("heads", F.col("node"))).groupBy("key").agg(F.collect_set("comp").alias("seen"), F.max(F.when(F.col("node") == F.get("heads", F.lit(0)), F.col("comp"))).alias("first"))
        several = told.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
        live = told.join(several, "key", "left_semi").join(of_heads, "key")
        live = common.written(live.select("key", "band", "node", "degree", "comp", "heads", "dist", "common", *_COUNTED, (F.col("comp") == F.col("first")).alias("main"), (~F.array_contains("seen", F.col("comp"))).alias("open")), told)
        if before is start:
            # later rounds are on some of these texts
            live = common.written(live.drop(*_COUNTED).join(_counts(docs, live.select("node").distinct()), "node"), live)
        now = live.where("open").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("key").alias("buckets")).first()
        # links, not only the heads' own places, must have settled a tenth
        if not now["rows"] or left - buckets - now["rows"] < 0.1 * left:
            break
        left, buckets = now["rows"], now["buckets"]
    return comps, live


def linked(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(node, comp): the texts, by their md5, that have links, and the component that the links join them to."""
    with common.tidy(docs.sparkSession):
        near = 1.0 - params.threshold + 1e-12
        nodes, members = _buckets(docs, params)
        comps, live = _settle(docs, members, params)
        # a head has met all others
        live = live.where(~F.array_contains("heads", F.col("node"))).join(nodes, "node")
        side = lambda c: [F.col(x).alias(f"{c}_{x}") for x in ("node", "comp", "dist", "common", *_COUNTED, "sig")]
        apart, others = live.where(~F.col("main")).select("key", "band", *side("u")), live.select(F.col("key").alias("v_key"), *side("v"), "main")
        # a pair whose components differ has a side that isn't in the bucket's main component
        once = (F.col("u_comp") != F.col("v_comp")) & (F.col("main") | (F.col("u_node") < F.col("v_node")))
        excluded = _unlike(lambda c: F.col(f"u_{c}"), lambda c: F.col(f"v_{c}"), near)
        before = lambda c: F.slice(c, F.lit(1), F.col("band"))
        earlier = F.exists(F.zip_with(before("u_sig"), before("v_sig"), lambda x, y: x == y), lambda same: same)
        rest = apart.join(others, (F.col("key") == F.col("v_key")) & once & ~excluded & (agreeing("u_sig", "v_sig", params.size) >= params.least_equal) & ~earlier)
        rest = _verified(docs, rest.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")).distinct())
        late = rest.where(F.col("distance") <= near).select("u", "v")
        if not late.take(1):
            return comps
        return components(comps.select(F.col("node").alias("u"), F.col("comp").alias("v")).unionByName(late))


def classes(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, node (the md5 of the text), comp (that of its class).

    A class holds equal texts and all that chains of links join; its id is the least doc_id in it. Texts
    without a word are alike only if equal; a null text is in a class of its own row; rows that repeat are in one class;
    an empty table gives no rows.
    """
    comps = linked(docs, params)
    rows = docs.select("doc_id", _node().alias("node"))
    named = rows.join(comps, "node", "left").select("doc_id", "node", F.coalesce("comp", "node").alias("comp"))
    named = common.written(named)
    ids = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return named.join(ids, "comp", "left").select(
        "doc_id", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), "node", "comp"
    )


def representatives(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``docs`` with one document of each class: the one with the least doc_id. All columns stay; null texts stay."""
    kept = classes(docs, params).where("node is not null and doc_id <=> class_id").groupBy("comp", "class_id").agg(F.min("node").alias("node"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.col("doc_id").alias("d_id"), _node().alias("d_node"))
    both = rows.join(kept, F.col("d_id").eqNullSafe(F.col("class_id")) & (F.col("d_node") == F.col("node")))
    one = both.groupBy("d_id", "d_node").agg(F.first("doc").alias("doc"))
    return one.select("doc.*").unionByName(docs.where(F.col("text").isNull()))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and how many documents it has; nulls, empties, long texts, ties and repeats as ``classes`` states."""
    return classes(common.read(spark, sf_dir, "documents")).drop("node", "comp")
