"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier per bit, over hashed byte n-grams of the lower-cased
text, predicts that bit. A text gets the language whose codeword has the least weighted loss, where a bit
weighs as much as its classifier was right in training; a text whose best two are close is ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

UNDETERMINED = "und"
HASH_BITS = 13
NGRAMS = (2, 3)
#: The training sample's bounds: documents a language, and in all. Their whole texts are counted.
SAMPLE_PER_LANG, SAMPLE_ROWS = 300, 2_000
#: Characters of a short piece that a document is also learned from, from a third of its length on, as texts may be short.
PIECE_CHARS = 40
#: Counts of rows by language are broadcast up to this size.
BROADCAST_BYTES = 8 << 20
#: A text whose language is less likely than this, against all others, is ambiguous.
AMBIGUOUS_BELOW = 0.5
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Model:
    """``table``: weight of an n-gram for each bit. ``codes``: a row of +1 and -1 for each language."""

    langs: tuple[str, ...]
    codes: np.ndarray
    table: np.ndarray
    bias: np.ndarray
    bit_weights: np.ndarray
    scale: float


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Rows of +1 and -1. Up to five languages: every way to part them in two; else the best of many random codes."""
    if n <= 5:
        bits = [[1 if (k >> c) & 1 else -1 for c in range(n)] for k in range(1, 1 << max(n - 1, 0))]
        return np.array(bits, dtype=np.float32).reshape(-1, n).T
    rng, width, best, apart = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1.0, 1.0], dtype=np.float32), size=(n, width))
        gap = (width - (code @ code.T - 2 * width * np.eye(n)).max()) / 2
        if gap > apart:
            best, apart = code, gap
    return best


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """The hashed n-grams that begin at each place of ``data``."""
    m = len(data) - n + 1
    h = np.full(max(m, 0), n, dtype=np.uint32)
    for k in range(n):
        h = (h << np.uint32(8)) + data[k : k + m]
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - HASH_BITS)).astype(np.int32)


def _scores(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The mean of the table's rows over the n-grams of each text; ``data`` holds the texts end to end."""
    texts = len(offsets) - 1
    sums, counts = np.zeros((texts, table.shape[1])), np.zeros(texts)
    for n in NGRAMS:
        for at in range(int(offsets[0]), int(offsets[-1]), _BLOCK):
            h = _grams(data[at : min(at + _BLOCK + n - 1, int(offsets[-1]))], n)
            if not len(h):
                continue
            first = max(0, int(np.searchsorted(offsets, at, side="right")) - 1)
            last = int(np.searchsorted(offsets, at + len(h), side="left"))
            begin = np.clip(offsets[first:last] - at, 0, len(h))
            end = np.clip(offsets[first + 1 : last + 1] - at - (n - 1), begin, len(h))  # an n-gram lies in one text
            part = np.zeros((last - first, table.shape[1]))
            full = end > begin
            if full.any():
                edges = np.stack([begin[full], end[full]], axis=1).ravel()
                padded = np.append(h, np.int32(0))  # the last edge may be the end itself
                part[full] = np.add.reduceat(table[padded], edges, axis=0)[::2]
            sums[first:last] += part
            counts[first:last] += end - begin
    return sums / np.maximum(counts, 1)[:, None]


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def histogram(text: str) -> np.ndarray:
    """How often each hashed n-gram stands in the lower-cased text."""
    data = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    return sum(np.bincount(_grams(data, n), minlength=1 << HASH_BITS) for n in NGRAMS)


def train(x: np.ndarray, langs: list[str], rounds: int = 150) -> Model:
    """Fits one logistic classifier per bit on rows of n-gram counts."""
    names = tuple(sorted(set(langs)))
    x = x / np.maximum(x.sum(axis=1, keepdims=True), 1)
    scale = float(1 / max(np.sqrt((x**2).sum(axis=1).mean()), 1e-9))
    x *= scale
    codes = codewords(len(names))
    y = codes[[names.index(c) for c in langs]]
    w, b = np.zeros((x.shape[1], codes.shape[1]), dtype=np.float32), np.zeros(codes.shape[1], dtype=np.float32)
    v, vb = w.copy(), b.copy()
    rate = 4.0
    for _ in range(rounds):
        pull = y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        v = 0.9 * v + x.T @ pull / len(x) - 1e-5 * w
        vb = 0.9 * vb + pull.mean(axis=0)
        w, b = w + rate * v, b + rate * vb
    right = ((x @ w + b) * y > 0).mean(axis=0) if codes.shape[1] else np.ones(0)
    return Model(names, codes, w.astype(np.float32), b, (right / max(right.mean(), 1e-9) if len(right) else right).astype(np.float32), scale)


def decode(model: Model, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the language with the least weighted loss, and its share against the others."""
    f = means * model.scale + model.bias
    loss = np.stack([(np.logaddexp(0, -f * code) * model.bit_weights).sum(axis=1) for code in model.codes], axis=1)
    share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    share /= share.sum(axis=1, keepdims=True)
    return share.argmax(axis=1), share.max(axis=1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame) -> DataFrame:
    """lang and text of the bounded training sample: the documents of each language with the lowest hashes of doc_id, one text of each."""
    order = F.xxhash64("doc_id")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    # documents whose hash is low enough that some SAMPLE_PER_LANG times three are left of each language, then exactly the lowest;
    # the former where the rows are read, as else most rows might move to the task of one language
    counts = common.keep(labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")))
    small = common.fits(counts, BROADCAST_BYTES, F.octet_length("lang") + 16)
    low = F.shiftrightunsigned(order, 11) / float(2**53) * F.col("n") <= 3 * SAMPLE_PER_LANG
    few = labelled.select("doc_id", "lang").join(F.broadcast(counts) if small else counts, "lang").where(low).select("doc_id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_PER_LANG).orderBy("rank", "lang").limit(SAMPLE_ROWS).select("doc_id", "lang")
    texts = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
    return texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame) -> Model | None:
    """A model of the labelled rows of ``docs`` that aren't held out; None if there are none.

    Texts are counted where they are; the driver gets the counts of n-grams of at most ``SAMPLE_ROWS`` documents.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, at, n = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                start = len(text) // 3
                for part in (text, text[start : start + PIECE_CHARS]):
                    found = histogram(part)
                    langs.append(lang)
                    at.append(np.flatnonzero(found))
                    n.append(found[at[-1]])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int64()))], names=["lang", "at", "n"])

    rows = common.bound_batches(sample(docs)).mapInArrow(counted, "lang string, at array<int>, n array<long>").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["at"], r["n"]))
    x = np.zeros((len(rows), 1 << HASH_BITS), dtype=np.float32)
    for k, r in enumerate(rows):
        x[k, r["at"]] = r["n"]
    return train(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None, columns: list[Column]) -> DataFrame:
    """The ``columns`` of ``docs`` with lang_pred, score and ambiguous, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was
    learned; one learned language is always the answer. Each row is judged alone, so rows that repeat get
    equal results; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = common.bound_batches(docs).select(F.struct(*columns).alias("kept"), F.when(text.rlike(r"\p{L}"), F.lower(text)).alias("text"))
    out = rows.select("kept", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score")) if model is None else None
    if out is None:

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column("text").cast(pa.large_string())
                size = len(column)
                offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + size + 1]
                data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
                best, share = decode(model, _scores(data, offsets, model.table)) if size else (np.zeros(0, int), np.zeros(0))
                there = np.asarray(column.is_valid())
                names = [model.langs[k] if ok else UNDETERMINED for k, ok in zip(best, there)]
                yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(names, pa.string()), pa.array(np.where(there, share, 0.0))], names=["kept", "lang_pred", "score"])

        schema = rows.select("kept").schema.add("lang_pred", "string").add("score", "double")
        out = rows.mapInArrow(predict, schema)
    return out.select("kept.*", "lang_pred", "score", (F.col("score") < AMBIGUOUS_BELOW).alias("ambiguous"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those that aren't held out; edge cases as ``identify`` states."""
    docs = common.read(spark, sf_dir, "documents")
    return identify(docs, fit(docs), [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])
