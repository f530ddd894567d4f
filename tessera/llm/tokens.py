"""Byte-level BPE: encoding of long texts in overlapping chunks, decoding, and packing of token sequences.

Long texts are cut into chunks that overlap. Chunks are pre-tokenised in parallel, each from wherever it
begins. What follows a pre-token boundary depends on nothing before it, so from the first boundary that
two neighbours share in their overlap both agree: the text is cut there, the pieces are encoded on their
own, and their ids are joined. A pair of chunks without a shared boundary sends its text down the exact
way: one piece. Decoding joins the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Texts of more characters than this are cut into chunks of this length.
CHUNK_CHARS = 16_384
#: Characters that a chunk shares with the one before it.
OVERLAP_CHARS = 256

SEQUENCE_TOKENS = 2_048
END_ID = 1
#: Documents that are packed together, on average; each group goes to one task.
GROUP_DOCUMENTS = 4_096


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
    """The tiktoken encoding of a rank file, once per worker; ``added`` tokens are found in plain text too."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks_path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))


def added_tokens(tokenizer_json: str) -> tuple[tuple[str, int], ...]:
    """The tokens that a tokenizer's JSON adds to its vocabulary, which it matches wherever they stand in a text."""
    with open(tokenizer_json, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    for token in found:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"an added token that takes in what stands beside it: {token['content']!r}")
    return tuple((t["content"], t["id"]) for t in found)


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def boundaries(text: str, pattern: str, start: int, end: int) -> list[int]:
    """The places from ``start`` to before ``end`` where a pre-token begins after a character that is no white space."""
    out, cut = [], _splitter(pattern)
    for m in cut.finditer(text):
        p = m.start()
        if p >= end:
            break
        if p >= start and p > 0 and not text[p - 1].isspace():
            out.append(p)
    return out


def _ids(encoder, text: str | None) -> np.ndarray:
    """The ids of a text, those of the encoding's added tokens, if it has any, among them."""
    return np.asarray(encoder.encode_to_numpy(text or "", allowed_special="all"), dtype="<u4")


def _summary(encoder, ids: bytes) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids, SHA-256 of the bytes that they decode to."""
    decoded = encoder.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


_ENCODED = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Texts of up to ``chunk_chars`` characters are one chunk and are encoded where they are read; longer ones are
    spread over the cluster chunk by chunk. Null texts count as empty: no ids. Rows that repeat give
    rows that repeat; an empty table gives none; other columns are not looked at.
    """
    rows = common.bound_batches(docs).select(common.text_id(docs), F.coalesce("text", F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk_chars)
    long = rows.where(F.length("text") > chunk_chars)

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoding(ranks_path, pattern)
        for batch in batches:
            facts = [_summary(encoder, _ids(encoder, t).tobytes()) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], **{c: [f[k] for f in facts] for k, c in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}})

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each text in chunks, in one pass over it."""
        for batch in batches:
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"]):
                begins = range(0, len(text), chunk_chars)
                yield pd.DataFrame({"row": row, "doc_id": doc_id, "chunk": range(len(begins)), "text": [text[max(b - overlap_chars, 0) : b + chunk_chars] for b in begins]})

    def outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each chunk with the boundaries in the overlap with the one before and with the one after, as places in the text."""
        for batch in batches:
            heads, tails = [], []
            for k, t in zip(batch["chunk"], batch["text"]):
                begin = k * chunk_chars - (overlap_chars if k else 0)
                found = boundaries(t, pattern, 0, len(t))
                heads.append([begin + p for p in found if k and p < overlap_chars])
                # the last pre-token may go on beyond the chunk, and only its beginning is certain
                tails.append([begin + p for p in found if p >= len(t) - overlap_chars])
            yield batch.assign(head=heads, tail=tails)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoding(ranks_path, pattern)
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "doc_id": batch["doc_id"], "chunk": batch["chunk"], "ids": [_ids(encoder, t).tobytes() for t in batch["piece"]]})

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        return pd.DataFrame([(group["doc_id"].iloc[0], *_summary(encoding(ranks_path, pattern), b"".join(group["ids"])))], columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chunks = long.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInPandas(sliced, "row long, doc_id string, chunk int, text string").repartition("row", "chunk")
    chunks = common.keep(chunks.mapInPandas(outline, "row long, doc_id string, chunk int, text string, head array<int>, tail array<int>"))
    by_text = Window.partitionBy("row").orderBy("chunk")
    cut = F.array_min(F.array_intersect("head", F.lag("tail").over(by_text)))
    cuts = chunks.select("row", "chunk", "head", "tail").withColumn("cut", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(cut))
    ends = cuts.select("row", "chunk", "cut", F.lead("cut").over(by_text).alias("next"), F.max("chunk").over(Window.partitionBy("row")).alias("last"), F.max(F.col("cut").isNull()).over(Window.partitionBy("row")).alias("torn"))
    told = chunks.drop("head", "tail").join(ends, ["row", "chunk"])
    stitched = told.where(~F.col("torn")).select(
        "row", "doc_id", "chunk",
        F.expr("substring(text, cut - greatest(chunk * {c} - {o}, 0) + 1, coalesce(next, 2147483647) - cut)".format(c=chunk_chars, o=overlap_chars)).alias("piece"),
    )
    # no shared boundary somewhere: the chunks of such a text are put together again
    own = F.when(F.col("chunk") == 0, F.col("text")).otherwise(F.expr(f"substring(text, {overlap_chars + 1}, 2147483647)"))
    torn = told.where("torn").groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", own.alias("t")))).alias("parts"))
    torn = torn.select("row", "doc_id", F.lit(0).alias("chunk"), F.array_join(F.transform("parts", lambda p: p["t"]), "").alias("piece"))
    encoded = stitched.unionByName(torn).mapInPandas(pieces, "row long, doc_id string, chunk int, ids binary")
    return common.typed_id(short.mapInPandas(whole, _ENCODED).unionByName(encoded.groupBy("row").applyInPandas(joined, _ENCODED)), docs)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests; edge cases as ``encode_documents`` states."""
    import public_tokenizers

    return encode_documents(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


class BinTree:
    """A tournament tree over the room left in bins: the first bin with room for an item, in logarithmic time."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> tuple[int, int]:
        """Puts an item of this size into the first bin that takes it; gives the bin and the room it had."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had = room[node]
        room[node] = had - size
        at = node // 2
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
            at //= 2
        return node - self.leaves, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """For each item its bin and its offset there. Larger items go first, equal ones in their order."""
    tree, out = BinTree(len(sizes), capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b, had = tree.first_fit(sizes[i])
        out[i] = (b, capacity - had)
    return out


_PIECES = "doc_id string, grp long, row long, start long, length long, ids_crc32 long, doc_tokens long"
_PACKED = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, group_documents: int = GROUP_DOCUMENTS, added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Packs the tokens of all documents into sequences: one row per piece of a document.

    ``added`` tokens get their ids wherever they stand in a text.

    A document is its ids and then ``end_id``; null texts are ``end_id`` alone. Documents over ``capacity``
    are cut into full sequences and a rest. Pieces are dealt into random groups by row, so that copies
    don't meet in one, and each group is packed by itself: first fit, larger pieces first. Rows that repeat are
    packed one by one; an empty table gives no rows; other columns are not looked at.
    """
    groups = max(1, docs.count() // group_documents)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoding(ranks_path, pattern, added)
        for batch in batches:
            out = []
            for doc_id, row, text in zip(batch["doc_id"], batch["row"], batch["text"]):
                ids = np.append(_ids(encoder, text), np.uint32(end_id)).astype("<u4").tobytes()
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    out.append((doc_id, row, start, len(part) // 4, zlib.crc32(part), n))
            done = pd.DataFrame(out, columns=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])
            mixed = done["row"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            done["grp"] = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % groups
            yield done[["doc_id", "grp", "row", "start", "length", "ids_crc32", "doc_tokens"]]

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row", "start"], kind="stable")
        placed = first_fit_decreasing(group["length"].tolist(), capacity)
        bins = np.array([b for b, _ in placed], dtype=np.int64)
        out = group[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        out["sequence_id"] = bins * groups + int(group["grp"].iloc[0])
        out["offset"] = np.array([o for _, o in placed], dtype=np.int64)
        return out

    rows = common.bound_batches(docs).select(common.text_id(docs), F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return common.typed_id(rows.mapInPandas(cut, _PIECES).groupBy("grp").applyInPandas(pack, _PACKED), docs)


def pack_by_byte_bpe(docs: DataFrame) -> DataFrame:
    """``pack_documents`` by the public byte-level BPE of 50,000 merges: its ranks, and the tokens that its JSON adds."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens; nulls, empties, long texts and repeats as ``pack_documents`` states."""
    return pack_by_byte_bpe(common.read(spark, sf_dir, "documents"))
