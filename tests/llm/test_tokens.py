import hashlib
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import tokens

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_encoding_in_chunks_is_that_of_the_whole(spark, docs, empty):
    extra = spark.createDataFrame([(50, "a" * 3000), (51, " " * 500 + "x" + "\n" * 700), (52, "don't we'll it's é 12 34\t" * 100), (53, "🙂" * 400 + " end")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    encoder = tokens.encoding(MULTI, public_tokenizers.PATTERN)
    want = []
    for r in rows.collect():
        ids = np.array(encoder.encode_ordinary(r.text or ""), dtype="<u4")
        want.append((r.doc_id, len(ids), sha(ids.tobytes()), sha((r.text or "").encode())))
    for chunk, overlap in ((tokens.CHUNK_CHARS, tokens.OVERLAP_CHARS), (200, 40), (64, 8)):
        got = [tuple(r) for r in tokens.encode_documents(rows, MULTI, public_tokenizers.PATTERN, chunk, overlap).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert tokens.encode_documents(empty, MULTI, public_tokenizers.PATTERN).count() == 0


def test_packing(docs, empty):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in docs.collect():
        ids = np.array([*slow.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.setdefault(r.doc_id, []).append(ids)
    rows = tokens.pack_documents(docs, BYTES, public_tokenizers.PATTERN, capacity=512, group_documents=4).collect()
    assert sum(r.length for r in rows) == sum(len(i) for v in want.values() for i in v)
    for r in rows:
        assert any(len(i) == r.doc_tokens and zlib.crc32(i[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for i in want[r.doc_id])
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    assert tokens.pack_documents(empty, BYTES, public_tokenizers.PATTERN).count() == 0


def test_first_fit_decreasing_is_that_of_a_plain_search():
    r = np.random.default_rng(3)
    for _ in range(20):
        sizes, capacity = r.integers(1, 60, 80).tolist(), 100
        bins, want = [], [None] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((k for k, used in enumerate(bins) if used + sizes[i] <= capacity), len(bins))
            if b == len(bins):
                bins.append(0)
            want[i] = (b, bins[b])
            bins[b] += sizes[i]
        assert tokens.first_fit_decreasing(sizes, capacity) == want
    assert tokens.first_fit_decreasing([], 10) == []


def test_added_tokens_are_found_in_plain_text(spark):
    slow, added = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokens.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "hello <|endoftext|> x", "a<|endoftext|>b <|endoftext|><|endoftext|>\n", "<|endoftext|", "no token", ""]
    rows = tokens.pack_by_byte_bpe(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        ids = np.array([*slow.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], dtype="<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids.tobytes())
    assert len(rows) == len(texts) and dict(added) == {"<|endoftext|>": 50256}


def test_little_is_padded(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(k, "word " * int(n)) for k, n in enumerate(r.integers(1, 3000, 600))], "doc_id long, text string")
    rows = tokens.pack_by_byte_bpe(df).collect()
    assert sum(x.length for x in rows) >= 0.98 * tokens.SEQUENCE_TOKENS * len({x.sequence_id for x in rows})
