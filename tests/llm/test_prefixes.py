import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import prefixes

JSON = public_tokenizers.path("byte_bpe_50k.json")
BITS = (
    "a", "the ", "don't", "'re", "we'll ", "'s", "'ve", "!!", " ", "  ", "\n", "\t", "\r\n", "é", "🙂", "漢字", "12", "<|endoftext|>", "<|endof", "text|>", "'", "ʼ", "\x1c", "\x85", "ՠ", "_", " x",
    "Hello", "ing", "'llx", " antidisestablishmentarianism", "a" * 90, "=" * 300, " onbleeaea",
)


def slow(texts):
    return [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch(texts, add_special_tokens=False)]


def test_every_prefix_has_the_count_that_the_library_gives_it():
    own, r = prefixes.counter(JSON, public_tokenizers.PATTERN), random.Random(11)
    texts = ["", *BITS, *("".join(r.choice(BITS) for _ in range(r.randrange(1, 7))) for _ in range(250))]
    for text in texts:
        assert own.counts(text).tolist() == slow([text[:n] for n in range(len(text) + 1)]), text


def test_counts_don_t_depend_on_what_a_worker_remembers(monkeypatch):
    monkeypatch.setattr(prefixes, "REMEMBERED", 2)
    own = prefixes.PrefixCounter(JSON, public_tokenizers.PATTERN)
    for text in ("one two three four five six", "don't we'll\n\n it's " * 3, "x" * 70 + " y"):
        assert own.counts(text).tolist() == slow([text[:n] for n in range(len(text) + 1)])


def test_one_row_a_document(spark, docs, empty):
    extra = spark.createDataFrame([(50, "a" * 5000), (51, " " * 700 + "x" + "\n" * 700), (52, "ab🙂" * 900)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    found = prefixes.prefix_counts(rows, JSON, public_tokenizers.PATTERN)
    assert found.columns == ["doc_id", "n_bytes", "counts"] and found.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    texts = [(r.doc_id, r.text or "") for r in rows.collect()]
    want = sorted(((i, len(t.encode()), n) for (i, t), n in zip(texts, slow([t for _, t in texts]))), key=repr)
    assert sorted((tuple(r) for r in found.select("doc_id", "n_bytes", prefixes.tokens_of(F.col("counts"))).collect()), key=repr) == want
    assert prefixes.prefix_counts(docs, JSON, public_tokenizers.PATTERN).count() == docs.count()
    assert prefixes.prefix_counts(empty, JSON, public_tokenizers.PATTERN).count() == 0


def test_questions_about_budgets(spark):
    text = "We'll see the  rest of it\n\n\nin 12 days, <|endoftext|> perhaps'll"
    n = slow([text[:k] for k in range(len(text) + 1)])
    found = prefixes.prefix_counts(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), JSON, public_tokenizers.PATTERN)
    for budget in (-1, 0, 1, 5, 9, 100):
        best = {r.doc_id: r.b for r in found.select("doc_id", prefixes.chars_within(F.col("counts"), budget).alias("b")).collect()}
        assert best == {1: max((k for k, c in enumerate(n) if c <= budget), default=None), 2: 0 if budget >= 0 else None}
    for k in (0, 3, len(text), len(text) + 50):
        assert {r.doc_id: r.n for r in found.select("doc_id", prefixes.tokens_of(F.col("counts"), k).alias("n")).collect()} == {1: n[min(k, len(text))], 2: 0}
