import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language

SYLLABLES = {"aa": "ka lo mi te ru".split(), "bb": "sch ung ver lich".split(), "cc": "ción os que ñar".split()}


def text(lang, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, text(g, 5 + k % 60, k), g) for k in range(600) for g in [("aa", "bb", "cc")[k % 3]]]
    rows += [(1000, None, "aa"), (1001, "123 ... !!", "bb"), (1002, "", None), (1003, text("bb", 40, 7), None), (1003, text("bb", 40, 7), None), (None, text("cc", 40, 8), "cc")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).repartition(3)


def test_held_out_accuracy_and_undetermined(corpus):
    model = language.fit(corpus)
    assert model.langs == ("aa", "bb", "cc")
    out = language.identify(corpus, model, [F.col("doc_id"), F.col("lang"), language.held_out(F.col("doc_id")).alias("held_out")]).collect()
    assert len(out) == corpus.count()
    held = [r for r in out if r.held_out and r.doc_id < 1000]
    assert len(held) > 80 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert und == {1000, 1001, 1002} and all(0 <= r.score <= 1 for r in out)
    assert [r.lang_pred for r in out if r.doc_id == 1003] == ["bb", "bb"]


def test_scores_of_a_batch_are_those_of_each_text():
    texts = [text("aa", 30, 1), "", "x", "é", text("cc", 900, 2)]
    table = np.random.default_rng(1).standard_normal((1 << language.HASH_BITS, 3)).astype(np.float32)
    whole = language._scores(*language._flat(texts), table)
    for i, t in enumerate(texts):
        data, offsets = language._flat([t])
        grams = np.concatenate([language._grams(data, n) for n in language.NGRAMS])
        want = table[grams].mean(axis=0) if len(grams) else np.zeros(3)
        assert np.allclose(whole[i], want, atol=1e-5)
        assert np.allclose(language._scores(data, offsets, table)[0], want, atol=1e-5)


def test_codewords_are_apart():
    for n in (1, 2, 3, 4, 5, 6, 12):
        code = language.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == (n if code.shape[1] else 1)
    code = language.codewords(12)
    assert min((code[i] != code[j]).sum() for i in range(12) for j in range(i)) >= code.shape[1] // 4


def test_few_languages_and_none(corpus, empty):
    one = corpus.where("lang = 'aa'")
    got = {r.lang_pred for r in language.identify(one, language.fit(one), [F.col("doc_id")]).collect()}
    assert got == {"aa", "und"}
    assert language.fit(empty) is None
    assert {r.lang_pred for r in language.identify(one, None, [F.col("doc_id")]).collect()} == {"und"}
    assert language.identify(empty, language.fit(one), [F.col("doc_id")]).count() == 0


def test_sample_is_of_documents_not_rows(spark):
    rows = [(k, text("aa", 30, k), "aa") for k in range(40)] + [(k + 100, text("bb", 30, k), "zz") for k in range(40)]
    rows += [(0, text("aa", 30, 0), "aa")] * 5000 + [(1, f"ka {k}", "aa") for k in range(50)]
    got = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)).groupBy("lang").agg(F.count("*").alias("n")).collect()
    held = [sum(spark.range(40).select(language.held_out(F.col("id") + at).alias("h")).toPandas()["h"]) for at in (0, 100)]
    assert {r.lang: r.n for r in got} == {"aa": 40 - held[0], "zz": 40 - held[1]}


def test_texts_between_two_languages_are_ambiguous_and_long_ones_are_read_whole(spark, corpus):
    model = language.fit(corpus)
    rows = [(0, text("aa", 400, 1) + " " + text("bb", 20_000, 2)), (1, text("bb", 30, 3))] + [(2 + k, "zq xj wv"[: 2 + k]) for k in range(4)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model, [F.col("doc_id")]).collect()}
    assert got[0].lang_pred == got[1].lang_pred == "bb" and not got[1].ambiguous
    assert all(r.ambiguous == (r.score < language.AMBIGUOUS_BELOW) for r in got.values())
    # equal losses: the language that comes first, with an even share
    even = language.Model(("x", "y"), np.array([[1.0], [-1.0]], np.float32), model.table, np.zeros(1, np.float32), np.ones(1, np.float32), 1.0)
    best, share = language.decode(even, np.zeros((3, 1)))
    assert best.tolist() == [0, 0, 0] and np.allclose(share, 0.5)
