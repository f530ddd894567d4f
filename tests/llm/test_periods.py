import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from llm_texts import words as made_up

from tessera.llm import periods


def brute(words, min_words=24, min_times=3):
    """All stretches with a period, one period after the other; the smallest of a stretch is its own."""
    n, found = len(words), {}
    for q in range(1, n // min_times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(min_words, min_times * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(r):
    out = []
    for _ in range(r.randrange(1, 5)):
        out += [b"%d" % r.randrange(r.randrange(1, 4)) for _ in range(r.randrange(1, 9))] * r.randrange(1, 14)
        out += [b"%d" % r.randrange(5) for _ in range(r.randrange(4))]
    return out


def test_runs_are_those_of_a_plain_search():
    r = random.Random(7)
    for _ in range(600):
        words = repetitive(r)
        assert periods.runs(words) == brute(words)
        assert periods.runs(words, 6, 2) == brute(words, 6, 2)
    assert periods.runs([]) == [] and periods.runs([b"a"] * 23) == [] and periods.runs([b"a"] * 24) == [(0, 24, 1)]


def test_long_texts_of_few_words():
    assert periods.runs([b"a"] * 50_000) == [(0, 50_000, 1)]
    found = periods.runs(([b"x"] * 30 + [b"y"]) * 1000)
    assert found[:2] == [(0, 30, 1), (0, 31_000, 31)] and len(found) == 1001


def test_suffix_array():
    r = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        ids = r.integers(0, 2, n)
        order, shared = periods.suffix_array(ids)
        tails = [tuple(ids[i:]) for i in order]
        assert tails == sorted(tails)
        for k in range(1, n):
            a, b = tails[k - 1], tails[k]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_no_words_in_a_row_are_overlooked():
    r = random.Random(1)
    for _ in range(200):
        words = repetitive(r)
        twice = any(words[i : i + 16] == words[j : j + 16] for i in range(len(words) - 15) for j in range(i))
        assert periods._may_repeat(words, 16) or not twice


def sha(b):
    return hashlib.sha256(b).hexdigest()


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    one = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *one, sha(lines.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_a_plain_search(spark, docs, tmp_path):
    r = random.Random(4)
    texts = [(100 + k, made_up(r.randrange(1, 160), k)) for k in range(120)] + [(300 + k, b" \n".join(repetitive(r)).decode()) for k in range(60)] + [(400, "é x " * 40), (401, "a\x0bb\x0cc\x1cd " * 30)]
    rows = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i, t, "a") for i, t in texts], "doc_id long, text string, lang string"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = periods.op13_period_runs(spark, str(tmp_path))
    want = [expected(x.doc_id, x.text) for x in rows.collect()]
    assert sum(w[1] > 0 for w in want) > 40
    assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(spark, empty):
    assert periods.periodic_runs(empty).count() == 0 and periods.periodic_runs(periods.planted(empty)).count() == 0
