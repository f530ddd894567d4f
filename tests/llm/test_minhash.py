from collections import Counter

import numpy as np

from tessera.llm import minhash
from tessera.llm.graph import components

from llm_texts import edited, words


def shingles(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def jp(a, b):
    union = set(a) | set(b)
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in union) for i in a if i in b)


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_shingles_and_similarity_are_exact():
    texts = [words(50, 1), "", "a b", "é ü\tx\ny z", words(30, 2) + " " + words(30, 2), edited(words(50, 1), 20, 3), "a b"]
    owner, h, n = minhash.shingles(*flat(texts))
    for i, t in enumerate(texts):
        assert sorted(n[owner == i]) == sorted(shingles(t).values())
    part = lambda i: (h[owner == i], n[owner == i])
    for i, j in ((0, 5), (0, 4), (2, 6), (4, 4)):
        assert abs(minhash.similarity(part(i), part(j)) - jp(shingles(texts[i]), shingles(texts[j]))) < 1e-9


def test_signatures_estimate_the_probability_jaccard():
    base = words(120, 4)
    texts = [base + " " + words(40, 5) * 1, base + " " + words(60, 6), words(20, 7) + " " + base + " " + base]
    owner, h, n = minhash.shingles(*flat(texts))
    s = minhash.signatures(owner, h, n, 3, 4096)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert abs((s[i] == s[j]).mean() - jp(shingles(texts[i]), shingles(texts[j]))) < 0.04


def test_packed_signatures_count_equal_components(spark):
    params = minhash.Params()
    texts = [words(150, 1), edited(words(150, 1), 40, 2), words(150, 3), "", edited(words(150, 1), 12, 5)]
    _, packed = minhash.band_keys(*flat(texts), params)
    owner, h, n = minhash.shingles(*flat(texts))
    low = (minhash.signatures(owner, h, n, 5, params.size) >> np.uint64(17)) & np.uint64(255)
    pairs = [(packed[i].tolist(), packed[j].tolist(), int((low[i] == low[j]).sum())) for i in range(5) for j in range(5)]
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>, want int")
    assert df.where(minhash.agreeing("a", "b", params.size) != df["want"]).count() == 0


def brute(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = [None if t is None else shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if s[i] is not None and s[j] is not None and (rows[i][1] == rows[j][1] or jp(s[i], s[j]) >= 0.8):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(rows[i][0], ids[find(i)], len(groups[find(i)])) for i in range(len(rows))]


def test_classes_against_brute_force(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [(r.doc_id, r.class_id, r.class_size) for r in minhash.classes(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    assert minhash.classes(empty).count() == 0


def test_chains_and_stars_lose_no_link(spark):
    """A chain whose ends are unlike each other, copies with edits of one base, and texts that share half their words."""
    rows, base = [], words(300, 11).split()
    for k in range(12):
        rows.append((len(rows), " ".join(base)))
        base = base[:]
        base[k * 20 : k * 20 + 12] = words(12, 500 + k).split()
    star = words(200, 12)
    rows += [(len(rows) + k, edited(star, 45, 40 + k)) for k in range(25)] + [(90, star)]
    half = words(150, 13)
    rows += [(100 + k, half + " " + words(120, 60 + k)) for k in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in minhash.classes(df).collect())
    assert got == sorted(brute(rows))


def test_one_of_each_class_stays(docs, empty):
    out = minhash.representatives(docs)
    assert out.columns == docs.columns
    ids = sorted(((r.doc_id, r.text is None) for r in out.collect()), key=repr)
    assert ids == sorted([(0, False), (1, False), (2, True), (3, False), (4, False), (7, False), (None, False), (None, True), (8, False), (9, False), (10, False), (9007199254740993, False)], key=repr)
    assert minhash.representatives(empty).count() == 0


def test_components(spark):
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(0, 60)] + [("a", "b"), ("c", "b"), ("z", "z")] + [("hub", f"h{k}") for k in range(30)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {got[f"{i:04d}"] for i in range(61)} == {"0000"} and got["c"] == "a" and len({got[f"h{k}"] for k in range(30)} | {got["hub"]}) == 1


def test_a_large_group_of_copies_with_few_and_many_edits(spark):
    """Two bases that share words, each with copies of one to seven edits: most pairs are nearly similar enough."""
    import random

    r, rows = random.Random(5), []
    first = words(140, 21).split()
    second = first[:110] + words(30, 22).split()
    for base in (first, second):
        for k in range(70):
            copy = base[:]
            for at in r.sample(range(len(copy)), r.randrange(8)):
                copy[at] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in minhash.classes(df).collect())
    assert got == sorted(brute(rows))


def test_signatures_do_not_depend_on_the_other_texts_of_a_block():
    text, others = words(90, 31), [words(400, 40 + k) for k in range(150)]
    params = minhash.Params()
    alone, among = minhash.band_keys(*flat([text]), params)[0], minhash.band_keys(*flat([*others, text]), params)[0]
    assert (alone[0] == among[-1]).all()


def test_pairs_of_a_group_of_copies_with_many_edits_are_settled_by_counts(spark, monkeypatch):
    """Copies of one base that are nearly similar enough to each other: how many are compared must not grow with all pairs."""
    import random

    r, base, rows = random.Random(9), words(160, 71).split(), []
    for k in range(240):
        copy = base[:]
        for at in r.sample(range(len(copy)), 0 if k == 0 else r.choice((1, 2, 4, 5, 6))):
            copy[at] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    held = [set(shingles(t)) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(held[i] & held[j]) >= 0.8 * len(held[i] | held[j]) and comp[i] != comp[j]:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    compared, verified = [], minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda docs, pairs: compared.append(pairs.count()) or verified(docs, pairs))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in minhash.classes(df).collect()}
    assert got == dict(enumerate(comp)) and 20 < len(set(comp)) < 200
    assert sum(compared) < 5 * len(rows), compared


def test_counts_rule_out_no_link(spark):
    """Copies with edits, repeats and cuts; every pair with every third text as their head."""
    base = words(60, 81)
    texts = [base, base + " " + base, edited(base, 9, 1), edited(base, 25, 2), base[: len(base) // 2], base + " " + words(9, 82), edited(base, 25, 3) + " la" * 12, base + " la" * 9, edited(base + " " + base, 40, 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = {r.doc_id: bytes(r.node) for r in docs.select("doc_id", minhash._node().alias("node")).collect()}
    counts = {bytes(r.node): r for r in minhash._counts(docs, docs.select(minhash._node().alias("node"))).collect()}
    held = [shingles(t) for t in texts]
    for i, c in enumerate(held):
        told = counts[nodes[i]]
        assert (told.shingles, told.repeats, told.shared) == (len(c), sum(c.values()) - len(c), sum(any(s in o for j, o in enumerate(held) if j != i) for s in c))
    rows = []
    for head in range(len(texts)):
        of = lambda i: [[1 - jp(held[i], held[head])], [len(set(held[i]) & set(held[head]))], *counts[nodes[i]][1:]]
        rows += [(*of(i), *of(j), jp(held[i], held[j])) for i in range(len(texts)) for j in range(i) if head not in (i, j)]
    names = ["dist", "common", "shingles", "repeats", "shared"]
    kinds = ["array<double>", "array<long>", "long", "long", "long"]
    df = spark.createDataFrame(rows, ", ".join(f"{s}_{n} {k}" for s in "uv" for n, k in zip(names, kinds)) + ", like double")
    from pyspark.sql import functions as F

    out = df.select("like", minhash._unlike(lambda c: F.col(f"u_{c}"), lambda c: F.col(f"v_{c}"), 0.2 + 1e-12).alias("out")).collect()
    assert not [r for r in out if r.out and r.like >= 0.8] and any(r.like >= 0.8 for r in out) and any(r.out for r in out)


def test_a_worker_holds_little_beyond_a_batch_when_it_counts_shingles(spark, monkeypatch):
    """The function that ``_counts`` gives to Python workers, on a batch of some eight megabytes: texts, and one text."""
    import tracemalloc

    import pyarrow as pa

    docs, given = spark.createDataFrame([(words(9, 1),)], "text string"), []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: given.append(f) or plain(self, f, *a, **b))
    minhash._counts(docs, docs.select(minhash._node().alias("node")))
    text = words(1_000, 2)
    for texts, most in (([text] * 1_000, 60e6), ([" ".join([text] * 1_000)], 200e6)):
        batch = pa.RecordBatch.from_arrays([pa.array([b"n"] * len(texts)), pa.array(texts)], names=["node", "text"])
        tracemalloc.start()
        rows = list(given[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows[0].num_rows == len(texts) and rows[0]["shingles"][0].as_py() == (1_000 if len(texts) == 1 else 996)
        assert peak < most, peak


def test_pieces_and_blocks_change_no_shingle(monkeypatch):
    texts = [words(60, 3), "é" * 50 + " a b c d " + "z" * 200, "", "one two", "x" * 100_000 + " " + words(9, 4), " ", "x" * 99_999 + " " + words(9, 4)] + ["la " * k for k in range(20)]
    whole = minhash.shingles(*flat(texts))
    apart = [minhash.shingles(*flat([t])) for t in texts]
    for k, own in enumerate(apart):
        assert all((x[whole[0] == k] == y).all() for x, y in zip(whole[1:], own[1:]))
    assert len(set(apart[4][1].tolist()) - set(apart[6][1].tolist())) == 1  # the shingle with the long word
    for name, small in (("_PIECE_BYTES", 7), ("_BLOCK_TEXTS", 2), ("_BLOCK_BYTES", 300)):
        monkeypatch.setattr(minhash, name, small)
        assert all((x == y).all() for x, y in zip(minhash.shingles(*flat(texts)), whole))
        held, ends, repeats = minhash.distinct(*flat(texts))
        assert (held == whole[1]).all() and (np.diff(ends) == np.bincount(whole[0], minlength=len(texts))).all()
        assert [int(r) for r in repeats] == [int((own[2] - 1).sum()) for own in apart]
