import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return sha(*("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in manifest.FIELDS))


def fold(nodes):
    """The levels of a tree, the leaves' first, by plain lists."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        begin = i - i % 8
        out.append(("".join(level[begin:i]), "".join(level[i + 1 : begin + 8])))
        i //= 8
    return out


def expected(rows):
    """(doc_id, leaf, subroot, root, the sides of each step) for each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(((r.doc_id is not None, r.doc_id or 0), leaf(r), r.doc_id))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: fold([x[1] for x in sorted(groups[g])]) for g in names}
    over = fold([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, own, doc_id) in enumerate(sorted(groups[g])):
            out.append((doc_id, own, trees[g][-1][0], over[-1][0], tuple(siblings(trees[g], i) + siblings(over, k))))
    return sorted(out, key=repr)


def built(docs, claim=None):
    own = manifest.leaf({c: F.col(c) for c in manifest.FIELDS})
    return manifest.manifest(docs, own, claim if claim is not None else own)


def check(docs):
    got = built(docs).collect()
    assert all(r.verified and r.folded_root == r.root for r in got)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.l, s.r) for s in r.steps)) for r in got), key=repr) == expected(docs.collect())


def test_odd_rows(docs):
    check(docs)


@pytest.mark.parametrize("n", [1, 9, 64, 513])
def test_sizes_at_which_levels_begin(spark, n):
    check(spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 7 < 6, F.lit("é")).alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(1).alias("n_chars")))


def test_scattered_negative_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(manifest, "COPIES_AT_ONCE", 3)
    ids = [*range(-70, 700, 3), -(2**62), 2**62, 2**62 + 1, None, None, None, 5, 5, 5, 5, 5, 5, 5, 5, 63, 64, 64]
    rows = [(i, f"text {i} {k % 3 if i in (None, 5) else ''}", "a" if (i or 0) % 2 else None, "s", 3) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    check(docs)
    monkeypatch.setattr(manifest, "BROADCAST_BYTES", -1)
    check(docs)


def test_many_groups(spark):
    check(spark.range(400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") > 0, F.concat(F.lit("l"), (F.col("id") % 150).cast("string"))).alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars")))


def test_a_changed_row_does_not_verify_and_others_do(docs):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    wrong = manifest.leaf({c: (F.when(F.col("doc_id") == 3, F.lower("text")).otherwise(F.col("text")) if c == "text" else F.col(c)) for c in manifest.FIELDS})
    upper = rows.withColumn("text", F.upper("text"))
    got = built(upper, wrong).collect()
    assert {r.doc_id for r in got if not r.verified} == {3}


def test_empty_table(empty):
    assert built(empty).count() == 0 and built(empty).columns == ["doc_id", "leaf", "subroot", "root", "steps", "folded_root", "verified"]
