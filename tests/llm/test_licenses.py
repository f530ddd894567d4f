import re

from pyspark.sql import functions as F

from tessera.llm import licenses
from tessera.llm.licenses import TEMPLATES

WORD = re.compile(licenses.WORD)


def brute(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for n, t in enumerate(TEMPLATES):
        key, full = t.phrase(), t.tokens()
        for i in range(len(w) - len(key) + 1):
            if w[i : i + len(key)] == key:
                start = i - t.key_at()
                same = sum(0 <= start + k < len(w) and w[start + k] == x for k, x in enumerate(full))
                found.append((n, i, round(same / len(full), 9)))
    return len(w), sorted(found)


def test_against_brute_force(spark, docs, empty):
    texts = [
        "Under the MIT License. under-the mit/license under the mit", "APACHE license, Version 2.0; Apache License version 2 apache license version 2 2",
        "CC BY-NC 4.0 and cc by cc by nc nc", "x Permission is hereby granted, free of charge, to any person obtaining a copy of THIS software", "permission is hereby granted free of charge to all",
        "GNU General Public License, version 3", "ÜNDER the mit license é", "redistribution and use in source and binary forms", "mit license under the",
        "You may not use this file except in compliance with the License.", "the the the under under the mit license license",
    ]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + list(enumerate(texts, 500))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, sorted((m.template, m.start, round(m.coverage, 9)) for m in r.matches)) for r in licenses.scan(df).collect()]
    assert sorted(got, key=repr) == sorted([(i, *brute(t)) for i, t in rows], key=repr)
    assert licenses.scan(empty).count() == 0


def test_anchor_is_the_rarest_word(spark):
    df = spark.createDataFrame([(k, "mit license of the house") for k in range(20)] + [(99, "under")], "doc_id long, text string")
    idf = licenses.rarity(df)
    first = licenses.postings(idf)[0]
    assert first["word"] == "under" and idf["under"] > idf["mit"]


def test_words_are_the_matches_of_the_pattern(spark):
    texts = ["".join(map(chr, range(300))), "Ä-B_c  d\x00e\u00a0f\u2028g 🙂h 1.2", "", "!!", None, "é ÉA"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(licenses.licence_words(F.col("text")).alias("w")).collect()
    for t, r in zip(texts, got):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        assert r.w == re.findall(licenses.WORD, lower)
