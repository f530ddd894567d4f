"""Licence scan by a positional index of rare words.

Each licence template has a key phrase that must stand in the text word for word. Over the whole corpus
the words of the templates are counted by document; the rarest word of each key phrase is its anchor. A
text's anchor words are looked up in the postings (word, template, position), which gives the places
where each template could begin; the second rarest word must stand at its relative place too, then the
whole key phrase is verified. The score of a match is the share of the template's words at their places.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Template:
    """``words`` in order; ``key`` is the mandatory phrase, found among them. Base templates are their key alone."""

    label: str
    words: str
    key: str
    base: bool = False

    def tokens(self) -> list[str]:
        return self.words.split()

    def phrase(self) -> list[str]:
        return self.key.split()

    def key_at(self) -> int:
        w, k = self.tokens(), self.phrase()
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


#: The phrases that the contract names, and openings of common licence notices.
TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", "cc by nc", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "may not use this file except in compliance with the license"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
)


#: The ASCII characters that stand in no word, once A-Z are lower case.
_BREAKS = "".join(chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))


def licence_words(text: Column) -> Column:
    """The matches of ``WORD`` in the lower-cased text: all breaks become spaces, as splitting at one character is cheaper than a pattern."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def rarity(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """The IDF of each template word over all of ``docs``: at most as many rows as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.tokens()})
    held = docs.select(F.array_intersect(licence_words(F.col("text")), F.array(*map(F.lit, vocabulary))).alias("w"))
    counts = {r["word"]: r["n"] for r in held.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = docs.count()
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in vocabulary}


def postings(idf: dict[str, float], templates: tuple[Template, ...] = TEMPLATES) -> list[dict]:
    """One posting per template: its anchor and its second rarest word with their places in the key phrase."""
    out = []
    for n, t in enumerate(templates):
        ranked = sorted(range(len(t.phrase())), key=lambda i: (-idf[t.phrase()[i]], i))
        first, second = ranked[0], ranked[min(1, len(ranked) - 1)]
        # every place of the anchor word within the phrase leads to the same start, so one is enough
        out.append({"template": n, "word": t.phrase()[first], "at": first, "word2": t.phrase()[second], "at2": second})
    return out


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, and ``matches`` (template, start of its key phrase, coverage).

    A null or empty text has no words and no match; equal rows give equal results; an empty table gives
    no rows; words of any length are compared whole.
    """
    index = postings(rarity(docs, templates), templates)
    text = docs.select("doc_id", licence_words(F.col("text")).alias("w"))
    literal = F.array(
        *[
            F.struct(
                F.lit(p["template"]).alias("template"), F.lit(p["word"]).alias("word"), F.lit(p["at"]).alias("at"), F.lit(p["word2"]).alias("word2"), F.lit(p["at2"]).alias("at2"),
                F.array(*map(F.lit, templates[p["template"]].phrase())).alias("key"), F.lit(templates[p["template"]].key_at()).alias("key_at"),
                F.array(*map(F.lit, templates[p["template"]].tokens())).alias("words"), F.lit(templates[p["template"]].base).alias("base"), F.lit(templates[p["template"]].label).alias("label"),
            )
            for p in index
        ]
    )
    anchors = F.array(*[F.lit(w) for w in sorted({p["word"] for p in index})])
    hits = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(anchors, x["w"]))
    starts = F.flatten(
        F.transform(hits, lambda x: F.transform(F.filter(literal, lambda p: p["word"] == x["w"]), lambda p: F.struct(p.alias("p"), (x["i"] - p["at"]).alias("start"))))
    )
    near = F.filter(starts, lambda c: (c["start"] >= 0) & (F.get("w", c["start"] + c["p"]["at2"]) == c["p"]["word2"]))
    whole = F.filter(near, lambda c: F.slice("w", c["start"] + 1, F.size(c["p"]["key"])) == c["p"]["key"])
    found = text.select("doc_id", F.col("w"), F.size("w").cast("long").alias("n_words"), whole.alias("found"))
    there = lambda c: F.size(
        F.filter(F.transform(c["p"]["words"], lambda t, k: F.get("w", c["start"] - c["p"]["key_at"] + k) == t), lambda same: same)
    ) / F.size(c["p"]["words"])
    return found.select(
        "doc_id", "n_words",
        F.transform("found", lambda c: F.struct(c["p"]["template"].alias("template"), c["p"]["label"].alias("label"), c["p"]["base"].alias("base"), c["start"].cast("long").alias("start"), there(c).alias("coverage"))).alias("matches"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return scan(common.read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)), 6).alias("score"),
    )


def _rows_sql() -> str:
    lists = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    return ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {lists(t.tokens())}, {lists(t.phrase())}, {t.key_at()})" for n, t in enumerate(TEMPLATES))


OP5_SQL = rf"""
with tpl(n, label, base, words, key, key_at) as (values {_rows_sql()}),
d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORD}') as w from documents
), p as (
  select r, w, unnest(w) as x, generate_subscripts(w, 1) as i from d
), m as (
  select r, label, base, i - 1 as start,
         len(list_filter(range(1, len(words) + 1), lambda k: i - key_at + k - 1 >= 1 and w[i - key_at + k - 1] = words[k])) / len(words) as coverage
  from p join tpl on p.x = tpl.key[1] and p.w[i:i + len(key) - 1] = tpl.key
), g as (
  select r, count(*) filter (base) as n_base, min(start) filter (base) as first_word, max(start) filter (base) as last_word,
         string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(coverage) as score
  from m group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, round(coalesce(score, 0)::double, 6) as score
from d left join g using (r)
"""
