from tessera.llm import lines

from llm_texts import words


def chunks(text):
    """The chunks by the rule, one line at a time."""
    import hashlib

    h = [hashlib.md5(x.encode()).hexdigest() for x in text.split("\n")]
    may = [int(hashlib.md5(((h[i - 1] if i else "") + h[i]).encode()).hexdigest()[:7], 16) % lines.DIVISOR == 0 for i in range(len(h))]
    long = [len(x.split()) >= lines.LONG_WORDS for x in text.split("\n")]
    out = []
    for i, x in enumerate(text.split("\n")):
        if i == 0 or (may[i - 1] and not (i > 1 and may[i - 2])) or long[i] or long[i - 1]:
            out.append([])
        out[-1].append(x)
    return ["\n".join(c) for c in out]


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        left = []
        for c in chunks(t):
            able = len(c.split()) >= lines.LONG_WORDS or (c.count("\n") >= 1 and c.split())
            if not (able and c in seen):
                left.append(c)
            if able:
                seen.add(c)
        out[i, t] = "\n".join(left)
    return out


def test_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = lines.dedup_lines(docs).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, ((i, None if t is None else want[i, t]) for i, t in rows)))


def test_passage_is_found_wherever_it_stands(spark):
    passage = "\n".join(words(12, 50 + k) for k in range(30))
    single = words(60, 99)
    rows = [(k, "\n".join(words(8, 1000 * k + j) for j in range(k + 1)) + "\n" + passage + "\n" + single + "\n" + words(9, 70 + k)) for k in range(6)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1]
    for k in range(1, 6):
        assert single not in got[k].text and got[k].n_removed_lines >= 20
        assert words(9, 70 + k) in got[k].text and words(8, 1000 * k) in got[k].text


def test_clean_keeps_columns_and_drops_what_is_used_up(docs, empty):
    out = lines.clean(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 4 in ids and 2 in ids and 1 in ids and 6 not in ids
    assert out.where("doc_id = 10 and n_chars = length(text)").count() == 1
    assert lines.clean(empty).count() == 0 and lines.dedup_lines(empty).count() == 0


def lines_by_brute_force(rows):
    """What clean() leaves: for each pair of places all runs of equal lines, blank ones left out, word by word."""
    docs = sorted({(i, t) for i, t in rows})
    numbered = [[(k, x) for k, x in enumerate(t.split("\n")) if x.split()] for _, t in docs]
    out = []
    for d, (i, t) in enumerate(docs):
        gone, mine = set(), numbered[d]
        for e in range(d + 1):
            for a in range(len(mine)):
                for b in range(len(numbered[e]) if e < d else a):
                    for n in range(1, min(len(mine) - a, len(numbered[e]) - b, *([a - b] if e == d else [99])) + 1):
                        if mine[a + n - 1][1] != numbered[e][b + n - 1][1]:
                            break
                        if sum(len(x.split()) for _, x in mine[a : a + n]) >= lines.LONG_WORDS:
                            gone |= set(range(mine[a][0], mine[a + n - 1][0] + 1))
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if left.strip() or not gone:
            out.append((i, left))
    return out


def test_clean_takes_whole_passages_of_short_lines(spark):
    passage = "\n".join(words(9, 50 + k) for k in range(6))
    rows = [(k, "\n".join(words(8, 1000 * k + j) for j in range(k + 1)) + "\n" + passage + "\n" + words(9, 70 + k)) for k in range(8)]
    got = {r.doc_id: r.text for r in lines.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: t if k == 0 else t.replace(passage + "\n", "") for k, t in rows}


def test_clean_against_brute_force(spark):
    import random

    r = random.Random(5)
    pool = [words(r.choice((1, 5, 12, 24, 55)), 300 + k) for k in range(14)] + ["", " "]
    rows = [(k, "\n".join(pool[(s + j) % 16] if r.random() < 0.93 else words(3, 10 * k + j) for s in [r.randrange(16)] for j in range(r.randrange(1, 20)))) for k in range(40)]
    rows += [(50, "\n".join(["la la"] * 120)), (51, "\n".join(["x"] * 49)), (52, "\n".join(["x"] * 49)), (53, "\n\n")]
    got = lines.clean(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == lines_by_brute_force(rows)


def test_clean_keeps_short_lines_that_many_documents_share(spark):
    shared = ["Contents\n", "Hello\nMr Brown", "\n".join(words(7, 40 + k) for k in range(7))]
    rows = [(k, f"{words(9, k)}\n" + f"\n{words(9, 90 + k)}\n".join(shared)) for k in range(6)] + [(10 + k, "Hello\nMr Brown") for k in range(3)]
    got = lines.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows


def test_the_pipelines_stage_cuts_by_the_operators_chunks(spark, monkeypatch):
    """Runs of chunks are looked for first and hold most of a passage; the check of lines adds their ends."""
    import corpus_pipeline

    passage = [words(12, 50 + k) for k in range(40)]
    rows = [(k, "\n".join([words(8, 1000 * k + j) for j in range(k + 1)] + passage + [words(9, 70 + k)])) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut, chunked = [], lines.with_chunks
    monkeypatch.setattr(lines, "with_chunks", lambda rows: cut.append(1) or chunked(rows))
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert cut and got == {k: t if k == 0 else t.replace("\n".join(passage) + "\n", "") for k, t in rows}
    by_chunks = {r.doc_id: {i for s in r.spans for i in range(s.start, s.end + 1)} for r in lines.repeated_runs(df).collect()}
    assert set(by_chunks) == {1, 2, 3, 4, 5}
    for k, gone in by_chunks.items():
        assert len(gone) > 25 and gone <= set(range(k + 1, k + 41))
