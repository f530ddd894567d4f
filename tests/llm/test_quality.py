import re

from llm_texts import words

from tessera.llm import quality
from tessera.llm.quality import Rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def facts(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    again = {p for i, x in enumerate(windows) if windows.count(x) > 1 for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(again)


def test_facts(spark, docs):
    odd = "# $x |<>&*% ü 🙂 " + "a b c d e f g h i j " * 5 + "\n\n \nsame\nsame\n same"
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()] + [(70, odd, "s"), (71, "x " * 9, "s"), (72, words(30, 3) + " " + words(9, 4) + " q " + words(9, 4), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(df).collect()]
    assert sorted(got, key=repr) == sorted([(i, *facts(t)) for i, t, _ in rows], key=repr)


def test_common_lines_go_and_depleted_documents_too(spark):
    footer = "All  Rights RESERVED by the host of this page"
    rows = [(k, words(30, k) + "\n" + footer.replace("  ", " " * (1 + k % 2)), "a") for k in range(30)]
    rows += [(100 + k, "\n".join(["All rights reserved by the host of this page"] * 3) + f"\nword{k}", "a") for k in range(3)]
    rows += [(200 + k, words(30, 900 + k) + "\n" + footer, "b") for k in range(3)]  # not common in this host
    rows += [(300 + k, words(40, 77), "a") for k in range(40)]  # copies count once
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rules = Rules(min_words=5, host_texts=10, host_percent=10, max_repeat_percent=101)
    got = {r.doc_id: r for r in quality.judge(df, rules).collect()}
    assert all(got[k].n_common_words == 9 and got[k].kept for k in range(30))
    assert all(not got[100 + k].kept and not got[100 + k].base_failed for k in range(3))
    assert all(got[200 + k].n_common_words == 0 for k in range(3)) and all(got[300 + k].kept for k in range(40))
    out = {r.doc_id: r.text for r in quality.clean(df, rules).collect()}
    assert out[0] == words(30, 0) and out[200] == rows[33][1] and 100 not in out and len(out) == 73


def test_edges(docs, empty):
    verdicts = quality.judge(docs).collect()
    assert len(verdicts) == docs.count()
    assert all(not r.kept for r in verdicts if r.n_words < 20)
    out = quality.clean(docs)
    assert out.columns == docs.columns and sum(r.doc_id == 6 for r in out.collect()) == 2
    assert quality.judge(empty).count() == 0 and quality.clean(empty).count() == 0


def test_common_lines_go_from_hosts_of_any_size(spark):
    rows, want = [], {}
    # of 5, 50 and 5,000 texts: a line in all, in just more than the limit, and in just as many as the limit
    for host, size, limit in (("a", 5, 3), ("b", 50, 5), ("c", 5000, 353)):
        for k in range(size):
            shared = ["in all texts of the host"] + ["in a few too many"] * (k <= limit) + ["in few enough"] * (k < limit)
            own = f"{host}{k} " + " ".join(f"w{(k * 31 + j) % 9973}x{j}" for j in range(24))
            rows.append((len(rows), "\n".join([own, *shared]), host))
            want[rows[-1][0]] = "\n".join([own] + ["in few enough"] * (k < limit))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.text for r in quality.clean(df).collect()} == want


def test_copies_count_if_asked_to(spark):
    rows = [(k, words(40, 77) + "\n" + words(30, 78), "a") for k in range(30)] + [(100 + k, words(40, k), "a") for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    of = lambda copies: {r.doc_id: r.kept for r in quality.judge(df, Rules(host_texts=10, count_copies=copies)).collect()}
    assert all(of(False).values()) and of(True) == {k: k >= 100 for k, _, _ in rows}


def test_the_query_s_own_rules_reject_a_depleted_document(spark, tmp_path):
    """Texts that are mostly a shared line go, whose base facts are good; those with more of their own stay."""
    shared = words(30, 500)
    rows = [(k, shared + "\n" + words(10, k), "a", "x") for k in range(6)] + [(100 + k, shared + "\n" + words(60, 100 + k), "a", "x") for k in range(6)] + [(200 + k, words(40, 200 + k), "a", "x") for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in quality.op8_quality_rules(spark, str(tmp_path)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {k: r.kept for k, r in got.items()} == {k: k >= 100 for k, *_ in rows}
    assert {k: r.n_common_words for k, r in got.items()} == {k: 30 if k < 200 else 0 for k, *_ in rows}
