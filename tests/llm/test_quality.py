import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.llm import quality as Q

SCHEMA = "doc_id bigint, text string"


def brute(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    n, chars, symbols, dup, rep = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)
    base = n < 20 or 100 * rep > 30 * n
    kept = not (base or 10 * symbols > n or 2 * dup > len(lines) or chars < 2 * n or chars > 14 * n)
    return n, chars, symbols, dup, len(lines), rep, base, kept


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in Q.quality_report(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    kept = {r.doc_id for r in Q.quality_rules(df).collect()}
    assert kept == {i for i, t in enumerate(texts) if brute(t)[-1]}


def test_measures_and_verdicts_on_hand_made_texts(spark):
    eight = "a b c d e f g h"
    check(spark, [
        None, "", " \n\t", "one", eight, f"{eight} {eight}", f"x {eight} y {eight} z", "a " * 7, "a " * 8, "a " * 9, "a " * 40,
        "l1 x\nl1 x\n\nl2\nl1 x\n \n", "# * $ % & | < > " * 4, "word " * 19 + "end", " ".join(f"w{i}" for i in range(20)),
        " ".join(f"w{i}" for i in range(5000)), "\x0bpage\x0cbreak\xa0joined \x1cfs", "Ünïcödé wörds " * 30, " ".join("x" * 20 for _ in range(25)),
        " ".join("ab"[i % 2] for i in range(60)), "😀 " * 30, "a\r\nb\r\na\r\n",
    ])


def test_documents_against_brute_force(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    check(spark, texts)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c d", "\n", "  "]), max_size=60).map(" ".join), min_size=1, max_size=20))
def test_repeated_windows_on_any_text(spark, texts):
    check(spark, texts)


def test_order_is_by_rejections_per_cost(spark):
    df = spark.createDataFrame([(i, "word " * (i % 30)) for i in range(200)], SCHEMA)
    found = Q.estimate_rules(df)
    assert [e.worth for e in found] == sorted((e.worth for e in found), reverse=True)
    assert {e.rule.name for e in found} == {r.name for r in Q.RULES}


def test_empty_table_and_clashing_names(spark):
    assert Q.quality_report(spark.createDataFrame([], SCHEMA)).collect() == []
    good = " ".join(f"word{i}" for i in range(30))
    df = spark.createDataFrame([(1, good, 5, "v"), (1, good, 5, "v"), (None, "bad", None, None)], "doc_id bigint, text string, _words int, _rejected_by string")
    kept = Q.quality_rules(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, good, 5, "v")] * 2
    assert Q.quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []


def test_main_path_is_free_of_python(spark):
    plan = Q.quality_rules(spark.createDataFrame([(1, "x")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
