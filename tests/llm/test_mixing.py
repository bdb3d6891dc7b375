from collections import defaultdict

import pytest

from cellweave.llm import mixing as M


def targets(sizes, weights=(5, 2, 1), most=3):
    """Water filling, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        open_weight = sum(weight[s] for s in order if s not in full)
        if not open_weight:
            break
        level = (total - sum(most * sizes[s] for s in full)) / open_weight
        above = {s for s in order if weight[s] * level > most * sizes[s]}
        if above == full:
            break
        full = above
    return {s: most * sizes[s] if s in full else weight[s] * level for s in order} if total else dict.fromkeys(order, 0.0)


def check(rows, texts):
    """rows: (doc_id, source, size, source_size, target, taken)."""
    sizes = defaultdict(int)
    for _, s, t in texts:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    taken = defaultdict(int)
    for _, s, size, source_size, target, n in rows:
        assert source_size == sizes[s] and target == pytest.approx(want[s]) and 0 <= n <= 3 * size
        taken[s] += n
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    return taken


def mixed(spark, texts):
    df = spark.createDataFrame(texts, "doc_id bigint, source string, text string").withColumn("size", M.word_count(M.text_of("text")))
    df = df.withColumn("key", M.F.xxhash64("text"))
    return [tuple(r) for r in M.mix_sources(df, "size", ties=("doc_id", "key")).select("doc_id", "source", "size", "source_size", "target", "taken").collect()]


def test_documents_against_brute_force_and_again(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    source = {r[0]: r[1] for r in texts}
    first, second = ([tuple(r) for r in M.query(spark, sf_dir).collect()] for _ in range(2))
    assert sorted(first) == sorted(second) and len(first) == len(texts)
    check([(i, source[i], *rest) for i, *rest in first], texts)


def test_small_sources_stop_at_three_epochs(spark):
    texts = [(i, "a", "one two three") for i in range(4)] + [(10 + i, "b", "w " * 50) for i in range(40)] + [(99, "c", "x " * 20)]
    rows = mixed(spark, texts)
    taken = check(rows, texts)
    assert taken["a"] == 36 and taken["c"] == 60
    assert all(n == 9 for _, s, _, _, _, n in rows if s == "a")


def test_nulls_repeats_and_a_hot_source(spark):
    texts = [(1, None, "a b c"), (1, None, "a b c"), (None, "s", None), (None, "s", ""), (2, "", "one"), (3, "t", None)]
    texts += [(100 + i, "hot", "word " * (i % 17)) for i in range(300)]
    rows = mixed(spark, texts)
    assert len(rows) == len(texts)
    check(rows, texts)


def test_empty_table_and_nothing_but_empty_texts(spark):
    assert mixed(spark, []) == []
    assert [r[3:] for r in mixed(spark, [(1, "a", ""), (2, "b", None)])] == [(0, 0.0, 0)] * 2


def test_mixed_documents_are_the_documents_taken(spark):
    texts = [(i, f"s{i % 4}", " ".join(f"w{i}_{k}" for k in range(i % 30))) for i in range(160)]
    df = spark.createDataFrame([(*t, len(t[2]), 1, 2) for t in texts], "doc_id bigint, source string, text string, n_chars bigint, target int, _key int")
    got = M.mixed_documents(df)
    assert got.columns == df.columns
    words = defaultdict(int)
    for r in got.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and texts[r.doc_id][2].startswith(r.text) and (r.target, r._key) == (1, 2)
    want = {r[0]: r[5] for r in mixed(spark, texts) if r[5]}
    assert dict(words) == want
