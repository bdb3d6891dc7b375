import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave.llm import spotsigs as S


def test_signatures_are_chains_behind_anchors():
    a = S.signatures("alpha the beta gamma delta epsilon")
    b = S.signatures("omega the beta gamma delta epsilon")
    assert len(np.intersect1d(a, b)) >= 1 and not np.array_equal(a, b)
    assert len(S.signatures("")) == len(S.signatures(None)) == 0
    assert len(S.signatures("!!!")) == len(S.signatures("the of and")) == 1
    assert S.as_string(S.signatures("The Beta")) == S.as_string(S.signatures("the beta"))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300))
def test_strings_hold_the_set(text):
    found = S.signatures(text)
    assert np.array_equal(S.from_string(S.as_string(found)), found)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 60), max_size=40), st.sets(st.integers(0, 60), max_size=40))
def test_pruned_jaccard_against_sets(a, b):
    x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
    want = len(a & b) / len(a | b) if a and b else float(len(a) == len(b))
    assert S.pruned_jaccard(x, y) == want
    assert S.pruned_jaccard(x, y, 0.8) == (want if want >= 0.8 else 0.0)
    if a and b and want >= 0.8:
        assert abs(S.length_partition(len(a), 0.8) - S.length_partition(len(b), 0.8)) <= 1


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        own, e, x = (S.signatures(v) for v in (t, edited, nxt))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), S.as_string(own), S.as_string(e), S.pruned_jaccard(own, e), S.pruned_jaccard(own, x)))
    return out


def result(df):
    got = S.fingerprint_documents(df).drop("n_signatures").collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[0] is not None, r[0] or 0))


def test_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert result(docs.repartition(7)) == want
    near = [w[5] for w in want]
    assert sum(x > 0.3 for x in near) > 0.9 * len(near)


def test_nulls_one_row_ties_and_empty_table(spark):
    schema = "doc_id bigint, text string"
    for rows in ([(1, "a b c d e f g h")], [(None, "x y z w"), (3, None), (5, ""), (9, "the quick brown fox " * 400)]):
        assert result(spark.createDataFrame(rows, schema)) == brute(rows)
    tied = [(4, "same text here"), (4, "same text here"), (4, "same text here"), (5, "more of it")]
    assert result(spark.createDataFrame(tied, schema)) == brute(tied)
    assert result(spark.createDataFrame([], schema)) == []
    clash = spark.createDataFrame([(1, "a b", 2, True)], schema + ", bucket int, copied boolean")
    assert len(result(clash)) == 1


def test_similar_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [rng.choice(2**40, 40, replace=False) for _ in range(12)]
    sets = []
    for b in base:
        for k in range(6):
            s = np.concatenate([b[k:], rng.choice(2**40, rng.integers(0, 6))])
            sets.append(np.unique(s.astype(np.uint64)))
    strings = [S.as_string(s) for s in sets]
    df = spark.createDataFrame([(s,) for s in strings + strings[:5] + [""]], "fingerprint string")
    got = {(r.a, r.b): r.likeness for r in S.similar_pairs(df).collect()}
    want = {}
    for i, a in enumerate(strings):
        for j in range(i):
            v = S.pruned_jaccard(sets[i], sets[j])
            if v >= 0.8 and a != strings[j]:
                want[min(a, strings[j]), max(a, strings[j])] = v
    assert got == want and want
