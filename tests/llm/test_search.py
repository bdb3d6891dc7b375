import math
import random
import re
from collections import Counter

from compare import compare, connect

from cellweave.llm import search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=50):
    """Every item with its best documents, score by score."""
    parsed = [(i, Counter(terms(t))) for i, t in docs]
    parsed = [(i, c) for i, c in parsed if c]
    big_n, length = len(parsed), sum(sum(c.values()) for _, c in parsed)
    df = Counter(t for _, c in parsed for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        scored = []
        for doc, c in parsed:
            m = 50 + 50 * sum(c.values()) * big_n // length
            score = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in own
                if c[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if x else d, -s) for r, (s, x, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def result(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in S.search(d, i, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def made(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "Éa", "éa", "x1", "naïve", "a", "ab", "abc", "b", "語", "don", "t", "zebra", " gap"] + [f"w{k}" for k in range(60)]
    gaps = [" ", ", ", "'", "\n", "--", "\x00", "\x7f", " ( "]
    return [(k, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(0, 60)))) for k in range(n)]


def test_against_brute_force(spark):
    docs, items = made(1, 400), made(2, 30)
    assert result(spark, docs, items) == brute(docs, items)
    assert result(spark, docs, items, top=3) == brute(docs, items, 3)


def test_blocks_of_items(spark):
    docs, items = made(3, 120), made(4, 20)
    assert result(spark, docs, items, block_terms=25) == brute(docs, items)


def test_documents(spark, sf_dir):
    problems = compare(S.query(spark, sf_dir), connect(sf_dir), S.SQL)[1]
    assert not problems
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    have = sorted((tuple(r) for r in S.query(spark, sf_dir).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert have == brute(docs, items)


def test_nulls_ties_repeats_and_empty_tables(spark):
    docs = [(5, "cat dog"), (5, "cat dog"), (None, "dog cat"), (None, None), (3, ""), (4, "..."), (1, "Dog CAT"), (2, "cow " * 4000 + "cat")]
    items = [(1, "cat"), (1, "dog"), (2, ""), (None, "cow"), (3, None), (4, "catdog ca og")]
    assert result(spark, docs, items) == brute(docs, items)
    assert result(spark, [], items) == result(spark, docs, []) == []
    d = spark.createDataFrame([(1, "a cat", 9, "x")], "doc_id bigint, text string, score int, terms string")
    i = spark.createDataFrame([(1, "cat", 7, "y")], "item_id bigint, text string, doc_id int, rank string")
    assert [(r.item_id, r.rank, r.doc_id) for r in S.search(d, i).collect()] == [(1, 1, 1)]


def test_many_documents_of_equal_score(spark):
    docs = [(k, "the same words") for k in range(6000)] + [(9000 + k, "other text") for k in range(3000)]
    have = result(spark, docs, [(1, "same"), (2, "words the")])
    assert [(r[0], r[1], r[2]) for r in sorted(have, key=lambda r: r[:2])] == [(i, k + 1, k) for i in (1, 2) for k in range(50)]


def test_one_scan_counts_whole_terms_only():
    found = S.scan_text(S.automaton_of(["ab", "b", "語"]), "ab AB b abb.b 語 語語 xab".encode())
    assert found == (8, {0: 2, 1: 2, 2: 1})
