import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellweave.llm import packing as P
from cellweave.llm.vocabulary import WordIds

PATH = P.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
TRICKY = [
    None, "", " ", "Thor, ran. it's 12,5 ... ), (x). FOO", "<|endoftext|> <|ENDOFTEXT|>, a<|startoftext|>b", "H̱a Á K İ ΣΣ",
    "a\x0bb\x1cc\xa0d　e f", "tab\there\r\nline\n\n", "Über-Größe, „quoted.“ ».,« ñandú.", "x" * 5000, "日本語のテキスト。", "😀,😀. a️,",
]


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def ids_of(text):
    return np.frombuffer(WordIds.shared(PATH).encode([text])[0], dtype="<u4").tolist()


def test_word_by_word_ids_are_those_of_whole_texts(spark, sf_dir):
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for t in TRICKY + docs:
        assert ids_of(t) == LIBRARY.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAzZ .,'!<|>\n\t\x0b\xa0̱́éßΣ1"), st.characters(codec="utf-8")), max_size=40))
def test_word_by_word_ids_on_any_text(text):
    assert ids_of(text) == library(text)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=40))
def test_plan_uses_every_piece_once(histogram):
    used = Counter()
    for r in P.plan(histogram, 64):
        assert r.times > 0 and sum(r.lengths) <= 64
        for n in r.lengths:
            used[n] += r.times
    assert used == Counter(histogram)


def test_plan_fills_exactly_where_complements_exist():
    recipes = P.plan({60: 10, 4: 3, 3: 20, 1: 20, 2: 8, 5: 1}, 64)
    assert [sum(r.lengths) for r in recipes if 60 in r.lengths] == [64] * sum(60 in r.lengths for r in recipes)


def test_plan_is_near_the_lower_bound():
    rng = np.random.default_rng(1)
    histogram = Counter(np.clip(rng.lognormal(6, 0.8, 20_000).astype(int), 1, 2048).tolist())
    n = sum(r.times for r in P.plan(histogram))
    assert n <= math.ceil(sum(k * v for k, v in histogram.items()) / 2048) * 1.005 + 1


def check_packed(rows, texts, capacity):
    """Pieces against the library, sequences against the rules."""
    expected = Counter()
    for doc_id, text in texts:
        ids = library(text) + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected[doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for at in places.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_packed_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = P.query(spark, sf_dir).collect()
    n = check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()], P.CAPACITY)
    assert n <= math.ceil(sum(r.length for r in rows) / P.CAPACITY) * 1.02 + 1


def test_nulls_repeats_ties_and_clashing_names(spark):
    texts = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (None, None), (4, "word " * 300), (5, "x y z")]
    rows = [(i, t, 1, "x", 0) for i, t in texts]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length int, sequence_id string, _bucket int")
    check_packed(P.pack_documents(df, PATH, 64).collect(), texts, 64)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert P.pack_documents(df, PATH).collect() == []
    assert P.packed_sequences(df, PATH).collect() == []


def test_sequences_hold_the_ids_of_the_documents(spark):
    texts = [(i, f"word{i % 7} " * (i % 40)) for i in range(120)]
    got = P.packed_sequences(spark.createDataFrame(texts, "doc_id bigint, text string"), PATH, 64).collect()
    assert all(len(r.ids) == 4 * r.length <= 256 for r in got)
    have = Counter(np.frombuffer(b"".join(r.ids for r in got), "<u4").tolist())
    assert have == Counter(i for _, t in texts for i in library(t) + [0])


def test_a_piece_longer_than_a_sequence_is_refused():
    with pytest.raises(ValueError):
        P.plan({65: 1}, 64)
