import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellweave.llm import tokens as K
from cellweave.llm.vocabulary import SegmentCounts

PATH = str(public_tokenizers.path(K.TOKENIZER))
LIBRARY = Tokenizer.from_file(PATH)


def count(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def test_counts_of_documents_are_those_of_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), count(r.text)) for r in docs)
    got = K.query(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZ  ..,'s\n\t\x0b\x1c\xa0　é1<|>"), st.characters(codec="utf-8")), max_size=40))
def test_segments_add_up_on_any_text(text):
    assert SegmentCounts.shared(PATH).count([text]) == [count(text)]


def test_huge_documents_are_spliced(spark):
    texts = [
        "some words, and more of them. " * 200,
        "x" * 3000,
        "word " * 50 + "y" * 900 + " tail" * 200,
        "  \n\n  spaces   everywhere \n" * 150,
        "日本語" * 700,
        "a <|endoftext|> b" * 200,
        " " * 2500,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for chunk, overlap in ((100, 10), (333, 40), (1000, 5)):
        got = {r.doc_id: r.n_tokens for r in K.token_counts(df, PATH, chunk, overlap).collect()}
        assert got == {i: count(t) for i, t in enumerate(texts)}


def test_a_cut_without_a_proven_place_is_reported():
    offsets = LIBRARY.encode("x" * 200, add_special_tokens=False).offsets
    assert K.splice("x" * 200, offsets, True, False, 100) is None
    text = "some words here and there " * 10
    n = K.splice(text, LIBRARY.encode(text, add_special_tokens=False).offsets, True, True, 100)
    assert n == count(text)


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, 1, "r"), (None, "", 2, "r"), (2, "a b", 3, "r"), (2, "a b", 3, "r"), (None, "long " * 100, 4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes int, row string")
    got = sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens) for r in K.token_counts(df, PATH, 100, 10).collect())
    assert got == sorted(((i or -1), len(t or ""), count(t)) for i, t, _, _ in rows)


def test_empty_table(spark):
    assert K.token_counts(spark.createDataFrame([], "doc_id bigint, text string"), PATH).collect() == []
