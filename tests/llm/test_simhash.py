import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cellweave.llm import simhash as S

SCHEMA = "doc_id bigint, text string"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=4):
    prints = [(i, brute_print(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    ids = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            ids[root(i)] = min(ids.get(root(i), rows[i][0]), rows[i][0])
    return sorted((str(prints[i][0]), f"{prints[i][1]:016x}", str(ids.get(root(i)))) for i in range(len(rows)))


def result(spark, rows, **kw):
    got = S.near_duplicates(spark.createDataFrame(rows, SCHEMA), **kw)
    return sorted(
        (str(r.doc_id), r.fp, str(r.component_id)) for r in got.select("doc_id", S.hex_of().alias("fp"), "component_id").collect()
    )


def test_fingerprint_is_that_of_spark_hashes(spark):
    texts = ["", "one", "One TWO three", "a b c d", "Straße  GRÖSSE\tß \x0b x y z", "w " * 50, None]
    for t in texts:
        assert S.fingerprint(t) == brute_print(t)
    row = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first()
    assert S.fingerprint("a b c d") == row.h % 2**64


def test_groups_against_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert result(spark, rows) == brute_components(rows)


def test_tiles_of_one_band_value_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    values = {base ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(400)}
    values |= {int(v) for v in rng.integers(0, 2**63, 300)}
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint bigint")
    parent = {v: v for v in signed}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    want = {v: root(v) for v in signed}
    for tile in (16, 2048):
        found = S.links(df, tile=tile)
        assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in found.collect())
        got = {v: v for v in signed} | {r.node: r.root for r in S.components(found).collect()}
        assert got == want


def test_nulls_repeats_and_empty_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "x y"), (5, "x y"), (5, "x y"), (None, "only null"), (7, "q " * 3000)]
    assert result(spark, rows) == brute_components(rows)


def test_empty_table(spark):
    assert result(spark, []) == []
    assert S.drop_near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_document_of_each_group_stays_with_its_columns(spark):
    rows = [(3, "a b c d e", 1, "k"), (2, "A b c d e", 2, "k"), (2, "A b c d e", 2, "k"), (9, "f g h i j", 3, None), (None, "f g h i j", 4, "k")]
    schema = "doc_id bigint, text string, _text_key int, _kept_id string"
    got = S.drop_near_duplicates(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "_text_key", "_kept_id"]
    assert sorted(tuple(r)[:3] for r in got.collect()) == [(2, "A b c d e", 2), (9, "f g h i j", 3)]


@pytest.mark.parametrize("radius", [1, 4, 7])
def test_bands_cover_all_bits(radius):
    edges = S.band_edges(radius)
    assert sum(w for _, w in edges) == 64 and len(edges) == radius + 1
