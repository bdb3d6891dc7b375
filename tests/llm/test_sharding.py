import zlib
from collections import defaultdict

from cellweave.llm import sharding as S


def check(rows, texts, shards, slack):
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in rows) == sorted(
        str((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for i, t in texts
    )
    sizes, slots = [0] * shards, defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes) - min(sizes) <= slack
    return sizes


def test_shards_of_documents(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = S.query(spark, sf_dir).collect()
    largest = max(len((t or "").encode()) + 16 for _, t in texts)
    sizes = check(rows, texts, S.SHARDS, 2.5 * largest)
    assert {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows) and len(sizes) == 40


def test_a_third_of_equal_rows_is_spread(spark):
    texts = [(i, "the same text") for i in range(300)] + [(1000 + i, f"text number {i:04d}") for i in range(600)]
    rows = S.shard_documents(spark.createDataFrame(texts, "doc_id bigint, text string"), 10).collect()
    check(rows, texts, 10, 120)
    hot = {r.shard for r in rows if r.text_crc32 == zlib.crc32(b"the same text")}
    assert 3 <= len(hot) <= 5


def test_small_groups_stay_together(spark):
    texts = [(k, f"copy {k % 400}") for k in range(1600)]
    rows = S.shard_documents(spark.createDataFrame(texts, "doc_id bigint, text string"), 8).collect()
    shards = defaultdict(set)
    for r in rows:
        shards[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
    check(rows, texts, 8, 250)


def test_nulls_repeats_and_empty_table(spark):
    texts = [(None, None), (None, None), (1, ""), (1, ""), (2, "x" * 5000), (3, "y")]
    check(S.shard_documents(spark.createDataFrame(texts, "doc_id bigint, text string"), 3).collect(), texts, 3, 10_000)
    assert S.shard_documents(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_written_shards_hold_all_rows_in_slot_order(spark, tmp_path):
    rows = [(i, f"text {i}" * (i % 9), i, "s") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard bigint, slot string")
    S.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.shard, r.slot) for r in back.collect()) == sorted(rows)
    assert back.select("shard_").distinct().count() == 4 and len(back.inputFiles()) == 4
