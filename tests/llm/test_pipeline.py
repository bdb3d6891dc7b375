from collections import Counter

import corpus_pipeline as C
import test_mixing
import test_packing
import test_quality
import test_simhash

from cellweave.llm import packing, toxicity


def test_every_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stage = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality rules", "simhash near-duplicates", "source mix", "best-fit packing"]

    clean = stage["toxicity"](spark, docs, sf_dir)
    model = toxicity.train(docs, labels)
    lexicon = toxicity.lexicon_of(model.stems)
    kept = [r for r in docs.collect() if model.score(toxicity.features(r.text, lexicon)) < 0.5]
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect())) == sorted(map(tuple, kept))

    good = stage["quality rules"](spark, spark.createDataFrame(kept, docs.schema), sf_dir)
    kept = [r for r in kept if test_quality.brute(r.text)[-1]]
    assert good.columns == docs.columns and sorted(map(tuple, good.collect())) == sorted(map(tuple, kept))

    one = stage["simhash near-duplicates"](spark, spark.createDataFrame(kept, docs.schema), sf_dir)
    groups = test_simhash.brute_components([(r.doc_id, r.text) for r in kept])
    first = {int(c) for _, _, c in groups}
    kept = [r for r in kept if r.doc_id in first]
    assert one.columns == docs.columns and sorted(map(tuple, one.collect())) == sorted(map(tuple, kept))

    mixed = stage["source mix"](spark, spark.createDataFrame(kept, docs.schema), sf_dir)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    sizes, taken = Counter(), Counter()
    for r in kept:
        sizes[r.source] += len(r.text.split())
    for r in rows:
        taken[r.source] += len(r.text.split())
    want = test_mixing.targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)

    packed = stage["best-fit packing"](spark, spark.createDataFrame(rows, docs.schema), sf_dir).collect()
    test_packing.check_packed(packed, [(r.doc_id, r.text) for r in rows], packing.CAPACITY)


def test_run_gives_packed_pieces(spark, sf_dir):
    got = C.run(spark, sf_dir).collect()
    assert len(got) > 50 and all(0 < r.length <= packing.CAPACITY for r in got)


def test_stages_take_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 0")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.collect() == []
