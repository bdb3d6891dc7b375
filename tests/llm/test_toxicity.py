import zlib

import numpy as np

from cellweave.llm import toxicity as X


def test_clause_kinds():
    lex = X.Lexicon({"idiot": 4.0})

    def f(t):
        return X.features(t, lex)[:4]

    assert f("this idiot went home") == [4.0, 0, 0, 0]
    assert f("you are an idiot") == [0, 4.0, 0, 0]
    assert f("an idiot. you went home") == [4.0, 0, 0, 0]
    assert f("you are not an idiot") == [0, 0, 0, 4.0]
    assert f("not one two three four five idiot") == [4.0, 0, 0, 0]
    assert f("they said idiot and idiots") == [0, 0, 0, 8.0]
    assert f("i will kill you") == [0, 0, 3.0, 0]
    assert f("kill the lights") == [0, 0, 1.5, 0]
    assert f(None) == f("") == f("no insult, no threat") == [0, 0, 0, 0]
    assert f("IDIOT! idiotic; idiocy") == [8.0, 0, 0, 0]


def test_forgetting_words_keeps_the_clauses(monkeypatch):
    text = "they said idiot. one two three four\nan idiot! you went; idiot: five six? seven idiots. you idiot"
    whole = X.features(text, X.Lexicon({"idiot": 4.0}))
    assert whole[:4] == [12.0, 4.0, 0, 4.0]
    for memory in (0, 1, 2, 3, 5, 8):
        monkeypatch.setattr(X, "MEMORY", memory)
        lex = X.Lexicon({"idiot": 4.0})
        # the second reading starts from what the first one left behind
        assert X.features(text, lex) == X.features(text, lex) == whole


def test_composition_moves_all_parts():
    g = X.GRAMMAR
    s = g.step(g.step(g.start, X.NEGATION), X.OTHER)
    assert s == (0, 0, 0, X.SHIELDED_WORDS - 1, 0)
    assert g.step(s, X.TARGET) == (0, 0, 1, X.SHIELDED_WORDS - 2, 0)


def test_logistic_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    y = (x[:, 0] > 0).astype(float)
    w, b = X.fit_logistic(x, y)
    assert ((x @ w + b > 0) == y).mean() > 0.97


def test_held_out_accuracy_on_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = X.query(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right >= 0.9
    everything = got.collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in everything)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in everything)
    assert len(everything) == 1000


def test_held_out_labels_are_not_used(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 9 + ("idiot" if i % 3 == 0 else "fine")) for i in range(120)], "doc_id bigint, text string")
    labels = [(i, int(i % 3 == 0)) for i in range(120)]
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]
    a, b = (X.train(docs, spark.createDataFrame(v, "doc_id bigint, toxic int")) for v in (labels, flipped))
    assert a == b and any("idiot".startswith(s) for s in a.stems)


def test_without_labels_the_fixed_lists_are_used(spark):
    docs = spark.createDataFrame([(1, "you idiot", "s"), (None, None, "s"), (2, "", None), (2, "", None)], "doc_id bigint, text string, _score string")
    empty = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert X.train(docs, empty) == X.DEFAULT
    kept = X.drop_toxic(docs, empty)
    assert kept.columns == docs.columns and len(kept.collect()) == 3
    scored = X.score_texts(docs, X.DEFAULT).collect()
    assert [r.score >= 0.5 for r in scored] == [True, False, False, False]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id bigint, toxic int")
    assert X.drop_toxic(docs, labels).collect() == []
