"""Ranked lexical search by scanning documents with one automaton of all item terms.

The terms of the items make up an Aho-Corasick automaton. Every term stands in it between two boundary characters, and
every run of characters that are no term characters counts as one boundary in the text, so an output is a whole term
and no word inside another one. One scan of a document gives its number of terms and the frequency of every item term;
there is no index of the documents. The outputs of the automaton map to the items that hold the term.

1. *Scan.* (id, terms, item terms found, their frequencies) of every document, stored in the shared folder.
2. *Statistics.* Documents and terms of the whole table, and documents per item term, from the stored rows.
3. *Scores.* Each task adds up the scores of its documents for all items in 64-bit integers and sends on its best
   ``TOP`` of every item; the best of those are ranked, first within hash slots and then per item.

Items go to the tasks in blocks of at most ``BLOCK_TERMS`` different terms (an item with more is a block of its own);
more blocks mean more scans, so the automaton and its maps have a size that does not grow with either table.

Defined results: a null or empty text has no terms and is never returned; rows of one item_id are one item with the
terms of all of its texts, null included; an item without terms, or without a document that scores, has no row; repeated
documents are ranked each for itself; a null doc_id stands after all others of the same score; texts are read whole,
whatever their length; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import load, text_of
from cellweave.session import cut_lineage

TOP = 50
#: Different item terms of one automaton.
BLOCK_TERMS = 50_000
#: Slots of the first ranking of an item.
SLOTS = 16
#: Terms are maximal runs of other characters.
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8: A-Z lower-cased, all ASCII that is no term character to a space, the others as they are.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_NO_ID = (1 << 63) - 1


def terms_of(text) -> F.Column:
    """Distinct terms of a text column."""
    return F.array_distinct(F.array_remove(F.split(F.translate(text_of(text), _UPPER, _LOWER), NO_TERM), ""))


def automaton_of(terms: list[str]) -> ahocorasick.Automaton:
    """Automaton over single bytes; a term's output is its number."""
    automaton = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        automaton.add_word(f" {term.encode().decode('latin-1')} ", number)
    automaton.make_automaton()
    return automaton


def scan_text(automaton: ahocorasick.Automaton, data: bytes) -> tuple[int, dict[int, int]]:
    """(number of terms, frequency by term number) of a text in UTF-8."""
    clean = b" " + data.translate(_BYTES) + b" "
    space = np.frombuffer(clean, np.uint8) == 32
    terms = int(np.count_nonzero(space[:-1] & ~space[1:]))
    if not terms or not len(automaton):
        return terms, {}
    return terms, Counter(map(itemgetter(1), automaton.iter(clean.decode("latin-1"))))


_SCANNED = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"


def scan_documents(docs: DataFrame, terms: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of every document with at least one term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(shared.value)
        for batch in batches:
            rows = []
            for n in range(batch.num_rows):
                data = batch.column("text")[n].as_buffer()
                size, found = scan_text(automaton, data.to_pybytes() if data is not None else b"")
                if size:
                    rows.append((batch.column("doc_id")[n].as_py(), size, list(found), list(found.values())))
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n", "terms", "counts"])

    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_of(text).alias("text"))
    return narrow.mapInArrow(run, _SCANNED)


def _best(item: np.ndarray, score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` best of every item."""
    order = np.lexsort((ids, -score, item))
    group = item[order]
    start = np.ones(len(order), bool)
    start[1:] = group[1:] != group[:-1]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[rank < top]


def _score(batches: Iterator[pa.RecordBatch], weight: np.ndarray, first: np.ndarray, items: np.ndarray, total: int, length: int, n_items: int, top: int):
    """Best documents of the task for every item. ``items[first[t]:first[t + 1]]`` hold term t."""
    kept = [np.zeros(0, np.int64)] * 3
    bar = np.ones(n_items, np.int64)

    def best() -> list[np.ndarray]:
        at = _best(*kept, top)
        return [k[at] for k in kept]

    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            batch = whole.slice(lo, 512)
            terms, counts = batch.column("terms"), batch.column("counts")
            sizes = np.diff(terms.offsets.to_numpy())
            term, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            n = batch.column("n").to_numpy()
            m = 50 + (50 * n * total) // length
            part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            many = first[term + 1] - first[term]
            at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[term], many)
            scores = np.zeros(batch.num_rows * n_items, np.int64)
            np.add.at(scores, np.repeat(doc, many) * n_items + items[at], np.repeat(part, many))
            doc, item = np.nonzero(scores.reshape(-1, n_items) >= bar)
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            kept = [np.concatenate(x) for x in zip(kept, (item, scores[doc * n_items + item], ids[doc]))]
            if len(kept[0]) > 4 * top * n_items:
                kept = best()
                full = np.bincount(kept[0], minlength=n_items) >= top
                worst = np.full(n_items, np.iinfo(np.int64).max)
                np.minimum.at(worst, kept[0], kept[1])
                bar = np.where(full, np.maximum(worst, 1), 1)
    item, score, ids = best()
    yield pa.RecordBatch.from_pydict({"item": pa.array(item.astype(np.int32)), "doc_id": pa.array(ids), "score": pa.array(score)})


def _ranked(docs: DataFrame, members: list[tuple], top: int, doc_id: str, text: str) -> DataFrame:
    """(item_id, rank, doc_id, score) of one block; ``members``: (item_id, terms)."""
    spark = docs.sparkSession
    terms = sorted({t for _, own in members for t in own})
    number = {t: i for i, t in enumerate(terms)}
    scanned = cut_lineage(scan_documents(docs, terms, doc_id, text))
    total, length = scanned.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = dict(scanned.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weight = [math.floor(1000 * math.log((2 * total + 2) / (2 * found.get(t, 0) + 1))) for t in range(len(terms))]
    pairs = sorted((number[t], i) for i, (_, own) in enumerate(members) for t in own)
    first = np.searchsorted([t for t, _ in pairs], np.arange(len(terms) + 1)).astype(np.int64)
    shared = spark.sparkContext.broadcast((np.array(weight, np.int64), first, np.array([i for _, i in pairs], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _score(batches, *shared.value, total, max(length, 1), len(members), top)

    scored = scanned.where(F.size("terms") > 0).mapInArrow(run, "item int, doc_id bigint, score bigint")
    scored = scored.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)))
    order = [F.desc("score"), F.asc("doc_id")]
    for keys in (["item", "slot"], ["item"]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(members)], "item int, item_id bigint")
    return scored.join(F.broadcast(names), "item").select(  # one row per item of the block
        "item_id", "rank", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "score"
    )


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item."""
    parsed = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.explode(terms_of(item_text)).alias("term")).distinct()
    sizes = parsed.groupBy("item_id").count()
    blocks, held = [[]], 0
    for row in sizes.orderBy("item_id").toLocalIterator():
        if blocks[-1] and held + row["count"] > block_terms:
            blocks.append([])
            held = 0
        blocks[-1].append(row["item_id"])
        held += row["count"]
    out = []
    for ids in blocks:
        if not ids:
            continue
        some = F.col("item_id").isNull() if ids[0] is None else F.lit(False)
        known = [i for i in ids if i is not None]
        mine = parsed.where(some | F.col("item_id").between(known[0], known[-1]) if known else some)
        rows = mine.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).orderBy("item_id").collect()
        out.append(_ranked(docs, [(r["item_id"], r["terms"]) for r in rows], top, doc_id, text))
    if not out:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


_TERMS = rf"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{NO_TERM}'), lambda t: t <> '')"""
SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
f AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, terms FROM d WHERE len(terms) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM f),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM f) WHERE term IN (SELECT term FROM i) GROUP BY 1, 2, 3),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY term, big_n),
p AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // l))) AS part FROM tf JOIN w USING (term), s),
t AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM i JOIN p USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM t WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}
"""
