"""Mixing sources to target weights by prefix sums in a random order.

Every document gets a hash-random key. Within its source, documents are sorted by ranges of that key, and prefix sums of
their sizes come from one total per range plus a running sum inside the range, so a source with a third of all rows is
spread over many tasks. A source is taken as many whole times as fit in its target; the rest of the target is a cut in
the prefix sums: documents before the cut are taken once more, and the document on the cut with the words that are left,
so that the taken words of a source equal its target rounded to a word.

Targets share the total size by weight; a source above three times its size stops there and the excess is shared again
among the others by weight, until none is above. Only three sums per pass reach the driver.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, last in the order;
repeated rows are separate documents; an empty table gives an empty table; other columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import bucket_bits, load, prefix_before, text_of, words_of
from cellweave.operators.scale import global_row_number
from cellweave.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS
) -> DataFrame:
    """(source, source_size, target) from (source, size) rows; sources weigh ``weights`` in turn, by code point."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_row_number(per_source, [F.col("source").isNull(), F.col("source")], "rank")
    weight = F.get(F.lit(list(weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int"))
    table = cut_lineage(ranked.withColumn("weight", weight.cast("double")).drop("rank"))
    most = most_epochs * F.col("source_size")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full_before = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * level > most
        full, held, open_weight = table.agg(
            F.count_if(above), F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if full == full_before or not open_weight:
            break
        full_before = full
        level = (total - (held or 0)) / open_weight
    return table.select("source", "source_size", F.least(most, F.col("weight") * float(level or 0.0)).cast("double").alias("target"))


def mix_sources(
    docs: DataFrame,
    size: str,
    source: str = "source",
    ties: tuple[str, ...] = ("doc_id",),
    weights: tuple[int, ...] = WEIGHTS,
    most_epochs: int = MOST_EPOCHS,
) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken`` (words the mix takes of the document, repeats counted).

    ``docs`` must not have columns of these names; callers put the rows they carry into one struct column.
    """
    key, mark, before = "_key", "_mark", "_before"
    targets = source_targets(docs.select(F.col(source).alias("source"), F.col(size).alias("size")), weights, most_epochs)
    marked = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    targets = targets.select(marked.alias(mark), "source_size", "target")
    keyed = docs.withColumn(key, F.xxhash64(*ties, F.lit("mix"))).withColumn(
        mark, F.struct(F.col(source).isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))
    )
    summed = prefix_before(keyed, [mark], key, [*ties, size], size, before, bucket_bits(docs))
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - epochs * F.col("source_size")
    once_more = F.greatest(F.lit(0), F.least(F.col(size), rest - F.col(before)))
    return (
        summed.join(targets, mark)
        .withColumn("taken", (epochs * F.col(size) + once_more).cast("bigint"))
        .drop(key, mark, before)
    )


def mixed_documents(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", n_chars: str = "n_chars"
) -> DataFrame:
    """The documents of the mix with their columns: one row per whole time taken, and one row cut to the words left.

    At most one document of each source is cut.
    """
    boxed = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.xxhash64(text_of(text)).alias("text_key"),
        word_count(text_of(text)).alias("size"),
    )
    mixed = mix_sources(boxed, "size", ties=("doc_id", "text_key")).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = F.pmod("taken", "size")
    copies = F.concat(
        F.array_repeat(F.col("size"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>"))
    )
    taken = mixed.select("row", "size", F.explode(copies).alias("words"))
    head = F.array_join(F.slice(words_of(F.col("row")[text]), F.lit(1), F.col("words").cast("int")), " ")
    cut = F.when(F.col("words") < F.col("size"), head).otherwise(F.col("row")[text])
    columns = {c: F.col("row")[c] for c in docs.columns} | {text: F.col("cut")}
    if n_chars in columns:
        columns[n_chars] = F.char_length("cut").cast(docs.schema[n_chars].dataType)
    return taken.select("row", cut.alias("cut")).select(*[v.alias(c) for c, v in columns.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count(text_of("text")).alias("size"), F.xxhash64(text_of("text")).alias("text_key")
    )
    mixed = mix_sources(cut_lineage(docs), "size", ties=("doc_id", "text_key"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
