"""Best-fit packing of token pieces into sequences by exact-complement hashing.

Documents become token ids inside tasks; only documents longer than a sequence are cut. Packing needs nothing but the
histogram of piece lengths, which has at most ``capacity`` entries for any corpus. The plan is made on that histogram:
single, pair and triple sums of lengths are indexed, and combinations that fill the gap beside a long piece exactly are
consumed as often as the remaining counts allow; what is left is placed by best fit, longest first. The plan is a short
list of recipes ("k sequences of these lengths"); pieces find their place by their rank among the pieces of their
length, by one join with the recipe ranges. Ranks come from counts per (length, hash bucket), so a length with a third
of all pieces is spread over many tasks.

Defined results: a null text is an empty text and gives one piece with the end id alone; repeated rows give repeated
pieces, each with a place of its own; an empty table gives an empty table; other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import bucket_bits, bucket_of, count_not_above, load
from cellweave.llm.vocabulary import WordIds
from cellweave.session import cut_lineage

CAPACITY = 2_048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"

# -- token pieces ---------------------------------------------------------------------------------------------------


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of every document and the end id, cut into pieces.

    ``ids`` is binary, little-endian unsigned 32-bit numbers.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    run = partial(_pieces, tokenizer=tokenizer, capacity=capacity)
    return rows.mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids binary")


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int) -> Iterator[pa.RecordBatch]:
    vocabulary = WordIds.shared(tokenizer)
    names = ["doc_id", "piece", "start", "length", "ids"]
    end, step = END_ID.to_bytes(4, "little"), 4 * capacity
    for b in batches:
        doc_ids = b.column("doc_id")
        for lo in range(0, b.num_rows, 256):
            row, piece, start, length, ids = [], [], [], [], []
            encoded = vocabulary.encode(b.column("text").slice(lo, 256).to_pylist())
            for i, got in enumerate(encoded):
                got += end
                for k, at in enumerate(range(0, len(got), step)):
                    part = got[at : at + step]
                    row.append(lo + i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
            columns = [
                doc_ids.take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(ids, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


# -- plan on the histogram ------------------------------------------------------------------------------------------


@dataclass
class Recipe:
    """``times`` sequences, each made of these lengths."""

    times: int
    lengths: list[int]


class _Sums:
    """Index of single, pair and triple sums of the lengths that are still available."""

    def __init__(self, counts: np.ndarray):
        self.left = counts

    def single(self, gap: int) -> list[tuple[int, ...]]:
        return [(gap,)] if self.left[gap] else []

    def pairs(self, gap: int) -> list[tuple[int, ...]]:
        """Available (a, b) with a + b = gap and a >= b, most uneven first, so that small lengths go with large ones."""
        small = np.arange(1, gap // 2 + 1)
        good = small[(self.left[small] > 0) & (self.left[gap - small] > 0)]
        return [(gap - int(b), int(b)) for b in good if gap - b != b or self.left[b] > 1]

    def triples(self, gap: int) -> Iterator[tuple[int, ...]]:
        """Available (a, b, c) with a + b + c = gap and a >= b >= c, longest a first."""
        for a in np.flatnonzero(self.left[: gap - 1])[::-1]:
            if 3 * a < gap:
                break
            rest = gap - int(a)
            b = np.arange((rest + 1) // 2, min(int(a), rest - 1) + 1)
            for found in b[(self.left[b] > 0) & (self.left[rest - b] > 0)]:
                yield int(a), int(found), rest - int(found)


def _take(left: np.ndarray, lengths: list[int]) -> int:
    """Take the combination as often as the counts allow."""
    need: dict[int, int] = defaultdict(int)
    for n in lengths:
        need[n] += 1
    times = min(int(left[n]) // k for n, k in need.items())
    if times:
        for n, k in need.items():
            left[n] -= times * k
    return times


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Recipe]:
    """Recipes that use every piece of the histogram exactly once. Work and memory depend on ``capacity`` only."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in histogram.items():
        if not 0 < n <= capacity:
            raise ValueError(f"length {n} does not fit a sequence of {capacity}")
        left[n] = k
    recipes: list[Recipe] = []
    if left[capacity]:
        recipes.append(Recipe(int(left[capacity]), [capacity]))
        left[capacity] = 0
    sums = _Sums(left)
    # exact complements, longest piece first
    for long in range(capacity - 1, 0, -1):
        for find in (sums.single, sums.pairs, sums.triples):
            for option in find(capacity - long) if left[long] else ():
                times = _take(left, [long, *option])
                if times:
                    recipes.append(Recipe(times, [long, *option]))
                if not left[long]:
                    break
    recipes += _best_fit(left, capacity)
    return recipes


def _best_fit(left: np.ndarray, capacity: int) -> list[Recipe]:
    """Longest first; equal pieces go together into the open sequences with the smallest gap that holds one."""
    by_gap: dict[int, list[Recipe]] = defaultdict(list)
    open_gaps = np.zeros(capacity + 1, dtype=bool)

    def put(recipe: Recipe, gap: int) -> None:
        by_gap[gap].append(recipe)
        open_gaps[gap] = True

    for n in range(capacity, 0, -1):
        rest = int(left[n])
        while rest:
            fits = np.flatnonzero(open_gaps[n:])
            if len(fits):
                gap = n + int(fits[0])
                recipe = by_gap[gap].pop()
                open_gaps[gap] = bool(by_gap[gap])
                times = min(rest, recipe.times)
                if times < recipe.times:
                    put(Recipe(recipe.times - times, recipe.lengths), gap)
                put(Recipe(times, [*recipe.lengths, n]), gap - n)
                rest -= times
            else:
                each = min(capacity // n, rest)
                times = rest // each
                put(Recipe(times, [n] * each), capacity - n * each)
                rest -= times * each
        left[n] = 0
    return [r for group in by_gap.values() for r in group]


# -- placing --------------------------------------------------------------------------------------------------------


def ranges(recipes: list[Recipe]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, sequence, per sequence, offset): where the ranks of each length go."""
    next_rank: dict[int, int] = defaultdict(int)
    sequence, rows = 0, []
    for r in recipes:
        offset = 0
        per = {n: r.lengths.count(n) for n in dict.fromkeys(r.lengths)}
        for n, k in per.items():
            rows.append((n, next_rank[n], k * r.times, sequence, k, offset))
            next_rank[n] += k * r.times
            offset += n * k
        sequence += r.times
    return rows


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, ties: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces with a ``length`` column.

    Pieces are ranked within their length: rows are dealt to buckets by a hash of ``ties``, one count per
    (length, bucket) gives each bucket its first rank. The ranges of the recipes are at most a few per length.
    """
    spark = pieces.sparkSession
    bits = bucket_bits(pieces)
    keyed = pieces.withColumn("_bucket", bucket_of(F.xxhash64(*ties), bits))
    counts = keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    rows = ranges(plan(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_bucket").orderBy(*[c for c in pieces.columns if c not in ("length", "ids")])
    ranked = keyed.join(starts, ["length", "_bucket"]).withColumn(
        "_rank", F.col("_start") + F.row_number().over(inside) - 1
    )
    schema = "length bigint, ranges array<struct<first bigint, ranks bigint, sequence bigint, per bigint, at bigint>>"
    by_length: dict[int, list[tuple]] = defaultdict(list)
    for n, *rest in rows:
        by_length[n].append(tuple(rest))
    table = spark.createDataFrame(list(by_length.items()), schema)
    # ranges of one length are in the order of their first rank
    found = ranked.join(F.broadcast(table), "length").withColumn(
        "_range", F.get("ranges", count_not_above(F.col("ranges.first"), F.col("_rank")) - 1)
    )
    inner = F.col("_rank") - F.col("_range.first")
    return (
        found.withColumn("sequence_id", F.col("_range.sequence") + F.floor(inner / F.col("_range.per")))
        .withColumn("offset", F.col("_range.at") + F.pmod(inner, F.col("_range.per")) * F.col("length"))
        .select(*pieces.columns, F.col("sequence_id").cast("bigint"), F.col("offset").cast("bigint"))
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their checksum and their place; the stored table of pieces carries the checksum of the ids."""
    pieces = token_pieces(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return best_fit_pack(cut_lineage(pieces), capacity)


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, ids as one binary value per sequence."""
    packed = best_fit_pack(cut_lineage(token_pieces(docs, tokenizer, capacity)), capacity)
    parts = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    return parts.select("sequence_id", "length", joined.alias("ids"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(load(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
