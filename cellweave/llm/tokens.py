"""Token counts of whole documents, with overlap resynchronisation for huge ones.

A document up to ``chunk`` code points is counted where it lies. A longer one is cut into chunks that overlap the next
chunk, the chunks are dealt to all tasks, and each is encoded with offsets. The counts are spliced at the first stable
place of each overlap: a blank or line end behind a character that is no white space (there no token can go across and
no rule looks back), which must also be a token boundary in the encoding on either side. A document with an overlap
that has no such place is done again with the overlap doubled, up to the whole document.

Defined results: a null or empty text has no bytes and no tokens; a null doc_id is kept; repeated rows are counted each;
an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import load, text_of
from cellweave.llm.vocabulary import SegmentCounts
from cellweave.session import cut_lineage

TOKENIZER = "byte_bpe_50k.json"
CHUNK = 50_000
OVERLAP = 1_000
LIMIT = 1_024
_STABLE = re.compile(r"(?<=[!-~])(?=[ \t\n\r])")


def _count_whole(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    counter = SegmentCounts.shared(tokenizer)
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            n = counter.count(part.column("text").to_pylist())
            columns = [part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])


def splice(text: str, offsets: list[tuple[int, int]], first: bool, last: bool, nominal: int) -> int | None:
    """Tokens of one chunk between its own splice place and the next chunk's, or None if there is no proven place.

    The chunk begins at its nominal cut; the next nominal cut is ``nominal`` code points later.
    """
    at = np.array([s for s, _ in offsets], dtype=np.int64)
    ends = np.array([e for _, e in offsets], dtype=np.int64)

    def place(since: int) -> int | None:
        # the first candidate behind the cut, the same on both sides of it, and a token boundary
        found = _STABLE.search(text, since + 1)
        if found is None or not np.any(at == found.start()) or np.any((at < found.start()) & (ends > found.start())):
            return None
        return found.start()

    begin = 0 if first else place(0)
    end = len(text) if last else place(nominal)
    if begin is None or end is None or end < begin:
        return None
    return int(np.count_nonzero((at >= begin) & (at < end)))


def _count_chunks(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    counter = SegmentCounts.shared(tokenizer)
    for b in batches:
        got = []
        rows = zip(*(b.column(c).to_pylist() for c in ("text", "is_first", "is_last", "nominal")))
        for text, first, last, nominal in rows:
            got.append(splice(text, counter.starts(text), first, last, nominal))
        columns = [b.column("row"), pa.array(got, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "n"])


def count_huge(huge: DataFrame, tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(row, n_tokens) of a stored table (row, text, n_chars) whose texts are longer than a chunk."""
    done = None
    left = huge
    while True:
        # the last chunk has one to two lengths, so that it is never too short to hold a place
        pieces = F.greatest(F.lit(1), F.floor(F.col("n_chars") / F.lit(chunk)).cast("int"))
        whole = F.col("n_chars") <= F.lit(overlap)
        cut = left.withColumn("pieces", F.when(whole, F.lit(1)).otherwise(pieces)).withColumn(
            "k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
        )
        is_last = F.col("k") == F.col("pieces") - 1
        length = F.when(is_last, F.col("n_chars")).otherwise(F.lit(chunk + overlap))
        chunks = cut.select(
            "row",
            "k",
            F.substring("text", F.col("k") * chunk + 1, length.cast("int")).alias("text"),
            (F.col("k") == 0).alias("is_first"),
            is_last.alias("is_last"),
            F.lit(chunk).alias("nominal"),
        ).repartition("row", "k")
        counted = chunks.mapInArrow(partial(_count_chunks, tokenizer=tokenizer), "row bigint, n bigint")
        sums = cut_lineage(
            counted.groupBy("row").agg(F.sum("n").alias("n_tokens"), F.count_if(F.col("n").isNull()).alias("open"))
        )
        closed = sums.where("open = 0").select("row", "n_tokens")
        done = closed if done is None else done.unionByName(closed)
        rest = sums.where("open > 0").select("row")
        if rest.isEmpty():
            return done
        overlap *= 2
        left = left.join(rest, "row", "left_semi")


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, as the tokenizers library counts whole texts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    id_type = dict(rows.dtypes)["doc_id"]
    n_chars = F.char_length("text")
    small = rows.where(n_chars <= chunk).mapInArrow(
        partial(_count_whole, tokenizer=tokenizer), f"doc_id {id_type}, n_bytes bigint, n_tokens bigint"
    )
    huge = cut_lineage(
        rows.where(n_chars > chunk).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "n_bytes", "text", n_chars.alias("n_chars")
        )
    )
    if huge.isEmpty():
        return small
    counted = count_huge(huge.select("row", "text", "n_chars"), tokenizer, chunk, overlap)
    return small.unionByName(huge.select("row", "doc_id", "n_bytes").join(counted, "row").drop("row"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(load(spark, sf_dir, "documents"), os.fspath(public_tokenizers.path(TOKENIZER)))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
