"""Document fingerprints by spot signatures.

A signature is an anchor (a common word) with the chain of the next content words behind it; the fingerprint of a text
is the set of its signatures. Fingerprints are alike by the Jaccard coefficient of their sets, computed only where the
set lengths can reach the likeness asked for: sets are partitioned by length so that sets that can be alike lie in the
same or in neighbouring partitions.

Anchors are the words of a fixed list in four languages; every sixteenth content word by hash is an anchor too, so
texts in other languages or without function words have signatures as well, and the beginning of a text is one. A text
without any chain is one signature of its own, an empty text has none.

Defined results: a null text is an empty text; two empty fingerprints are alike by 1, an empty and another one by 0;
rows that repeat are ordered by id, then by hash of the text; a null id comes before all others; a table with one row
is its own next document; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import count_not_above, load, text_of, values_of
from cellweave.operators.scale import parallelism

CHAIN = 3
SAMPLED = 16
MEMORY = 200_000
#: Common words of English, German, French and Spanish that open a signature.
ANCHORS = frozenset(
    """
    a about after all also an and are as at be been but by can do for from had has have he her his if in into is it its
    more no not of on one or other she so such than that the their there they this to was we were what when which who
    will with would you
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer er es
    für hat ich ihr im in ist kann mit nach nicht noch nur oder sich sie sind so über um und von vor war wenn wie wird
    wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou où par
    pas plus pour qu que qui sa se ses son sont sur tu un une vous
    al como con de del el ella en entre era es esta este ha hay la las le lo los más me mi muy no o para pero por que
    se si sin sobre su sus también un una y ya
    """.split()
)
_WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class _Hashes(dict):
    """Hash of a word, its lowest bit set for anchors; kept for a bounded number of words per worker process."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        h = h | 1 if word in ANCHORS or (h >> 8) % SAMPLED == 0 else h & ~1
        if len(self) > MEMORY:
            self.clear()
        self[word] = h
        return h


_HASHES = _Hashes()


def signatures(text: str | None, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct signatures of a text, as 48-bit numbers."""
    text = text or ""
    if not text:
        return np.empty(0, dtype=np.uint64)
    words = _WORD.findall(text.lower())
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    is_anchor = (h & np.uint64(1)).astype(bool)
    # sampled content words open a signature and are links of other chains as well
    listed = np.fromiter((w in ANCHORS for w in words), dtype=bool, count=len(words))
    content = np.flatnonzero(~listed)
    if not len(content):
        return np.array([_number(text)], dtype=np.uint64)
    anchors = np.r_[-1, np.flatnonzero(is_anchor)]
    opening = np.r_[np.uint64(1), h[is_anchor]]
    first = np.searchsorted(content, anchors, side="right")
    has = first < len(content)
    first, opening = first[has], opening[has]
    links = np.r_[h[content], np.zeros(chain, dtype=np.uint64)]
    with np.errstate(over="ignore"):
        total = opening * _MIX[0]
        for k in range(chain):
            total = (total ^ (total >> np.uint64(29))) * _MIX[1] + links[first + k] * _MIX[2] + _MIX[3]
        total = (total ^ (total >> np.uint64(32))) * _MIX[1]
    return np.unique(total >> np.uint64(16))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:6], "big")


def as_string(found: np.ndarray) -> str:
    """Eight base64 characters per signature, in ascending order."""
    octets = found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return base64.b64encode(octets.tobytes()).decode("ascii")


def from_string(fingerprint: str) -> np.ndarray:
    octets = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, 6).astype(np.uint64)
    weights = np.array([1 << (8 * i) for i in range(5, -1, -1)], dtype=np.uint64)
    return octets @ weights


def length_partition(n: int, floor: float) -> int:
    """Partition of a set length; sets alike by ``floor`` or more lie at most one partition apart."""
    return 0 if n == 0 else 1 + int(np.floor(np.log(n) / -np.log(floor) + 1e-9))


def pruned_jaccard(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard coefficient of two sorted sets; 0 without a comparison where the lengths cannot reach ``floor``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < floor * max(len(a), len(b)):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    value = common / (len(a) + len(b) - common)
    return value if value >= floor else 0.0


def edited_text(text: str, following: str) -> str:
    """The last quarter of a text replaced by as many code points (or all) of the beginning of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


# -- each document and the next one ---------------------------------------------------------------------------------


def _neighbours(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) in buckets of ascending ids, each bucket closed by a copy of the row that follows it.

    Bucket limits are sketched quantiles of the ids. Only one id per bucket reaches the driver.
    """
    n = 4 * parallelism(docs)
    limits = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    bucket = F.coalesce(count_not_above(F.lit(sorted(set(limits))), F.col("doc_id")), F.lit(0)) if limits else F.lit(0)
    rows = docs.withColumn("bucket", bucket)
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id"))["doc_id"]
    heads = sorted((r.bucket, r.head) for r in rows.groupBy("bucket").agg(least.alias("head")).collect())
    if not heads:
        return rows.withColumn("copied", F.lit(False))
    size = heads[-1][0] + 1
    head, before = [None] * size, [0] * size
    for k, (b, first) in enumerate(heads):
        head[b], before[b] = first, heads[k - 1][0]
    id_type = dict(docs.dtypes)["doc_id"]
    is_head = F.col("doc_id").eqNullSafe(F.get(F.lit(head).cast(f"array<{id_type}>"), F.col("bucket")))
    own = F.struct(F.col("bucket"), F.lit(False).alias("copied"))
    copy = F.struct(F.get(F.lit(before), F.col("bucket")).alias("bucket"), F.lit(True).alias("copied"))
    places = F.when(is_head, F.array(own, copy)).otherwise(F.array(own))
    return rows.select("doc_id", "text", F.inline(places))


_OUT = [
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
    ("n_signatures", pa.int64()),
]


def _fingerprint_rows(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows arrive in order; a row is finished when the row behind it is seen."""
    open_row = None
    names = ["doc_id", *(n for n, _ in _OUT)]
    types = [id_type, *(t for _, t in _OUT)]

    def close(row: tuple, following: str, next_prints: np.ndarray) -> tuple:
        _, doc_id, text, own = row
        changed = edited_text(text, following)
        prints = signatures(changed)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        likeness = pruned_jaccard(own, prints), pruned_jaccard(own, next_prints)
        return doc_id, len(text), sha, as_string(own), as_string(prints), *likeness, len(own)

    for b in batches:
        done = []
        for bucket, copied, doc_id, text in zip(*(values_of(b, c) for c in ("bucket", "copied", "doc_id", "text"))):
            prints = signatures(text)
            if open_row is not None and open_row[0] == bucket:
                done.append(close(open_row, text, prints))
                open_row = None
            if not copied:
                open_row = (bucket, doc_id, text, prints)
            if len(done) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; one shuffle of the texts."""
    rows = _neighbours(docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")))
    ordered = rows.repartition("bucket").sortWithinPartitions(
        "bucket", "copied", F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    )
    id_type = dict(rows.dtypes)["doc_id"]
    schema = (
        f"doc_id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, n_signatures bigint"
    )
    from pyspark.sql.pandas.types import to_arrow_type

    return ordered.mapInArrow(partial(_fingerprint_rows, id_type=to_arrow_type(rows.schema["doc_id"].dataType)), schema)


# -- pairs of like documents ----------------------------------------------------------------------------------------


def similar_pairs(prints: DataFrame, floor: float = 0.8) -> DataFrame:
    """(a, b, likeness): pairs of distinct fingerprints alike by ``floor`` or more, a < b.

    Equal fingerprints are one row. Sets are partitioned by length; a pair is looked for in the same and the next
    partition, and only by the rarest signatures of each set (of n signatures, n - ceil(floor * n) + 1: two sets that
    are alike share at least one of these). Candidates are then compared by pruned Jaccard.
    """
    sets = prints.select("fingerprint").where("fingerprint <> ''").distinct()
    cut = F.transform(F.sequence(F.lit(0), F.char_length("fingerprint") - 8, F.lit(8)), lambda i: F.substring("fingerprint", i + 1, F.lit(8)))
    sized = sets.withColumn("sigs", cut).withColumn("n", F.size("sigs"))
    counts = sized.select(F.explode("sigs").alias("sig")).groupBy("sig").count()
    step = float(-np.log(floor))
    ranked = (
        sized.select("fingerprint", "n", F.explode("sigs").alias("sig"))
        .join(counts, "sig")
        .groupBy("fingerprint", "n")
        .agg(F.array_sort(F.collect_list(F.struct("count", "sig"))).alias("rare"))
        .withColumn("part", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9))
        .withColumn("keep", F.slice("rare", F.lit(1), (F.col("n") - F.ceil(F.col("n") * floor - 1e-9) + 1).cast("int")))
    )
    index = ranked.select("fingerprint", "n", "part", F.explode(F.col("keep.sig")).alias("sig"))
    left = index.select(F.col("fingerprint").alias("a"), F.col("n").alias("na"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), F.col("part").alias("pa"), "sig")
    right = index.select(F.col("fingerprint").alias("b"), F.col("n").alias("nb"), "part", "sig")
    pairs = (
        left.join(right, ["part", "sig"])
        .where((F.col("pa") < F.col("part")) | (F.col("a") < F.col("b")))
        .where(F.least("na", "nb") >= F.greatest("na", "nb") * (floor - 1e-9))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    likeness = F.pandas_udf(_likeness, "double")
    return pairs.withColumn("likeness", likeness("a", "b")).where(F.col("likeness") >= floor)


def _likeness(a, b):
    import pandas as pd

    return pd.Series([pruned_jaccard(from_string(x), from_string(y)) for x, y in zip(a, b)], dtype=float)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(load(spark, sf_dir, "documents"))
