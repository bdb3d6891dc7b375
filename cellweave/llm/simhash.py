"""Near-duplicates by SimHash with tiled exact comparison.

Texts are fingerprinted inside tasks (64 bits from the hashes of word shingles). Distinct fingerprints are laid out in
tiles and compared exactly: numpy exclusive-or and bit counts over a whole tile pair at once, and a tile pair whose
population counts differ by more than the radius is never formed, because the difference of the population counts
bounds the number of differing bits from below.

Tiles are cut inside bands: with a radius of r bits, two linked fingerprints agree in at least one of r + 1 bit ranges
(pigeonhole), so comparing within equal ranges finds every link without comparing all with all. A band value with few
fingerprints is one tile; one with many is cut by population count and by hash into tiles of bounded size, and its tile
pairs are compared by different tasks. A tile pair sends out a spanning forest of its links, never all links, so the
output is bounded by its rows and no link between different fingerprints is lost for the components.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; rows that repeat are rows
of the same component; a null doc_id is returned and can only name its component if the component has no other id; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import free_name, load, text_of, values_of
from cellweave.session import cut_lineage

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
TILE = 2_048

# -- fingerprints ---------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """SimHash of the XXH64 of all shingles of ``width`` words; fewer words are one shingle, no words give zero."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), dtype=np.uint64)
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        octets = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = SHINGLE_WORDS) -> DataFrame:
    """Replace the text column by its fingerprint, as a signed 64-bit number."""
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*kept, F.lit(0).cast("bigint").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t, width) for t in values_of(b, text)]
            column = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), column], names=[*kept, out])

    return docs.mapInArrow(run, schema)


# -- links ----------------------------------------------------------------------------------------------------------


def band_edges(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 bit ranges that cover 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def _forest(values: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links of one unit. Rows of side 0 meet rows of side 1, rows of side 2 meet all rows."""
    order = np.argsort(np.bitwise_count(values), kind="stable")
    values, side = values[order], side[order]
    counts = np.bitwise_count(values).astype(np.int64)
    label = np.arange(len(values))
    # end of the rows whose population count is within the radius
    ends = np.searchsorted(counts, counts + radius, side="right")
    found = []
    for lo in range(0, len(values), 256):
        hi = min(lo + 256, len(values))
        last = int(ends[hi - 1])
        near = np.bitwise_count(values[lo:hi, None] ^ values[None, lo:last]) <= radius
        near &= np.arange(lo, last)[None, :] > np.arange(lo, hi)[:, None]
        near &= (side[lo:hi, None] != side[None, lo:last]) | (side[lo:hi, None] == 2)
        for row in np.flatnonzero(near.any(axis=1)):
            i, partners = lo + int(row), lo + np.flatnonzero(near[row])
            for other in np.unique(label[partners]):
                if other != label[i]:
                    j = partners[np.argmax(label[partners] == other)]
                    found.append((int(values[i]), int(values[j])))
                    label[label == other] = label[i]
    return found


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by unit; a unit may go over several batches, its size is bounded by two tiles."""
    names = ["a", "b"]

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        arr = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(arr[:, 0]), pa.array(arr[:, 1])], names=names)

    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    for b in batches:
        unit, side, value = (b.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "side", "value"))
        value = value.view(np.uint64)
        if held is not None:
            unit, side, value = (np.concatenate(p) for p in zip(held, (unit, side, value)))
        starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.array([], dtype=np.int64)
        if not len(starts):
            continue
        pairs = []
        for lo, hi in zip(starts[:-1], starts[1:]):
            if hi - lo > 1:
                pairs += _forest(value[lo:hi], side[lo:hi], radius)
        held = tuple(x[starts[-1] :].copy() for x in (unit, side, value))
        if pairs:
            yield out(pairs)
    if held is not None and len(held[0]) > 1 and (pairs := _forest(held[2], held[1], radius)):
        yield out(pairs)


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, col: str = "fingerprint") -> DataFrame:
    """(a, b): links among distinct fingerprints, enough of them to connect all that are linked; a <> b."""
    values = prints.select(F.col(col).alias("value")).distinct()
    bands = F.array(
        *[
            F.struct(
                F.lit(i).alias("band"),
                F.shiftrightunsigned("value", lo).bitwiseAND(F.lit((1 << width) - 1)).alias("key"),
            )
            for i, (lo, width) in enumerate(band_edges(radius))
        ]
    )
    banded = values.select("value", F.bit_count("value").alias("ones"), F.inline(bands))
    # one cell per band value, or cells of equal population count and bounded size where the value is frequent
    counts = banded.groupBy("band", "key", "ones").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("band", "key").agg(F.sum("n").alias("all"))
    large = totals.where(F.col("all") > tile)
    cells = counts.join(large, ["band", "key"]).select(
        "band", "key", "ones", F.ceil(F.col("n") / F.lit(tile // 2)).cast("int").alias("parts")
    )
    small = banded.join(large.select("band", "key"), ["band", "key"], "left_anti").select(
        F.xxhash64("band", "key").alias("unit"), F.lit(2).alias("side"), "value", "band", "key"
    )
    split = banded.join(cells, ["band", "key", "ones"]).withColumn(
        "part", F.pmod(F.xxhash64("value", F.lit("tile")), F.col("parts")).cast("int")
    )
    # tile pairs of one band value: the later tile within the radius of the population count
    tiles = cells.select("band", "key", "ones", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = tiles.select("band", "key", F.col("ones").alias("ones2"), F.col("part").alias("part2"))
    reach = tiles.withColumn("ones2", F.explode(F.sequence(F.col("ones"), F.col("ones") + radius)))
    pairs = reach.join(other, ["band", "key", "ones2"]).where(
        (F.col("ones2") > F.col("ones")) | (F.col("part2") >= F.col("part"))
    )
    unit = F.xxhash64("band", "key", "ones", "part", "ones2", "part2").alias("unit")
    apart = (F.col("ones2") > F.col("ones")) | (F.col("part2") > F.col("part"))
    left = pairs.select("band", "key", "ones", "part", unit, F.when(apart, 0).otherwise(2).alias("side"))
    right = pairs.where(apart).select(
        "band", "key", F.col("ones2").alias("ones"), F.col("part2").alias("part"), unit, F.lit(1).alias("side")
    )
    paired = split.join(left.unionByName(right), ["band", "key", "ones", "part"]).select("unit", "side", "value")
    units = small.select("unit", "side", "value").unionByName(paired)
    ready = units.repartition("unit").sortWithinPartitions("unit")
    found = ready.mapInArrow(partial(_compare, radius=radius), "a bigint, b bigint")
    return found


# -- components -----------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node reachable from every node that has an edge.

    Alternating star contraction: every node's neighbours are tied to the smallest of them, first the larger ones,
    then all smaller ones, until nothing changes. Each round groups and joins by node only, minima combine on the map
    side, and its edges are stored in the shared folder.
    """

    def minimum(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def state(e: DataFrame) -> tuple:
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(minimum(both), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        low = large.join(minimum(large), "u")
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        now = cut_lineage(small.where("u <> v").distinct())
        after = state(now)
        if after == seen:
            break
        seen = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """(doc_id, value, component_id): fingerprint as a signed number and smallest doc_id of the linked group."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    prints = cut_lineage(with_fingerprint(narrow, out="value"))
    roots = components(links(prints, radius, tile, "value"))
    ids = prints.groupBy("value").agg(F.min("doc_id").alias("first"))
    labelled = ids.join(roots.withColumnRenamed("node", "value"), "value", "left").withColumn(
        "root", F.coalesce("root", "value")
    )
    named = labelled.join(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(
        "value", "component_id"
    )
    return prints.join(named, "value").select("doc_id", "value", "component_id")


def hex_of(value: str = "value") -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(value)), 16, "0"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of every group: the one with the smallest doc_id; of equal ids the smallest text hash, once.

    Only ids and hashes are gathered per group, by map-side minima; texts are joined back once. A null id counts as
    larger than all others.
    """
    key = free_name(docs, "_text_key")
    tagged = docs.withColumn(key, F.xxhash64(text_of(text)))
    narrow = tagged.select(F.col(doc_id).alias("doc_id"), F.col(key).alias("key"), text_of(text).alias("text"))
    prints = cut_lineage(with_fingerprint(narrow, out="value"))
    roots = components(links(prints, col="value")).withColumnRenamed("node", "value")
    best = prints.groupBy("value").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("best"))
    grouped = best.join(roots, "value", "left").groupBy(F.coalesce("root", "value").alias("root"))
    kept_id, kept_key = free_name(tagged, "_kept_id"), free_name(tagged, "_kept_key")
    kept = grouped.agg(F.min("best").alias("best")).select(
        F.col("best.doc_id").alias(kept_id), F.col("best.key").alias(kept_key)
    )
    same = F.col(doc_id).eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key))
    held = tagged.join(kept, same, "left_semi")
    repeated = not prints.groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    return (held.dropDuplicates([doc_id, key]) if repeated else held).drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(load(spark, sf_dir, "documents"))
    return groups.select("doc_id", hex_of().alias("fingerprint"), "component_id")
