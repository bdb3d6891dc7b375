"""Repeated byte strings by common-prefix interval trees over partitioned suffix arrays.

Suffixes are dealt to tasks by content: every window of ``min_bytes`` bytes has an anchor, the 16-byte gram with the
least hash inside it, so equal windows have equal anchors and meet in one task wherever they lie. Neighbouring windows
with one anchor travel together as a stretch (its windows and the bytes that they reach over).

1. *Leaves.* Stretches with the same anchor and the same bytes are one leaf with many occurrences. They are combined in
   the tasks that read the texts and again by anchor, so a passage that a third of all documents share is one leaf.
2. *Enhanced suffix array.* Of anchors with two different leaves or more (or with a leaf that may repeat itself inside)
   the bytes of one occurrence of each leaf are fetched. Each task sorts the suffixes of its anchors by prefix doubling, with the lengths of common prefixes and the
   byte to the left of every suffix.
3. *Interval tree.* A stack scan over the prefix lengths yields the intervals bottom up. An interval whose members have
   different left bytes (or a left byte outside the stretch) cannot be extended to the left: it is a maximal repeat, and
   its members are all of its occurrences, not only neighbours in the array. Others are left to the interval one byte
   earlier, which holds the same occurrences and is longer.

``removed_spans`` keeps one entry per suffix: when intervals join, all but the earliest of their first occurrences get
the depth of the joining interval, and only the earliest goes on upwards. That entry is the longest string at the place
that starts earlier, so the work stays linear where the intervals are nested. ``repeat_groups`` gives the groups with all
occurrences. A repeat that runs through several anchors comes as one group per stretch; neighbouring groups overlap by
``min_bytes - 1`` bytes at least, and spans of one document are joined.

Grams that many documents of a sample share are taken as anchors only where a window has no other, so the windows at the
edges of a common passage are dealt out by the text around it. The sample sets only who meets where: any choice of such
grams gives the same result.

Order of starts: ids ascending, null after all others, then the hash of the text (for different texts with one id), then
the place. Defined results: null is the empty text, which like every text under ``min_bytes`` bytes has no repeat; of
rows that repeat in id and text the first counts as original and the others as copies; huge texts are read in pieces that
overlap; an empty table gives an empty table; other columns are not read. Equality of a leaf is equality of its anchor's
and its bytes' 64-bit hashes together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import load, text_of
from cellweave.operators.scale import parallelism
from cellweave.session import cut_lineage

MIN_BYTES = 100
GRAM = 16
#: Texts are hashed in chunks of about so many bytes; longer texts in overlapping pieces of this size.
CHUNK = 1 << 20
#: Stretches that a task combines before it sends them on.
HELD = 300_000
#: Slots of the table of frequent grams, documents of its sample, share of them that makes a gram frequent.
SLOTS = 1 << 20
SAMPLE_DOCS = 4_000
FREQUENT = 0.02

PERIODIC = 1 << 15
_NO_ID = (1 << 63) - 1
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_TOP = np.uint64(1 << 63)

# -- hashing --------------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _K2
    x ^= x >> np.uint64(29)
    x *= _K3
    x ^= x >> np.uint64(32)
    return x


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as one little-endian number."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data.data, strides=(1,)).astype(np.uint64)


def _grams(words: np.ndarray) -> np.ndarray:
    """63-bit hash of the 16 bytes from every place on."""
    return _mix(words[:-8] * _K1 + words[8:]) >> np.uint64(1)


def _slide(x: np.ndarray, width: int, take: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x = take(x[:-span], x[span:])
        span *= 2
    return take(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def stretches(data: bytes, starts: np.ndarray, sizes: np.ndarray, frequent: np.ndarray, min_bytes: int) -> tuple:
    """(anchor, content, text number, place in ``data``, windows) of all stretches of the texts in ``data``.

    The number of windows carries the mark ``PERIODIC`` if the stretch may hold one window twice.
    """
    windows = np.maximum(sizes - min_bytes + 1, 0)
    total = int(windows.sum())
    if not total:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    words = _words(np.frombuffer(data, np.uint8))
    grams = _grams(words)
    grams |= np.where(frequent[(grams & np.uint64(SLOTS - 1)).astype(np.int64)], _TOP, np.uint64(0))
    width = min_bytes - GRAM + 1
    least = _slide(grams, width, np.minimum)
    text = np.repeat(np.arange(len(sizes)), windows)
    place = np.arange(total) + np.repeat(starts - (np.cumsum(windows) - windows), windows)
    anchor = least[place]
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, total))
    # one anchor may stay the least over a long periodic text: no stretch has more windows than a window has grams
    pieces = -(-length // width)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(first, pieces) + nth * width
    run = np.minimum(np.repeat(length, pieces) - nth * width, width)
    start, reach = place[first], run + min_bytes - 1
    content = reach.astype(np.uint64)
    for offset in range(0, width + min_bytes - 1, 8):
        content = _mix(content * _K1 + words[start + np.minimum(offset, reach - 8)])
    # a window that comes twice in one stretch has its anchor twice, with no other anchor's place between
    none = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(grams == _slide(np.concatenate([none, least, none]), width, np.maximum))
    twice = at[:-1][(grams[at[1:]] == grams[at[:-1]]) & (at[1:] - at[:-1] < width)]
    inside = np.searchsorted(twice, start + run + width - 1) > np.searchsorted(twice, start)
    return anchor[first], content, text[first], start, run + np.where(inside, PERIODIC, 0)


def _batches_of_texts(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[tuple]:
    """(ids, keys, bytes, starts, sizes, offsets in the text) of chunks; a huge text comes in overlapping pieces."""
    ids, keys, parts, offsets, held = [], [], [], [], 0

    def out() -> tuple:
        sizes = np.array([len(p) for p in parts], np.int64)
        starts = np.cumsum(sizes) - sizes
        return np.array(ids, np.int64), np.array(keys, np.int64), b"".join([*parts, bytes(16)]), starts, sizes, np.array(offsets, np.int64)

    for batch in batches:
        for n in range(batch.num_rows):
            text = batch.column("text")[n].as_buffer()
            size = text.size if text is not None else 0
            for lo in range(0, max(size - min_bytes + 1, 0), CHUNK):
                piece = text.slice(lo, min(CHUNK + min_bytes - 1, size - lo)).to_pybytes()
                ids.append(batch.column("id")[n].as_py())
                keys.append(batch.column("key")[n].as_py())
                parts.append(piece)
                offsets.append(lo)
                held += len(piece)
                if held >= CHUNK:
                    yield out()
                    ids, keys, parts, offsets, held = [], [], [], [], 0
    if parts:
        yield out()


# -- leaves ---------------------------------------------------------------------------------------------------------

_COLUMNS = ("anchor", "content", "id", "key", "start", "run")
_TYPES = (np.uint64, np.uint64, np.int64, np.int64, np.uint32, np.uint16)
_SENT = "bucket int, copies boolean, " + ", ".join(f"{c} binary" for c in _COLUMNS)


def _pack(bucket: int, copies: bool, columns: list[np.ndarray]) -> dict:
    return {"bucket": bucket, "copies": copies} | {n: c.astype(t).tobytes() for n, c, t in zip(_COLUMNS, columns, _TYPES)}


def _unpack(rows: list[dict]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(r[n] for r in rows), t) for n, t in zip(_COLUMNS, _TYPES)]


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def _table(rows: list[dict], ddl: str) -> pa.RecordBatch:
    fields = [pa.field(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def _first_of_leaves(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by leaf and start; marks of the leaves' first rows and of rows that repeat the one before."""
    anchor, content, ids, keys, start, _ = columns
    order = np.lexsort((start, keys, ids, content, anchor))
    a, c, i, k, s = (x[order] for x in (anchor, content, ids, keys, start))
    first, again = np.ones(len(order), bool), np.zeros(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    again[1:] = ~first[1:] & (i[1:] == i[:-1]) & (k[1:] == k[:-1]) & (s[1:] == s[:-1])
    return order, first, again


def _send(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, buckets: int, min_bytes: int, combine: bool):
    """Stretches of the texts by bucket of their anchor. Later copies of a leaf in the same task are settled at once."""
    held: list[tuple] = []
    rows, count = 0, 0

    def out() -> pa.RecordBatch:
        nonlocal count
        columns = [np.concatenate(x) for x in zip(*held)]
        # the leaf that is found early and again goes on once; sorting by the mixed hash puts its rows side by side
        both = _mix(columns[0] * _K1 + columns[1])
        order = np.argsort(both, kind="stable")
        columns, both = [c[order] for c in columns], both[order]
        twin = np.zeros(len(both), bool)
        twin[1:] = both[1:] == both[:-1]
        twin[:-1] |= twin[1:]
        sent, settled = columns, None
        if combine and twin.any():
            some = [c[twin] for c in columns]
            by, first, again = _first_of_leaves(some)
            sent = [np.concatenate([c[~twin], s[by][first]]) for c, s in zip(columns, some)]
            settled = [s[:0] for s in some[:2]] + [s[by][~first & ~again] for s in some[2:]]
        bucket = ((sent[0] * _K3) >> np.uint64(33)).astype(np.int64) % buckets
        order = np.lexsort((sent[4], sent[3], sent[2], bucket))
        sent, bucket = [c[order] for c in sent], bucket[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        packed = [_pack(b, False, [c[lo:hi] for c in sent]) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])) if hi > lo]
        if settled is not None and len(settled[2]):
            count += 1
            packed.append(_pack(int(_mix(settled[2][:1].astype(np.uint64) + np.uint64(count))[0] % np.uint64(buckets)), True, settled))
        return _table(packed, _SENT)

    for ids, keys, data, starts, sizes, offsets in _batches_of_texts(batches, min_bytes):
        anchor, content, text, place, run = stretches(data, starts, sizes, frequent, min_bytes)
        held.append((anchor, content, ids[text], keys[text], place - starts[text] + offsets[text], run))
        rows += len(run)
        if rows >= HELD:
            yield out()
            held, rows = [], 0
    if held:
        yield out()


def _lists(ids: np.ndarray, keys: np.ndarray, values: dict[str, tuple]) -> pa.Table:
    """One row per document with lists of those values that are marked; the values come sorted by document."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    at, number = np.flatnonzero(new), np.cumsum(new) - 1
    columns = {"id": pa.array(ids[at], pa.int64()), "key": pa.array(keys[at], pa.int64())}
    for name, (value, marked) in values.items():
        offsets = np.append(0, np.cumsum(np.bincount(number[marked], minlength=len(at)))).astype(np.int32)
        columns[name] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[marked].astype(np.int64)))
    return pa.table(columns)


def _span(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 24 | length.astype(np.int64)


_SETTLED = "id bigint, key bigint, span array<bigint>, member array<bigint>, anchor array<bigint>"


def _settle(table: pa.Table, min_bytes: int) -> pa.Table:
    """Spans of all but the first occurrence of every leaf; members: first occurrences of leaves whose anchor has others
    or comes twice in them."""
    rows = table.to_pylist()
    anchor, content, ids, keys, start, run = columns = _unpack([r for r in rows if not r["copies"]])
    order, first, again = _first_of_leaves(columns)
    settled = _unpack([r for r in rows if r["copies"]])
    later = order[~first & ~again]
    leaf = order[first]
    many = np.zeros(len(leaf), bool)
    many[1:] = anchor[leaf][1:] == anchor[leaf][:-1]
    many[:-1] |= many[1:]
    member = leaf[many | (run[leaf] >= PERIODIC)]
    reach = min_bytes - 1
    n, m, k = len(later), len(settled[2]), len(member)
    doc = np.concatenate([ids[later], settled[2], ids[member]]), np.concatenate([keys[later], settled[3], keys[member]])
    place = np.concatenate([start[later], settled[4], start[member]]).astype(np.int64)
    length = np.concatenate([run[later], settled[5], run[member]]).astype(np.int64) % PERIODIC
    value = _span(place, np.where(np.arange(n + m + k) < n + m, length + reach, length))
    anchors = np.concatenate([np.zeros(n + m, np.int64), anchor[member].view(np.int64)])
    is_member = np.arange(n + m + k) >= n + m
    by = np.lexsort((value, doc[1], doc[0]))
    ids, keys, value, anchors, is_member = doc[0][by], doc[1][by], value[by], anchors[by], is_member[by]
    return _lists(ids, keys, {"span": (value, ~is_member), "member": (value, is_member), "anchor": (anchors, is_member)})


# -- suffix arrays --------------------------------------------------------------------------------------------------


class SuffixArray:
    """Sorted suffixes of some stretches, each anchor for itself, with common prefixes and left bytes.

    Suffixes start at the windows of a stretch and end with it.
    """

    def __init__(self, texts: list[bytes], runs: np.ndarray, group: np.ndarray) -> None:
        size = np.array([len(t) for t in texts], np.int64)
        longest = int(size.max(initial=1))
        data = np.frombuffer(b"\xff".join(texts) + b"\xff" * (4 * longest + 16), np.uint8)  # 0xFF is in no text
        begin = np.cumsum(size + 1) - size - 1
        self.stretch = np.repeat(np.arange(len(texts)), runs)
        self.offset = np.arange(len(self.stretch)) - np.repeat(np.cumsum(runs) - runs, runs)
        place, end = begin[self.stretch] + self.offset, (begin + size)[self.stretch]
        words = _words(data).byteswap()
        ranks, span = [np.unique(words, return_inverse=True)[1]], 8
        while span < longest:
            last = ranks[-1].astype(np.uint64)
            later = np.append(last[span:], np.full(span, last[-1]))
            ranks.append(np.unique(last << np.uint64(32) | later, return_inverse=True)[1])
            span *= 2
        order = np.lexsort((ranks[-1][place], group[self.stretch]))
        self.stretch, self.offset, place, end = self.stretch[order], self.offset[order], place[order], end[order]
        own = group[self.stretch]
        common = np.zeros(max(len(place) - 1, 0), np.int64)
        for rank in reversed(ranks):
            common += (rank[place[:-1] + common] == rank[place[1:] + common]) * span
            span //= 2
        same = np.ones(len(common), bool)
        for _ in range(7):
            same &= data[place[:-1] + common] == data[place[1:] + common]
            common += same
        common = np.minimum(common, np.minimum(end[:-1] - place[:-1], end[1:] - place[1:]))
        self.common = np.where(own[1:] == own[:-1], common, 0)
        self.left = np.where(self.offset > 0, data[place - 1].astype(np.int64), -1)


def intervals(common: list[int], first: list[int], left: list[int], least: int) -> Iterator[tuple]:
    """(depth, first leaf, last leaf, first occurrences of the parts, same left byte) of all intervals, bottom up.

    ``first`` ranks the leaves by their start; the left byte is -1 for one that differs or lies outside.
    """
    stack: list[list] = []
    n = len(first)
    for i in range(n):
        depth = common[i] if i < n - 1 else 0
        low, best, side = i, first[i], left[i]
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            top[2].append(best)
            if top[3] != side:
                top[3] = -1
            if top[0] >= least:
                yield top[0], top[1], i, top[2], top[3]
            low, best, side = top[1], min(top[2]), top[3]
        if depth < least:
            continue
        if stack and stack[-1][0] == depth:
            stack[-1][2].append(best)
            if stack[-1][3] != side:
                stack[-1][3] = -1
        else:
            stack.append([depth, low, [best], side])


_FETCHED = "bucket int, anchor binary, id binary, key binary, start binary, run binary, bytes binary"
_MEMBER = (("anchor", np.int64), ("id", np.int64), ("key", np.int64), ("start", np.int64), ("run", np.int64))


def _fetch(batches: Iterator[pa.RecordBatch], buckets: int, min_bytes: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the members' stretches by bucket of their anchor."""
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        anchors = np.array([h[0] for h in held], np.int64)
        bucket = ((anchors.view(np.uint64) * _K3) >> np.uint64(33)).astype(np.int64) % buckets
        rows = []
        for b in np.unique(bucket).tolist():
            mine = [held[i] for i in np.flatnonzero(bucket == b)]
            packed = {n: np.array([m[i] for m in mine], t).tobytes() for i, (n, t) in enumerate(_MEMBER)}
            rows.append({"bucket": b, **packed, "bytes": b"".join(m[5] for m in mine)})
        return _table(rows, _FETCHED)

    for batch in batches:
        ids, keys = batch.column("id").to_pylist(), batch.column("key").to_pylist()
        for n in range(batch.num_rows):
            text = batch.column("text")[n].as_buffer()
            for value, anchor in zip(batch.column("member")[n].as_py(), batch.column("anchor")[n].as_py()):
                start, run = value >> 24, value & 0xFFFFFF
                piece = text.slice(start, run + min_bytes - 1).to_pybytes()
                held.append((anchor, ids[n], keys[n], start, run, piece))
                size += len(piece) + 64
            if size >= 8 * CHUNK:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _arrays(table: pa.Table, min_bytes: int) -> Iterator[tuple]:
    """(suffix array, members' ids, keys, starts, anchors, rank of every suffix's start) of groups of anchors."""
    rows = table.to_pylist()
    anchor, ids, keys, start, run = (np.frombuffer(b"".join(r[n] for r in rows), t) for n, t in _MEMBER)
    data, size = b"".join(r["bytes"] for r in rows), run + min_bytes - 1
    begin = np.cumsum(size) - size
    order = np.lexsort((start, keys, ids, anchor))
    new = np.ones(len(order), bool)
    new[1:] = anchor[order][1:] != anchor[order][:-1]
    group = np.cumsum(new) - 1
    total, lo = np.cumsum(size[order]), 0
    while lo < len(order):
        # whole anchors, few enough to sort in cache memory
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK // 4, "right"))
        hi = int(np.searchsorted(group, group[min(max(hi, lo + 1), len(order) - 1)], "left")) if hi < len(order) else len(order)
        if hi <= lo:
            hi = int(np.searchsorted(group, group[lo], "right"))
        mine = order[lo:hi]
        array = SuffixArray([data[b : b + s] for b, s in zip(begin[mine].tolist(), size[mine].tolist())], run[mine], group[lo:hi])
        place = start[mine][array.stretch] + array.offset
        rank = np.empty(len(place), np.int64)
        rank[np.lexsort((place, keys[mine][array.stretch], ids[mine][array.stretch]))] = np.arange(len(place))
        yield array, ids[mine], keys[mine], start[mine], anchor[mine], rank
        lo = hi


def _scan(table: pa.Table, min_bytes: int) -> pa.Table:
    """Longest earlier string at every suffix that has one, from the maximal intervals."""
    found: list[tuple] = []
    for array, ids, keys, start, _, rank in _arrays(table, min_bytes):
        where, depth = [], []
        for size, _, _, parts, left in intervals(array.common.tolist(), rank.tolist(), array.left.tolist(), min_bytes):
            if left == -1:
                least = min(parts)
                rest = [p for p in parts if p != least]
                where += rest
                depth += [size] * len(rest)
        at = np.argsort(rank)[np.array(where, np.int64)] if where else np.zeros(0, np.int64)
        s = array.stretch[at]
        found.append((ids[s], keys[s], _span(start[s] + array.offset[at], np.array(depth, np.int64))))
    ids, keys, span = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((span, keys, ids))
    return _lists(ids[by], keys[by], {"span": (span[by], np.ones(len(by), bool))})


# -- operators ------------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, key, text): the place in the order of starts, and the text."""
    known = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_NO_ID)).alias("id")
    return docs.select(known, F.xxhash64(F.col(doc_id).isNull(), text_of(text)).alias("key"), text_of(text).alias("text"))


def _count_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, docs = np.zeros(SLOTS, np.int32), 0
    for batch in batches:
        for n in range(batch.num_rows):
            text = batch.column("text")[n].as_buffer()
            seen = []
            for lo in range(0, max((text.size if text is not None else 0) - GRAM + 1, 0), CHUNK):
                piece = text.slice(lo, min(CHUNK + GRAM - 1, text.size - lo)).to_pybytes()
                seen.append(np.unique(_grams(_words(np.frombuffer(piece, np.uint8))) & np.uint64(SLOTS - 1)))
            docs += 1
            if seen:
                counts[np.unique(np.concatenate(seen)).astype(np.int64)] += 1
    # a slot below a quarter of the share in this task adds little to its sum
    at = np.flatnonzero(counts >= max(3, FREQUENT / 4 * docs))
    yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int64()), "n": pa.array(counts[at], pa.int64())})


def frequent_grams(keyed: DataFrame) -> np.ndarray:
    """Marks of the gram slots that many documents of a sample of about ``SAMPLE_DOCS`` share; steers placement only."""
    rows = keyed.count()
    share = F.pmod(F.col("key"), F.lit(max(1, rows // SAMPLE_DOCS))) == 0
    found = keyed.where(share).select("text").repartition(16).mapInArrow(_count_frequent, "slot bigint, n bigint")
    most = max(8, int(FREQUENT * min(rows, SAMPLE_DOCS)))
    marks = np.zeros(SLOTS, bool)
    marks[[r.slot for r in found.groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= most).select("slot").collect()]] = True
    return marks


def _sent(keyed: DataFrame, buckets: int, min_bytes: int, combine: bool) -> DataFrame:
    marks = frequent_grams(keyed)
    packed = keyed.sparkSession.sparkContext.broadcast(np.packbits(marks))  # one bit per slot, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _send(batches, np.unpackbits(packed.value).astype(bool), buckets, min_bytes, combine)

    return keyed.mapInArrow(run, _SENT)


def _suffixes(texts: DataFrame, members: DataFrame, buckets: int, min_bytes: int) -> DataFrame:
    wanted = texts.join(members, ["id", "key"]).select(*texts.columns, "member", "anchor")
    return wanted.mapInArrow(partial(_fetch, buckets=buckets, min_bytes=min_bytes), _FETCHED)


def removed_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct rows (id, key, text, copies) and their spans (id, key, span) that start earlier elsewhere.

    A span is ``start << 24 | length`` in bytes; spans of a document may overlap.
    """
    if min_bytes < GRAM + 8:
        raise ValueError(f"min_bytes must be at least {GRAM + 8}")
    keyed = _keyed(docs, doc_id, text)
    buckets = 4 * parallelism(docs)
    by_anchor = _sent(keyed, buckets, min_bytes, True).groupBy("bucket").applyInArrow(lambda t: _settle(t, min_bytes), _SETTLED)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("span", "member", "anchor")]
    leaves = cut_lineage(by_anchor.groupBy("id", "key").agg(*lists))
    # rows that repeat in id and text are one text with copies; both uses below read one exchange
    texts = keyed.groupBy("id", "key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    members = leaves.where(F.size("member") > 0).select("id", "key", "member", "anchor")
    fetched = _suffixes(texts, members, buckets, min_bytes)
    scanned = fetched.groupBy("bucket").applyInArrow(lambda t: _scan(t, min_bytes), "id bigint, key bigint, span array<bigint>")
    spans = scanned.unionByName(leaves.where(F.size("span") > 0).select("id", "key", "span"))
    return texts, spans.groupBy("id", "key").agg(F.flatten(F.collect_list("span")).alias("span"))


def joined_spans(spans: list[int]) -> list[tuple[int, int]]:
    """Maximal (start, end) runs that the spans cover; runs that touch are one."""
    out: list[list[int]] = []
    for value in sorted(spans):
        lo, hi = value >> 24, (value >> 24) + (value & 0xFFFFFF)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


_OUT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch], min_bytes: int, with_kept: bool) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        rows = []
        for n in range(batch.num_rows):
            text = batch.column("text")[n].as_buffer()
            data = text.to_pybytes() if text is not None else b""
            ident = batch.column("id")[n].as_py()
            runs = joined_spans(batch.column("span")[n].as_py() or [])
            edges = [0, *[x for run in runs for x in run], len(data)]
            kept = b"".join(data[lo:hi] for lo, hi in zip(edges[::2], edges[1::2])) if runs else data
            sha = hashlib.sha256(kept).hexdigest()
            rows.append((ident, len(data), len(data) - len(kept), len(runs), kept if with_kept else None, sha))
            for _ in range(batch.column("copies")[n].as_py() - 1):
                whole = len(data) >= min_bytes
                copy = (len(data), 1, b"", nothing) if whole else (0, 0, data, hashlib.sha256(data).hexdigest())
                rows.append((ident, len(data), copy[0], copy[1], copy[2] if with_kept else None, copy[3]))
                if len(rows) >= 10_000:
                    yield _rows(rows)
                    rows = []
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in _OUT.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def remove_repeats(
    docs: DataFrame, min_bytes: int = MIN_BYTES, doc_id: str = "doc_id", text: str = "text", with_kept: bool = True
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256): every document without its repeated bytes.

    ``kept`` is binary: a cut may fall inside a character. ``with_kept=False`` leaves it null.
    """
    texts, spans = removed_spans(docs, min_bytes, doc_id, text)
    ready = texts.join(spans, ["id", "key"], "left").select("id", "text", "copies", "span")
    out = ready.mapInArrow(partial(_cut, min_bytes=min_bytes, with_kept=with_kept), _OUT)
    return out.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), *[x.split()[0] for x in _OUT.split(", ")[1:]])


# -- groups ---------------------------------------------------------------------------------------------------------

_LEAF = "anchor bigint, content bigint, id bigint, key bigint, start bigint, run bigint"


def _occurrences(table: pa.Table) -> pa.Table:
    """All stretches of anchors that occur twice or more."""
    columns = _unpack(table.to_pylist())
    order, _, again = _first_of_leaves(columns)
    order = order[~again]
    anchor, content, ids, keys, start, run = (c[order] for c in columns)
    twice = np.zeros(len(order), bool)
    twice[1:] = anchor[1:] == anchor[:-1]
    twice[:-1] |= twice[1:]
    twice |= run >= PERIODIC
    values = [x[twice] for x in (anchor.view(np.int64), content.view(np.int64), ids, keys, start.astype(np.int64), run.astype(np.int64))]
    return pa.table({n.split()[0]: pa.array(v) for n, v in zip(_LEAF.split(", "), values)})


def _groups(table: pa.Table, min_bytes: int) -> pa.Table:
    """Leaves of every maximal interval: the group's number and length, and where in the leaf it starts."""
    out: list[tuple] = []
    for array, ids, keys, start, anchor, rank in _arrays(table, min_bytes):
        for size, lo, hi, _, left in intervals(array.common.tolist(), rank.tolist(), array.left.tolist(), min_bytes):
            if left == -1:
                s, o = array.stretch[lo : hi + 1], array.offset[lo : hi + 1]
                name = hash((int(ids[s[0]]), int(keys[s[0]]), int(start[s[0]] + o[0]), size))
                out += [(name, size, int(anchor[x]), int(ids[x]), int(keys[x]), int(start[x]), int(y)) for x, y in zip(s, o)]
    names = ("repeat", "length", "anchor", "id", "key", "start", "offset")
    return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(names)})


def repeat_groups(docs: DataFrame, min_bytes: int = MIN_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(repeat, length, doc_id, start): every maximal repeat of a stretch with all of its occurrences.

    The rows grow with the nesting of the repeats; ``removed_spans`` does not need them. Text that repeats itself with a
    period under ``min_bytes`` is cut into stretches at no natural place: a group lists the places within its stretches, and
    every repeated window is in some group.
    """
    keyed = _keyed(docs, doc_id, text)
    buckets = 4 * parallelism(docs)
    leaves = cut_lineage(_sent(keyed, buckets, min_bytes, False).groupBy("bucket").applyInArrow(lambda t: _occurrences(t), _LEAF))
    texts = keyed.groupBy("id", "key").agg(F.first("text").alias("text"))
    least = F.min(F.struct("id", "key", "start", "run")).alias("m")
    firsts = cut_lineage(leaves.groupBy("anchor", "content").agg(least, F.count(F.lit(1)).alias("n")))
    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("leaves"), F.max("m.run").alias("run"))
    several = several.where((F.col("leaves") > 1) | (F.col("run") >= PERIODIC)).select("anchor")
    value = F.shiftleft("m.start", 24).bitwiseOR(F.col("m.run") % PERIODIC).alias("v")
    members = (
        firsts.join(several, "anchor")
        .select(F.col("m.id").alias("id"), F.col("m.key").alias("key"), F.struct(value, "anchor").alias("x"))
        .groupBy("id", "key")
        .agg(F.collect_list("x").alias("x"))
        .select("id", "key", F.col("x.v").alias("member"), F.col("x.anchor").alias("anchor"))
    )
    schema = "repeat bigint, length bigint, anchor bigint, id bigint, key bigint, start bigint, offset bigint"
    nested = _suffixes(texts, members, buckets, min_bytes).groupBy("bucket").applyInArrow(lambda t: _groups(t, min_bytes), schema)
    of_leaf = firsts.select("anchor", "content", F.col("m.id").alias("id"), F.col("m.key").alias("key"), F.col("m.start").alias("start"))
    inner = nested.join(of_leaf, ["anchor", "id", "key", "start"]).select("repeat", "length", "anchor", "content", "offset")
    # a leaf with several occurrences is an interval as deep as the stretch is long, if no other leaf goes on from there
    whole = firsts.where("n > 1").select(
        F.xxhash64("anchor", "content").alias("repeat"), (F.col("m.run") % PERIODIC + min_bytes - 1).cast("bigint").alias("length"), "anchor", "content",
        F.lit(0).cast("bigint").alias("offset"),
    )
    named = inner.where("offset = 0").select("anchor", "content", "length")
    whole = whole.join(named, ["anchor", "content", "length"], "left_anti")
    found = inner.unionByName(whole).join(leaves, ["anchor", "content"])
    return found.select(
        "repeat", "length", F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), (F.col("start") + F.col("offset")).alias("start")
    ).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"), with_kept=False).drop("kept")
