"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. If two
fingerprints differ in at most four bits, either some segment is equal, or all
three differ and then two of them differ in exactly one bit each (1+1+2 at most).
So two sorts of key suffice:

* the segment itself, for each segment;
* for each pair of segments, a pair of Golay codeword indices. Decoding a word
  and all words one bit from it gives its nearby indices, six at most; of two
  words one bit apart, each one's own index is among the other's nearby ones. So one
  fingerprint's own index in one segment, with the other's own index in the other, is a
  key of both, and each has some ten keys a pair.

Fingerprints that share a key meet, are verified on all 64 bits, and give links.
Only links that connect something new within a bucket are put out, so a dense
bucket of m fingerprints gives at most m-1 rows. Buckets above ``BUCKET`` are split by
longer keys: the same key with a Golay index of one of the segments it leaves open,
4,096 times as fine. Only fingerprints that crowd one longer key as well, thousands within a few
bits, are linked through midpoints: two words at most four bits apart have a word within
two bits of both, so every such fingerprint goes to the 2081 words within two bits and is
linked to the smallest one found there. That is linear. Every step is exact, whatever a
bucket's size. Components come from links by alternating stars.

Edge cases: null and blank texts have fingerprint zero and are linked like any
other; fewer than four words make one shingle; a very long text is hashed whole, slice
by slice with its neighbours; a null ``doc_id`` gets the component of its fingerprint;
rows that share an id are told apart by their text; repeated rows are separate rows, of
which ``drop_near_duplicates`` keeps one at most; empty in, empty out; other columns are
ignored, and ``drop_near_duplicates`` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import golay
from ledgerline.llm.common import kept_rows, materialise, raw_texts, salted_left_join, text_key, text_slices, words
from ledgerline.plans.components import connected_components

#: Words in a shingle, hash seed, most differing bits of a link.
SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Low bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets above this many fingerprints are linked through midpoints.
BUCKET = 4096
#: Buckets up to this size are compared across buckets at once.
SMALL = 32


def shingle_hashes(raw: bytes) -> np.ndarray:
    """XXH64 (seed 42) of every 4-word shingle, repeats included."""
    found = words(raw)
    if not found:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(found)
    if len(found) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
    starts = np.concatenate([[0], ends[: -SHINGLE]]).tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            found = np.array([fingerprint(shingle_hashes(raw)) for raw in raw_texts(part)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array(found.view(np.int64))], ["doc_id", "th", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, th, fp``: the text's key, and the fingerprint as a signed 64-bit number."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", text_key().alias("th"), "text")
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, th long, fp long")


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    return [((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.uint32) for low, width in SEGMENTS]


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``key, row, role`` of every key of the fingerprints.

    Of a pair of segments, one's own index meets all near ones of the other, and the
    other way round: roles 1 and 2; 3 is both. Partners' roles together give 3.
    """
    fps = fps.astype(np.uint64)
    parts = _segments(fps)
    rows = np.arange(len(fps))
    keys, at, role = [], [], []
    for kind, part in enumerate(parts):
        keys.append(part.astype(np.int64) | (kind + 3) << 24)
        at.append(rows)
        role.append(np.full(len(fps), 3, dtype=np.int8))
    near = [golay.nearby(part, width) for part, (_, width) in zip(parts, SEGMENTS, strict=True)]
    for kind, (i, j) in enumerate(combinations(range(3), 2)):
        (a, am), (b, bm) = near[i], near[j]
        own_a, own_b = a[:, :1].astype(np.int64), b[:, :1].astype(np.int64)
        first = own_a << 12 | b | kind << 24  # its own index comes first among the near ones
        other = a[:, 1:].astype(np.int64) << 12 | own_b | kind << 24
        roles = np.ones(first.shape, dtype=np.int8)
        roles[:, 0] = 3
        for found, mask, which in ((first, bm, roles), (other, am[:, 1:], np.full(other.shape, 2, dtype=np.int8))):
            keys.append(found[mask])
            at.append(np.broadcast_to(rows[:, None], mask.shape)[mask])
            role.append(which[mask])
    return np.concatenate(keys), np.concatenate(at), np.concatenate(role)


def longer_keys(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``key, row``: keys of crowded buckets, lengthened by a Golay index of another segment.

    Fingerprints that share a pair's key differ in at most two bits of the third segment;
    those that share a segment differ in at most two bits of one of the others. Words two bits
    apart have a word between them, whose index is near both.
    """
    parts, kind, rows = _segments(fps.astype(np.uint64)), keys >> 24, np.arange(len(keys))
    out, at = [], []
    pairs = list(combinations(range(3), 2))
    for which, (part, (_, width)) in enumerate(zip(parts, SEGMENTS, strict=True)):
        free = np.isin(kind, [k for k in range(3) if which not in pairs[k]] + [k + 3 for k in range(3) if k != which])
        index, mask = golay.nearby(part[free], width)
        long = (keys[free].astype(np.int64) << 14)[:, None] | which << 12 | index
        out.append(long[mask])
        at.append(np.broadcast_to(rows[free][:, None], mask.shape)[mask])
    return np.concatenate(out), np.concatenate(at)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 20_000):
            fps = batch.column("fp").slice(start, 20_000).to_numpy(zero_copy_only=False)
            key, row, role = bucket_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row]), pa.array(role)], ["key", "fp", "role"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 20_000):
            keys, fps, roles = (batch.column(c).slice(start, 20_000).to_numpy(zero_copy_only=False) for c in ("key", "a", "role"))
            key, row = longer_keys(keys, fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row]), pa.array(roles[row])], ["key", "fp", "role"])


def _tree(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is connected, by widening from one fingerprint at a time."""
    left, right, rest = [], [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            hit = np.bitwise_count(rest ^ one) <= DISTANCE
            if hit.any():
                found = rest[hit]
                left.append(np.full(len(found), one))
                right.append(found)
                rest = rest[~hit]
                queue.extend(found)
    return left, right


def _bucket_links(key: np.ndarray, fps: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets of sorted keys."""
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(edges)
    size = np.repeat(sizes, sizes)
    left, right = [], []
    pick = np.flatnonzero((size > 1) & (size <= SMALL))
    k, f, o = key[pick], fps[pick], role[pick]
    for step in range(1, SMALL):
        same = k[step:] == k[:-step]
        if not same.any():
            break
        hit = np.flatnonzero(same & ((o[step:] | o[:-step]) == 3))
        hit = hit[np.bitwise_count(f[hit] ^ f[hit + step]) <= DISTANCE]
        left.append(f[hit])
        right.append(f[hit + step])
    for b in np.flatnonzero((sizes > SMALL) & (np.bitwise_or.reduceat(role, edges[:-1]) == 3)):
        a, z = _tree(fps[edges[b] : edges[b + 1]])
        left += a
        right += z
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _linked(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links ``a, b`` of rows sorted by key; of a bucket above the limit its rows ``key, a, role`` with ``b`` null."""

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        if len(a):
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        ends = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)]
        return pa.RecordBatch.from_arrays([*ends, pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int8())], names)

    def left(key: np.ndarray, fps: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64()), pa.array(key), pa.array(role)], names)

    names = ["a", "b", "key", "role"]
    held: tuple[np.ndarray, ...] | None = None
    over = None  # the key of a bucket that has left the comparison
    for batch in batches:
        now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "role"))
        if held is not None:
            now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
        if over is not None:
            gone = now[0] == over
            if gone.any():
                yield left(*(x[gone] for x in now))
                now = tuple(x[~gone] for x in now)
        if not len(now[0]):
            held = None
            continue
        last = np.searchsorted(now[0], now[0][-1])
        done, held = tuple(x[:last] for x in now), tuple(x[last:] for x in now)
        counts = np.unique(done[0], return_counts=True)
        big = np.isin(done[0], counts[0][counts[1] > limit])
        if big.any():
            yield left(*(x[big] for x in done))
            done = tuple(x[~big] for x in done)
        if len(held[0]) > limit:
            over = held[0][0]
            yield left(*held)
            held = None
        if len(done[0]):
            yield out(*_bucket_links(done[0], done[1].view(np.uint64), done[2]))
    if held is not None:
        yield out(*_bucket_links(held[0], held[1].view(np.uint64), held[2]))


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = [1 << i for i in range(64)]
    masks = np.array([0, *one, *(a | b for a, b in combinations(one, 2))], dtype=np.uint64)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            fps = batch.column("fp").slice(start, 256).to_numpy(zero_copy_only=False).view(np.uint64)
            middle = (fps[:, None] ^ masks).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(middle.view(np.int64)), pa.array(np.repeat(fps, len(masks)).view(np.int64))], ["z", "fp"]
            )


_KEYED, _LINKED = "key long, fp long, role byte", "a long, b long, key long, role byte"


def _met(keyed: DataFrame, limit: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Links of keyed fingerprints, and the rows of buckets above the limit."""
    met = keyed.repartition("key").sortWithinPartitions("key")
    found = materialise(met.mapInArrow(lambda it: _linked(it, limit), _LINKED), label)
    return found.filter("b is not null").select("a", "b").distinct(), found.filter("b is null")


def links(distinct: DataFrame, limit: int = BUCKET) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that connect every pair at most four bits apart."""
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.select("fp").repartition(tasks)  # a row becomes some thirty: as many tasks as the next shuffle
    near, crowded = _met(dealt.mapInArrow(_keyed, _KEYED), limit, "simhash-links")
    if crowded.isEmpty():
        return near
    second, dense = _met(crowded.mapInArrow(_split, _KEYED), limit, "simhash-second")
    near, dense = near.union(second), dense.select(F.col("a").alias("fp")).distinct()
    if dense.isEmpty():
        return near
    middle = materialise(dense.mapInArrow(_midpoints, "z long, fp long"), "simhash-midpoints")
    low = middle.groupBy("z").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
    far = middle.join(low, "z").filter("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return near.union(far.distinct())


def _grouped(documents: DataFrame, limit: int) -> DataFrame:
    """``doc_id, th, fp, best`` per row; ``best`` is the least (no id, id, text key) of its component, null if it is alone."""
    prints = materialise(fingerprints(documents), "simhash-prints")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    per = prints.groupBy("fp").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = connected_components(links(per.select("fp"), limit), "a", "b")
    linked = nodes.join(per, nodes["node"] == per["fp"]).groupBy("component").agg(F.min("first").alias("best"))
    named = salted_left_join(nodes, linked, "component", "node").select(F.col("node").alias("fp"), "best")
    copies = per.filter("n > 1").join(named, "fp", "left_anti").select("fp", F.col("first").alias("best"))
    return salted_left_join(prints, named.union(copies), "fp", "doc_id")


def near_duplicates(documents: DataFrame, limit: int = BUCKET) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    return _grouped(documents, limit).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("best.doc_id", "doc_id").alias("component_id"),
    )


def drop_near_duplicates(documents: DataFrame, limit: int = BUCKET) -> DataFrame:
    """One row of each component, with all its columns: the smallest ``doc_id``, ties by text key, null ids last."""
    first = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th")))
    decided = _grouped(documents, limit).select("doc_id", F.col("th").alias("key"), first.alias("kept"))
    return kept_rows(documents, decided, text_key())
