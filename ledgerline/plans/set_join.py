"""Pairs of sets whose Jaccard similarity reaches a threshold, in bounded disk and memory.

Sets are ordered by one order of words and written once to the shared folder, in blocks of a size class. A task
holds two blocks and meets them by their prefixes: of two sets that overlap enough the first common word is among the
first n - ceil(t n) + 1 of the larger and the first n - ceil(2 t / (1 + t) n) + 1 of the smaller. Meetings are
expanded a bounded number at a time and put to three tests that lose no pair: sizes, what is left behind
the word, and the bits in which parities of hashed words differ, which are at most the words in which the sets do. What passes is
counted word by word. Groups of similar sets need no more than links that connect them, so ``links`` passes over
pairs that links found before already connect, and then words of any frequency are met.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.materialise import discard
from ledgerline.session import scratch_path

#: Buckets of hashed words whose counts give the order of words.
BUCKETS = 1 << 19
#: Words in a block, about, and bytes of bit vectors that are compared at once.
BLOCK_WORDS, COMPARED = 2 << 20, 32 << 20
#: Sets in a block, about, and meetings expanded at once where only links are sought.
BLOCK_SETS, EXPANDED = 1 << 13, 1 << 19
_EPS = 1e-9


def _ordered(rank: np.ndarray, common: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each set by rank, too common ones last; ``rare`` is the number of the others."""
    for batch in batches:
        words = batch.column("words")
        ids = words.flatten().to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        late = np.isin(ids, common)
        order = np.lexsort((ids, rank[ids & (BUCKETS - 1)], late, row))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        rare = np.bincount(row[~late], minlength=len(sizes)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("first_row"), batch.column("block"), pa.array(rare), pa.ListArray.from_arrays(ends, pa.array(ids[order]))],
            ["first_row", "block", "rare", "words"],
        )


class Block:
    """Sets of a block: ``ids`` of all words, where each set starts, its size and how many words are rare."""

    def __init__(self, path: str, number: int):
        system, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        table = ds.dataset(f"{folder}/block={number}", format="parquet", filesystem=system).to_table(["first_row", "rare", "words"]).combine_chunks()
        words = table.column("words").combine_chunks()
        self.row = table.column("first_row").to_numpy()
        self.rare = table.column("rare").to_numpy().astype(np.int64)
        self.ids = words.flatten().to_numpy()
        self.n = pc.list_value_length(words).to_numpy().astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n)[:-1]]).astype(np.int64)

    def postings(self, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, set and place of the rare words among the first ``prefix`` of each set, by word."""
        size = np.minimum(prefix, self.rare)
        one = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(one)) - np.repeat(np.cumsum(size) - size, size)
        word = self.ids[self.start[one] + place]
        order = np.argsort(word, kind="stable")
        return word[order], one[order], place[order]

    def parities(self, bits: int) -> np.ndarray:
        """Bit vectors: each word turns over one bit of its set's."""
        out = np.zeros((len(self.n), bits // 64), dtype=np.uint64)
        at = (self.ids.view(np.uint64) >> np.uint64(20)) % np.uint64(bits)
        np.bitwise_xor.at(out, (np.repeat(np.arange(len(self.n)), self.n), (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
        return out

    def words(self, k: int) -> np.ndarray:
        return self.ids[self.start[k] : self.start[k] + self.n[k]]


def meetings(large: Block, small: Block, same: bool, t: float, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that may be similar, of which the second is the smaller or, of equal size, has the smaller row.

    Pairs within one ``group`` are passed over; it has a number for each large set, then for each small one, which the caller may change.
    """
    share = 2 * t / (1 + t)
    word, one, place = large.postings(large.n - np.ceil(large.n * t - _EPS).astype(np.int64) + 1)
    theirs, other, spot = small.postings(small.n - np.ceil(small.n * share - _EPS).astype(np.int64) + 1)
    low = np.searchsorted(theirs, word)
    count = np.searchsorted(theirs, word, "right") - low
    held = np.flatnonzero(count)
    word, one, place, low, count = (x[held] for x in (word, one, place, low, count))
    ends = np.cumsum(count)
    bits = max(64, 1 << math.ceil(math.log2(2 * max(large.n.max(initial=1), small.n.max(initial=1)))))
    mine = large.parities(bits)
    his = mine if same else small.parities(bits)
    at_once, compared = (1 << 21, COMPARED) if group is None else (EXPANDED, COMPARED // 4)
    step, first = max(1, compared // (bits // 8)), 0
    while first < len(count):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + at_once, "right")))
        n = count[first:last]
        x = np.repeat(np.arange(first, last), n)
        y = low[x] + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        a, b = one[x], other[y]
        if group is not None:
            apart = np.flatnonzero(group[a] != group[b + (0 if same else len(large.n))])
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        na, nb = large.n[a], small.n[b]
        needed = np.ceil((na + nb) * (t / (1 + t)) - _EPS)
        ok = (1 + np.minimum(na - place[x], nb - spot[y]) - 1 >= needed) & (nb >= t * na - _EPS) & ((nb < na) | (nb == na) & (small.row[b] < large.row[a]))
        a, b, needed = a[ok], b[ok], needed[ok]
        near = []
        for k in range(0, len(a), step):
            differ = np.bitwise_count(mine[a[k : k + step]] ^ his[b[k : k + step]]).sum(axis=1, dtype=np.int64)
            near.append(differ <= large.n[a[k : k + step]] + small.n[b[k : k + step]] - 2 * needed[k : k + step])
        ok = np.concatenate(near) if near else np.zeros(0, dtype=bool)
        if ok.any():
            yield a[ok], b[ok]
        first = last


def _share(large: Block, small: Block, i: int, j: int) -> float:
    common = len(np.intersect1d(large.words(i), small.words(j), assume_unique=True))
    return common / (int(large.n[i]) + int(small.n[j]) - common)


def _pairs(large: Block, small: Block, same: bool, t: float) -> Iterator[list[tuple[int, int, float]]]:
    """Places and similarity of every similar pair."""
    seen = np.empty(0, dtype=np.int64)
    for a, b in meetings(large, small, same, t):
        codes = np.setdiff1d(a * len(small.n) + b, seen)
        seen = np.union1d(seen, codes)
        yield [(i, j, share) for i, j in (divmod(c, len(small.n)) for c in codes.tolist()) if (share := _share(large, small, i, j)) >= t]


def _links(large: Block, small: Block, same: bool, t: float) -> Iterator[list[tuple[int, int, float]]]:
    """Similar pairs of which each connects two groups: all similar pairs are connected by them, there are fewer than sets."""
    behind = 0 if same else len(large.n)
    group, failed = np.arange(behind + len(small.n)), np.empty(0, dtype=np.int64)
    for a, b in meetings(large, small, same, t, group):
        codes, found, vain = np.setdiff1d(a * len(small.n) + b, failed), [], []
        for k in range(0, len(codes), 4096):
            i, j = np.divmod(codes[k : k + 4096], len(small.n))
            apart = group[i] != group[j + behind]
            for p, q in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
                if (mine := group[p]) == (his := group[q + behind]):
                    continue
                if (share := _share(large, small, p, q)) >= t:
                    group[group == his] = mine
                    found.append((p, q, share))
                else:
                    vain.append(p * len(small.n) + q)
        failed = np.union1d(failed, np.array(vain, dtype=np.int64))
        yield found


def _met(path: str, t: float, links: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, similarity`` of the pairs of blocks that a task is given."""
    kept: dict[int, Block] = {}
    for batch in batches:
        for x, y in zip(*(batch.column(c).to_pylist() for c in ("x", "y")), strict=True):
            kept = {k: kept[k] if k in kept else Block(path, k) for k in (x, y)}
            large, small = kept[x], kept[y]
            for met in (_links if links else _pairs)(large, small, x == y, t):
                rows = [(int(large.row[i]), int(small.row[j]), share) for i, j, share in met]
                if rows:
                    found = [(min(p, q), max(p, q), share) for p, q, share in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(list(v)) for v in zip(*found, strict=True)], ["a", "b", "similarity"])


def similar_sets(sets: DataFrame, t: float, links: bool = False) -> DataFrame:
    """``a, b, similarity`` of stored ``first_row, count, words``, which are deleted once the blocks are written.

    A pair must share a word that is in at most max(50, 5 %) of the rows. With ``links`` there is no such cap: any pair
    that reaches ``t`` counts, and of the pairs so many are returned as connect all of them. The driver sees a row a bucket of words,
    a row a size class, and, with the cap, the words above it, which are at most twenty times as many as a text has on average.
    """
    spark, kind = sets.sparkSession, sets.schema["first_row"].dataType.simpleString()
    result = f"a {kind}, b {kind}, similarity double"
    n = F.size("words")
    size_class = F.floor(F.log(n.cast("double")) / -math.log(t) + _EPS).cast("int")
    classes = {r[0]: r[1:] for r in sets.groupBy(size_class).agg(F.sum(n), F.sum("count"), F.count(F.lit(1))).collect()}
    if not classes:
        return spark.createDataFrame([], result)
    flat = sets.select("count", F.explode("words").alias("id")).withColumn("bucket", F.col("id").bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    totals = flat.groupBy("bucket").agg(F.sum("count").alias("n")).toArrow()
    rank = np.zeros(BUCKETS, dtype=np.int64)
    rank[totals.column("bucket").to_numpy()] = totals.column("n").to_numpy()
    common = np.empty(0, dtype=np.int64)
    if not links:
        cap = max(50, int(sum(rows for _, rows, _ in classes.values()) * 0.05))
        heavy = spark.createDataFrame([(int(k),) for k in np.flatnonzero(rank > cap)], "bucket int")
        often = flat.join(F.broadcast(heavy), "bucket").groupBy("id").agg(F.sum("count").alias("n")).filter(F.col("n") > cap)
        common = often.select("id").toArrow().column("id").to_numpy()
    blocks, first = {}, 0
    for c, (number, _, own) in sorted(classes.items()):
        blocks[c] = range(first, first := first + max(1, -(-number // BLOCK_WORDS), -(-own // BLOCK_SETS) if links else 1))
    number = F.create_map(*[F.lit(v) for c, own in blocks.items() for v in (c, own.start)])
    parts = F.create_map(*[F.lit(v) for c, own in blocks.items() for v in (c, len(own))])
    block = (number[size_class] + F.pmod(F.xxhash64("first_row"), parts[size_class])).cast("int")
    shared = spark.sparkContext.broadcast((rank, common))
    placed = sets.select("first_row", block.alias("block"), "words").mapInArrow(
        lambda it: _ordered(*shared.value, it), f"first_row {kind}, block int, rare int, words array<bigint>"
    )
    path = scratch_path(spark, "issue-blocks")
    placed.repartition(first, "block").write.partitionBy("block").parquet(path)
    discard(sets)
    there = {r[0] for r in spark.read.parquet(path).select("block").distinct().collect()}
    pairs = [(x, y) for c, own in blocks.items() for x in own for d in (c - 1, c) for y in blocks.get(d, ())]
    pairs = [p for p in pairs if there.issuperset(p)]
    work = spark.createDataFrame(pairs, "x int, y int").repartition(max(1, min(len(pairs), 4 * spark.sparkContext.defaultParallelism)))
    return work.mapInArrow(lambda it: _met(path, t, links, it), result)
