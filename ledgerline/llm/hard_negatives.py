"""Hard negatives by dual-tree search.

For each anchor the best rows of its own label are its positives; for each positive the
best rows of other labels whose score lies in a window below the positive's are its negatives.
Scores are inner products of integer vectors.

Two trees of balls (``dual_tree``) are grown, over anchors and over all rows, each on a sample
whose size is bounded; every row is put into a leaf, and radii, sizes and labels of the leaves come
from all rows, so bounds hold for every row. Rows of a leaf are dealt over tiles of a bounded
number of rows (a leaf of equal vectors is many tiles), anchors of a leaf over groups.

A group of anchors is held against the nodes of the tree of rows: where the interval of
inner products of group and node misses the windows of all anchors, or the labels
rule it out, nothing below the node is looked at. Tiles and groups go in blocks of ``TOGETHER``, and the tiles
left meet the groups of a block in one task; there a second pair of trees, over a group's and a tile's vectors, is
descended at once, and leaf pairs are scored exactly, in one product where anchors ask for the same rows.
The k-th best score a task has seen of an anchor and window raises the lower end of the window, one comparison a
product finds what reaches it, and only that is looked at by label and window. At most k rows per anchor and window leave a task.

A search goes in rounds: about a 64th of a group's tiles by their bound, then 8 times as many, then the
rest. After each round the k-th best score so far raises the lower end of an anchor's window for all tasks, so
what later rounds emit stays in proportion to the anchors, and a tile is considered in one round only.
How much is pruned depends on the data: of vectors without clusters in many dimensions
every pair of tiles may have to be scored, and work grows with anchors x rows.

Edge cases: rows without label or vector, or with null or non-finite components, take no
part; shorter vectors are filled up with zeros; a null id is no anchor and comes last among
equal scores; repeated rows are rows of their own, and each repeated anchor has results of its own;
an anchor without other rows of its label has none; a negative positive score leaves an
empty window; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.llm.dual_tree import Tree, descend, exact_kind, interval
from ledgerline.llm.vectors import integers, slices, usable, width
from ledgerline.plans.materialise import discard, materialise

#: Best rows of the own label, and best rows per window.
POSITIVES, NEGATIVES = 5, 10
#: Sampled vectors a tree is grown on, at most, and components of all of them.
SAMPLE, CELLS = 16_384, 1 << 22
#: Rows of a tile, anchors of a group (fewer if vectors are wide) and components of a tile.
TILE, GROUP, WIDE = 2048, 512, 1 << 17
#: Rows of a leaf in a tile's tree and in a group's.
BLOCK, HANDFUL = 256, 32
#: Tiles, and groups, of a block.
TOGETHER = 16
#: Tiles of a round, as a multiple of all before.
GROWTH = 8
_LEAST, _MOST = -(1 << 62), 1 << 62


class Placement(NamedTuple):
    """A tree whose balls cover all rows put into it, and per leaf the number of tiles, of tiles before it, and the labels."""

    tree: Tree
    tiles: np.ndarray
    start: np.ndarray
    mask: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _mask(labels: np.ndarray) -> np.ndarray:
    """A bit per label, shared by labels that are equal modulo 63."""
    return np.left_shift(np.int64(1), np.mod(labels, 63).astype(np.int64))


def _sampled(rows: DataFrame, total: int, width: int) -> np.ndarray:
    """Vectors of about ``SAMPLE`` rows, chosen by a hash of the row's number."""
    most = max(64, min(SAMPLE, CELLS // max(1, width)))
    part = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit(max(1, (1 << 20) * most // max(1, total)))
    drawn = (rows.filter(part) if total > most else rows).select("vector").toArrow().column(0).combine_chunks()
    return drawn.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _stepped(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, width):
        whole = integers(batch.column("embedding"), width).astype(np.int32)
        offsets = np.arange(len(whole) + 1, dtype=np.int32) * width
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("vec_id"), batch.column("label"), pa.ListArray.from_arrays(offsets, whole.ravel())],
            ["row", "vec_id", "label", "vector"],
        )


def _placed(tree: Tree, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = tree.center.shape[1]
    for batch in slices(batches, size):
        vectors = batch.column("vector").flatten().to_numpy().reshape(-1, size).astype(np.float64)
        leaf = tree.route(vectors)
        away = np.sqrt(((vectors - tree.center[tree.node_of_leaf[leaf]]) ** 2).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(leaf.astype(np.int32)), pa.array(away)], ["row", "vec_id", "label", "vector", "leaf", "away"]
        )


def _place(rows: DataFrame, total: int, size: int, each: int, label: str) -> tuple[Placement, DataFrame]:
    """Grow a tree, put all rows into tiles of about ``each`` rows, and pack each tile into one row: ``block, number, rows``."""
    each = max(16, min(each, WIDE // size))
    tree = Tree(_sampled(rows, total, size), total, each * 3 // 4)
    schema = f"row long, vec_id {rows.schema['vec_id'].dataType.simpleString()}, label long, vector array<int>, leaf int, away double"
    placed = materialise(rows.mapInArrow(lambda it: _placed(tree, it), schema), f"{label}-placed")
    bit = F.expr("shiftleft(1L, cast(pmod(label, 63) as int))")
    stats = placed.groupBy("leaf").agg(F.max("away"), F.count(F.lit(1)), F.bit_or(bit), F.min("label"), F.max("label")).collect()
    radius, tiles, mask, low, high = np.zeros(len(tree.members)), *np.zeros((4, len(tree.members)), dtype=np.int64)
    for leaf, away, n, *labels in stats:
        radius[leaf], tiles[leaf], (mask[leaf], low[leaf], high[leaf]) = away, -(-n // each), labels
    tree.cover(radius)
    start = np.cumsum(tiles) - tiles
    counts = placed.sparkSession.createDataFrame([(k, int(n), int(at)) for k, (n, at) in enumerate(zip(tiles, start, strict=True))], "leaf int, tiles int, start int")
    dealt = placed.join(F.broadcast(counts), "leaf").withColumn("number", (F.col("start") + F.pmod(F.xxhash64("row"), F.col("tiles"))).cast("int"))
    packed = dealt.groupBy("number").agg(F.collect_list(F.struct("row", "vec_id", "label", "vector")).alias("rows"))
    packed = materialise(packed.select(F.expr(f"number div {TOGETHER}").cast("int").alias("block"), "number", "rows"), f"{label}-tiles", TOGETHER)
    discard(placed)
    return Placement(tree, tiles, start, mask, low, high), packed


class Packed:
    """Rows of a tile or group as arrays, and their tree."""

    def __init__(self, rows: pa.StructArray, block: int):
        self.row, self.label = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("row", "label"))
        ids = rows.field("vec_id")
        self.vec_id, self.known = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
        self.vector = rows.field("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(self.row), -1)
        self.tree = Tree(self.vector, len(self.row), block)
        self.reach = float(np.sqrt((self.vector.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
        members = self.tree.members
        self.mask = self.tree.gathered(np.array([np.bitwise_or.reduce(_mask(self.label[m])) for m in members]), np.bitwise_or)
        self.low = self.tree.gathered(np.array([self.label[m].min() for m in members]), np.minimum)
        self.high = self.tree.gathered(np.array([self.label[m].max() for m in members]), np.maximum)
        self.cast: dict[type, np.ndarray] = {}

    def of_kind(self, kind: type) -> np.ndarray:
        """The vectors in another arithmetic, kept for the next pair."""
        if kind not in self.cast:
            self.cast[kind] = self.vector.astype(kind)
        return self.cast[kind]

    def of_nodes(self, nodes: list[int]) -> np.ndarray | slice:
        """The points of some leaves."""
        if len(nodes) == len(self.tree.members):
            return slice(None)
        return np.concatenate([self.tree.members[self.tree.leaf[k]] for k in nodes])


def _windows(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the windows of a group's anchors, a row an anchor; missing ones are empty."""
    sizes = np.diff(column.offsets.to_numpy())
    held = column.flatten()
    held = held if len(held) else None
    slots = 1 + (int(held.field("slot").to_numpy(zero_copy_only=False).max()) if held is not None else 0)
    low, high = np.ones((len(sizes), slots), dtype=np.int64), np.zeros((len(sizes), slots), dtype=np.int64)
    if held is None:
        return low, high
    at = np.repeat(np.arange(len(sizes)), sizes), held.field("slot").to_numpy(zero_copy_only=False)
    low[at], high[at] = (held.field(k).to_numpy(zero_copy_only=False) for k in ("low", "high"))
    return low, high


def _prospects(place: Placement, same: bool, first: int, last: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles a group of anchors has to be held against in this round, the best bound first, a row a block of them: ``block, own, tiles, rows``."""
    tree = place.tree
    norm = np.sqrt((tree.center**2).sum(axis=1))
    for batch in batches:
        for i in range(batch.num_rows):
            group = batch.column("rows")[i].values
            low, high = _windows(group.field("windows"))
            if not (low <= high).any():
                continue
            low, high, labels = low[low <= high], high[low <= high], group.field("label").to_numpy(zero_copy_only=False)
            vectors = group.field("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(labels), -1)
            center = vectors.mean(axis=0)
            radius = np.sqrt(((vectors - center) ** 2).sum(axis=1).max())
            product = tree.center @ center
            least, most = interval(product, np.sqrt((center**2).sum()), radius, norm, tree.radius)
            if same:
                fit = (place.mask & np.bitwise_or.reduce(_mask(labels))) != 0
                order = most[tree.node_of_leaf]
            else:
                fit = (place.low != place.high) | (labels != place.low[:, None]).any(axis=1)
                order = -np.abs(product[tree.node_of_leaf] - high.mean())
            alive = (most >= low.min()) & (least <= high.max())
            for k in np.flatnonzero(tree.left >= 0).tolist():
                alive[[tree.left[k], tree.right[k]]] &= alive[k]
            leaves = np.argsort(-order, kind="stable")
            leaves = leaves[fit[leaves] & (place.tiles[leaves] > 0)]
            ends = np.cumsum(place.tiles[leaves])
            asked: dict[int, list[int]] = {}
            for leaf, end in zip(leaves.tolist(), ends.tolist(), strict=True):
                begin = end - int(place.tiles[leaf])
                a, b = max(first, begin) - begin, min(last, end) - begin
                if a < b and alive[tree.node_of_leaf[leaf]]:
                    for number in range(int(place.start[leaf]) + a, int(place.start[leaf]) + b):
                        asked.setdefault(number // TOGETHER, []).append(number)
            for block, numbers in asked.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), batch.column("own").slice(i, 1), pa.array([numbers], pa.list_(pa.int32())), batch.column("rows").slice(i, 1)],
                    ["block", "own", "tiles", "rows"],
                )


def _best(scores: np.ndarray, fit: np.ndarray, k: int, vec_id: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k leading scores of each row among those that fit; ties by smaller id."""
    if scores.shape[1] > k:
        held = np.where(fit, scores, _LEAST if scores.dtype.kind == "i" else -np.inf)
        fit = fit & (scores >= np.partition(held, -k, axis=1)[:, -k, None])
    i, j = np.nonzero(fit)
    order = np.lexsort((vec_id[j], ~known[j], -scores[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


class Kept:
    """The leading rows of a group's anchors and windows so far, and the least score that still counts in each."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        live = low <= high
        self.k, self.slots = k, low.shape[1]
        self.least, self.high = np.where(live, low, _MOST), np.where(live, high, _LEAST)
        self.held = [np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, bool, np.int64)]
        self.new: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, i: np.ndarray, slot: np.ndarray, score: np.ndarray, tile: Packed, j: np.ndarray) -> None:
        self.new.append([i * self.slots + slot, score.astype(np.int64), tile.vec_id[j], tile.known[j], tile.row[j]])
        self.waiting += len(i)

    def settle(self) -> None:
        """Cut to the k leading rows of each anchor and window, and raise what counts to the k-th score."""
        if not self.waiting:
            return
        key, score, vec_id, known, row = (np.concatenate(x) for x in zip(self.held, *self.new, strict=True))
        order = np.lexsort((row, vec_id, ~known, -score, key))
        key = key[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        order, key = order[place < self.k], key[place < self.k]
        self.held = [key, score[order], vec_id[order], known[order], row[order]]
        full = np.flatnonzero(place[place < self.k] == self.k - 1)
        least = self.least.ravel()
        least[key[full]] = np.maximum(least[key[full]], self.held[1][full])
        self.new, self.waiting = [], 0

    def ends(self, tree: Tree) -> list[np.ndarray]:
        """Per node of the anchors' tree the least and the largest score that counts in any window below it."""
        return [
            tree.gathered(np.array([f(x[m]) for m in tree.members]), g)
            for x, f, g in ((self.least, np.min, np.minimum), (self.high, np.max, np.maximum))
        ]


def _scored(same: bool, k: int, kind: pa.DataType, groups: pa.Table, tiles: pa.Table) -> pa.Table:
    """Leading candidates of each anchor and window in a block of tiles: ``anchor, slot, row, vec_id, score``."""
    stored = {number: n for n, number in enumerate(tiles.column("number").to_pylist())}
    packed: dict[int, Packed] = {}
    out = []
    for n in range(groups.num_rows):
        group = groups.column("rows")[n].values
        anchors, kept = Packed(group, HANDFUL), Kept(*_windows(group.field("windows")), k)
        ends = kept.ends(anchors.tree)
        for number in groups.column("tiles")[n].as_py():
            if number not in packed:
                packed[number] = Packed(tiles.column("tile_rows")[stored[number]].values, BLOCK)
            _leaf_pairs(anchors, kept, ends, packed[number], same)
            if kept.waiting > max(4096, len(kept.held[0])):
                kept.settle()
                ends = kept.ends(anchors.tree)
        kept.settle()
        key, score, vec_id, known, row = kept.held
        out.append(pa.table(
            [pa.array(anchors.row[key // kept.slots]), pa.array((key % kept.slots).astype(np.int32)), pa.array(row), pa.array(vec_id, kind, mask=~known), pa.array(score)],
            ["anchor", "slot", "row", "vec_id", "score"],
        ))
    return pa.concat_tables(out)


def _leaf_pairs(anchors: Packed, kept: Kept, ends: list[np.ndarray], tile: Packed, same: bool) -> None:
    """Descend the trees of a group and a tile at once and add what leaf pairs hold."""

    def asked(a: np.ndarray, c: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        reached = (most >= ends[0][a]) & (least <= ends[1][a])
        if same:
            return reached & ((anchors.mask[a] & tile.mask[c]) != 0)
        one = (anchors.low[a] == anchors.high[a]) & (tile.low[c] == tile.high[c])
        return reached & ~(one & (anchors.low[a] == tile.low[c]))

    a, c = descend(anchors.tree, tile.tree, asked)
    alike: dict[tuple, list[int]] = {}  # anchors' leaves that ask for the same leaves of the tile
    order = np.lexsort((c, a))
    a, c = a[order], c[order]
    nodes, starts = np.unique(a, return_index=True)
    for node, others in zip(nodes.tolist(), np.split(c, starts[1:]), strict=True):
        alike.setdefault(tuple(others.tolist()), []).append(node)
    kind = exact_kind(anchors.reach, tile.reach)
    for others, own in alike.items():
        _products(anchors, kept, tile, anchors.of_nodes(own), tile.of_nodes(list(others)), same, kind)


def _products(anchors: Packed, kept: Kept, tile: Packed, own: np.ndarray | slice, others: np.ndarray | slice, same: bool, kind: type) -> None:
    """Score some anchors against some rows of a tile and add what counts."""
    scores = anchors.of_kind(kind)[own] @ tile.of_kind(kind)[others].T
    most = {np.float32: 2**24, np.float64: 2**53}.get(kind, _MOST)  # beyond every score, and whole in its arithmetic
    least, high = (np.clip(x[own], -most, most).astype(kind) for x in (kept.least, kept.high))
    at = np.flatnonzero(scores >= least.min(axis=1)[:, None])
    mine, theirs = np.arange(len(anchors.row))[own], np.arange(len(tile.row))[others]
    if len(at) > max(1024, scores.size // 16):
        equal = anchors.label[own][:, None] == tile.label[others]
        pairs = equal & (anchors.row[own][:, None] != tile.row[others]) if same else ~equal
        for slot in range(kept.slots):
            fit = pairs & (scores >= least[:, slot, None]) & (scores <= high[:, slot, None])
            i, j = _best(scores, fit, kept.k, tile.vec_id[others], tile.known[others])
            kept.add(mine[i], np.full(len(i), slot), scores[i, j], tile, theirs[j])
        return
    i, j = np.divmod(at, scores.shape[1])
    equal = anchors.label[mine[i]] == tile.label[theirs[j]]
    fit = equal & (anchors.row[mine[i]] != tile.row[theirs[j]]) if same else ~equal
    i, j, found = i[fit], j[fit], scores.ravel()[at[fit]]
    n, slot = np.nonzero((found[:, None] >= least[i]) & (found[:, None] <= high[i]))
    if len(n):
        kept.add(mine[i[n]], slot, found[n], tile, theirs[j[n]])


def _leading(found: DataFrame, k: int) -> DataFrame:
    """The k leading rows of each anchor and window, with their ``place`` from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _search(groups: DataFrame, windows: DataFrame, place: Placement, tiles: DataFrame, same: bool, k: int) -> DataFrame:
    """``anchor, slot, row, vec_id, score, place``: the k leading candidates in each window of each anchor.

    ``groups`` has ``block, number, rows`` of anchors, ``windows`` has ``anchor, slot, low, high``.
    """
    kind = tiles.schema["rows"].dataType.elementType["vec_id"].dataType.simpleString()
    held_as = to_arrow_type(tiles.schema["rows"].dataType.elementType["vec_id"].dataType)
    anchors = groups.select(F.col("block").alias("own"), "number", F.explode("rows").alias("r")).select("own", "number", "r.*")
    total = int(place.tiles.sum())
    best, first, last = None, 0, -(-total // GROWTH**2)
    while first < total:
        now = windows
        if best is not None:
            full = best.groupBy("anchor", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
            now = now.join(full, ["anchor", "slot"], "left").withColumn("low", F.greatest("low", F.coalesce("least", "low")))
        own = now.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("windows"))
        held = anchors.join(own.withColumnRenamed("anchor", "row"), "row")
        # In one order, so that bounds come out the same in every round.
        asking = held.groupBy("own", "number").agg(F.sort_array(F.collect_list(F.struct("row", "vec_id", "label", "vector", "windows"))).alias("rows")).select("own", "rows")
        span = asking.schema["rows"].dataType.simpleString()
        near = asking.mapInArrow(lambda it, a=first, b=last: _prospects(place, same, a, b, it), f"block int, own int, tiles array<int>, rows {span}")
        # A pair of a tile and a block of groups stands for millions of products, so of pairs there are few.
        wanted = near.select(F.col("own").alias("for"), F.explode("tiles").alias("number")).distinct()
        met = tiles.select(F.col("block").alias("of"), "number", F.col("rows").alias("tile_rows")).join(F.broadcast(wanted), "number")
        found = near.groupBy("block", "own").cogroup(met.groupBy("of", "for")).applyInArrow(
            lambda groups, rows: _scored(same, k, held_as, groups, rows), f"anchor long, slot int, row long, vec_id {kind}, score long"
        )
        if best is not None:
            found = found.unionByName(best.drop("place"))
        following = materialise(_leading(found, k), "leading")
        if best is not None:
            discard(best)
        best, first, last = following, last, last * GROWTH
    return best


def mine(
    embeddings: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least: int = 30, most: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` and ``label`` are columns over ``embeddings``; negatives score from ``least`` to
    ``most`` hundredths of the positive's score.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    usable_rows = embeddings.filter(usable()).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", (F.col("label") if label is None else label).cast("long").alias("label"), "embedding",
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).filter("label is not null")
    result = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    usable_rows = materialise(usable_rows, "usable-vectors")
    size = max(1, width(usable_rows))
    vectors = usable_rows.mapInArrow(lambda it: _stepped(size, it), f"row long, vec_id {kind}, label long, vector array<int>")
    total, asking = usable_rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    if not asking:
        return spark.createDataFrame([], result)
    own = usable_rows.filter("anchor").mapInArrow(lambda it: _stepped(size, it), f"row long, vec_id {kind}, label long, vector array<int>")
    place, tiles = _place(vectors, total, size, TILE, "rows")
    _, groups = _place(own, asking, size, GROUP, "anchors")
    discard(usable_rows)
    anchors = groups.select(F.explode("rows").alias("r")).select(F.col("r.row").alias("anchor"), F.col("r.vec_id").alias("anchor_id"))
    everything = anchors.select("anchor", F.lit(0).alias("slot"), F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high"))
    chosen = _search(groups, everything, place, tiles, True, positives)
    chosen = chosen.select("anchor", (F.col("place") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = chosen.filter("positive_score >= 0").select(
        "anchor", "slot", F.expr(f"({least} * positive_score + 99) div 100").alias("low"), F.expr(f"{most} * positive_score div 100").alias("high")
    )
    found = _search(groups, windows, place, tiles, False, negatives)
    return found.join(chosen, ["anchor", "slot"]).join(anchors, "anchor").select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Anchors are the ids that 100 divides; where 7 divides the id, the label goes on by one modulo 10."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings, F.col("vec_id") % 100 == 0, label)
