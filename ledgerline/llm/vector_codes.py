"""Vector code compression: product codes by vantage-point trees.

Vectors of integer components are cut into equal parts; each part position has a
codebook that starts as that part of the first vectors and is refined by rounds of
assigning every part to its nearest entry and moving entries to their parts' means.
A code is the entry number of each part.

The nearest entry comes from a vantage-point tree over the entries of a part position.
A node keeps one entry, and per child the least and greatest distance of the child's
entries to it, rounded outwards. A child is left out only where the triangle inequality
puts all of it strictly farther than the best entry so far (a tie is visited, too), with
more slack than the square roots can be wrong by. Distances that decide are integers,
ties go to the lower entry. Whole batches descend at once: first each part takes its
near children down to a leaf, which gives it a good entry to compare with, then the
rows that a node cannot exclude visit it.

Codebooks and trees are bounded by entries x vector width and go to the tasks with the
function. Tasks add up their parts by entry before the shuffle; what comes back is one
row per component of the codebooks. Rows are read once a round and once for the codes.

Edge cases: rows without a vector, or with null or non-finite components, have no code.
Vectors shorter than the longest are filled up with zeros, and so is a width that the
parts do not divide. A null id comes last when the first vectors are chosen, rows that
share an id in the order of their vectors; repeated rows count each time. Fewer rows
than entries make as many entries as rows. Components beyond 262,144 raise an error. Errors are
added up per label, rows without a label together; a label may hold any part of the
rows. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import MARKS, salted_left_join
from ledgerline.llm.vectors import STEPS, integers, slices, usable, width
from ledgerline.plans.materialise import materialise

#: Parts of a vector, entries of a part's codebook, rounds of refinement.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Most entries of a leaf.
LEAF = 8
#: Bounds are taken this much wider than computed; square roots and sums err by some 1e-16.
SLACK = 1e-9
_FAR = np.iinfo(np.int64).max


class Node(NamedTuple):
    """A vantage entry with its children, or a leaf of entries (in ascending order)."""

    entries: np.ndarray
    cut: int = 0
    near: Node | None = None
    far: Node | None = None
    near_span: tuple[float, float] = (0.0, 0.0)
    far_span: tuple[float, float] = (0.0, 0.0)


def _squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, a row a point, a column an entry."""
    out = np.zeros((len(points), len(entries)), dtype=np.int64)
    for k in range(points.shape[1]):
        step = points[:, k, None] - entries[None, :, k]
        out += step * step
    return out


def _span(squared: np.ndarray) -> tuple[float, float]:
    return float(np.nextafter(np.sqrt(squared.min()), -np.inf)), float(np.nextafter(np.sqrt(squared.max()), np.inf))


def build(book: np.ndarray, members: np.ndarray | None = None) -> Node:
    """The tree of a part's codebook: the entry farthest from the mean is the vantage point."""
    members = np.arange(len(book)) if members is None else members
    if len(members) <= LEAF:
        return Node(members)
    own = book[members]
    top = int(np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1)))
    rest = np.delete(members, top)
    squared = _squared(book[rest], own[top : top + 1])[:, 0]
    cut = int(np.sort(squared)[(len(rest) - 1) // 2])
    near = squared <= cut
    if near.all():
        near[len(rest) // 2 :] = False
    return Node(
        members[top : top + 1], cut, build(book, rest[near]), build(book, rest[~near]), _span(squared[near]), _span(squared[~near])
    )


def nearest(book: np.ndarray, tree: Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each point's nearest entry, ties to the lower number."""
    best = np.full(len(points), _FAR)
    entry = np.full(len(points), len(book), dtype=np.int64)

    def offer(node: Node, rows: np.ndarray) -> np.ndarray:
        squared = _squared(points[rows], book[node.entries])
        at = squared.argmin(axis=1)
        found, number = squared[np.arange(len(rows)), at], node.entries[at]
        better = (found < best[rows]) | (found == best[rows]) & (number < entry[rows])
        best[rows[better]], entry[rows[better]] = found[better], number[better]
        return squared[:, 0]

    def descend(node: Node, rows: np.ndarray) -> None:
        squared = offer(node, rows)
        if node.near is not None:
            inside = squared <= node.cut
            for child, own in ((node.near, rows[inside]), (node.far, rows[~inside])):
                if len(own):
                    descend(child, own)

    def visit(node: Node, rows: np.ndarray) -> None:
        squared = offer(node, rows)
        if node.near is None:
            return
        away = np.sqrt(squared.astype(np.float64))
        for child, (low, high) in ((node.near, node.near_span), (node.far, node.far_span)):
            gap = np.maximum(low - away, away - high) - SLACK * (1 + away + high)
            own = rows[(gap <= 0) | (gap * gap <= best[rows] * (1 + SLACK))]
            if len(own):
                visit(child, own)

    everyone = np.arange(len(points))
    if len(points) and len(book):
        descend(tree, everyone)
        visit(tree, everyone)
    return entry, best


class Codebooks:
    """Entries by part, number and component, and the tree of each part."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.trees = [build(book) for book in entries]
        self.width = entries.shape[0] * entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assigned(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parts of each vector, and per part its entry and squared distance."""
        parts, _, size = self.entries.shape
        cut = integers(column, self.width).reshape(len(column), parts, size)
        found = [nearest(self.entries[p], self.trees[p], cut[:, p]) for p in range(parts)]
        return cut, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


_SUMS = "part int, entry int, place int, total long, n long"


def _summed(books: Codebooks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and counts of a task's parts by entry."""
    parts, entries, size = books.entries.shape
    total, n = np.zeros((parts * entries, size), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
    for batch in slices(batches, books.width):
        cut, found, _ = books.assigned(batch.column(0))
        at = (found + np.arange(parts) * entries).ravel()
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        total[at[order][first]] += np.add.reduceat(cut.reshape(-1, size)[order], first, axis=0)
        n += np.bincount(at, minlength=len(n))
    used = np.flatnonzero(n)
    if len(used):
        place = np.tile(np.arange(size, dtype=np.int32), len(used))
        used_ = np.repeat(used, size)
        yield pa.RecordBatch.from_arrays(
            [pa.array((used_ // entries).astype(np.int32)), pa.array((used_ % entries).astype(np.int32)), pa.array(place),
             pa.array(total[used].ravel()), pa.array(n[used_])],
            ["part", "entry", "place", "total", "n"],
        )


def train(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of all usable rows."""
    kept = embeddings.filter(usable()).select("vec_id", "embedding")
    size = max(1, -(-width(kept) // parts))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    start = integers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), parts * size)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, size).transpose(1, 0, 2)))
    for _ in range(rounds if first else 0):
        moved = books.entries.copy()
        for r in _sums(kept, books).collect():
            moved[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
        books = Codebooks(moved)
    return books


def _sums(kept: DataFrame, books: Codebooks) -> DataFrame:
    """One row per component of a used entry: as many as the codebooks hold, at most."""
    tasks = kept.select("embedding").mapInArrow(lambda it: _summed(books, it), _SUMS)
    return tasks.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _coded(books: Codebooks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, books.width):
        _, found, squared = books.assigned(batch.column("embedding"))
        digits = max(2, len(f"{books.entries.shape[1] - 1:x}"))
        text = [f"{k:0{digits}x}" for k in range(books.entries.shape[1])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(["".join([text[k] for k in row]) for row in found.tolist()], pa.string()),
             pa.array(squared.sum(axis=1))],
            ["vec_id", "label", "code", "error"],
        )


def encode(embeddings: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error`` of every usable row."""
    kinds = [embeddings.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    rows = embeddings.filter(usable()).select("vec_id", "label", "embedding")
    return rows.mapInArrow(lambda it: _coded(books, it), "vec_id {}, label {}, code string, error long".format(*kinds))


def decode(code: str, books: Codebooks) -> list[float]:
    """The vector that a code stands for."""
    digits = len(code) // books.entries.shape[0]
    entries = [int(code[i : i + digits], 16) for i in range(0, len(code), digits)]
    return (np.concatenate([books.entries[p, k] for p, k in enumerate(entries)]) / STEPS).tolist()


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``: codes of all usable rows and the error of each label."""
    books = train(embeddings, parts, entries, rounds)
    coded = materialise(encode(embeddings, books), "vector-codes")
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = coded.withColumn("_label", key).withColumn("_row", F.monotonically_increasing_id())
    totals = coded.groupBy("_label").agg(F.sum("error").alias("label_error"))
    totals = materialise(totals, "label-errors")
    if totals.count() <= MARKS:
        out = coded.join(F.broadcast(totals), "_label", "left")
    else:
        out = salted_left_join(coded, totals, "_label", "_row")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
