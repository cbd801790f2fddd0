"""Benchmark decontamination by BM25 retrieval with block-max WAND.

Test items form an inverted index: postings in blocks of ``BLOCK``, each block
with its largest impact. Every document is read as overlapping passages, every
passage is a query, and all items with at least ``RETRIEVE`` of their own
best score are retrieved. A hit counts when enough five-word shingles of the item as a
whole, or of both its question part and its answer part, are found in the passage; the
shares found of both parts are reported.

Impacts are divided by the item's score for its own text, so one threshold serves
all items. Most passages are dismissed by the pivot test in bulk: an item's
commonest terms together stay below the threshold (``IDLE``), so a passage that
lacks enough of the remaining, essential ones cannot reach it. What passes is
searched exactly, document at a time, skipping blocks whose maxima cannot reach
the threshold.

The index is sized before it is shipped: items are dealt into as many blocks of
at most ``INDEX_BYTES`` of text as needed, and all documents are held against each.
Document frequencies and lengths are those of all items, whatever the blocks.

Edge cases: null or blank texts hold nothing; an item without words is never
found, one without an id is; items shorter than five words are one shingle; repeated items and rows are
reported each; rows are judged one by one, so rows that share a ``doc_id`` or have none
keep their own fate; a very long text is read passage by passage to its end; of equally
good passages for an item the first is reported; empty tables give an empty result;
other columns are ignored, and ``drop_contaminated`` passes them on.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import raw_texts, text_slices, words

#: BM25 constants, postings in a block, words in a shingle.
K1, B, BLOCK, SHINGLE = 1.2, 0.75, 16, 5
#: Share of an item's own score that retrieves it, and what its idle terms may add up to.
RETRIEVE, IDLE = 0.6, 0.45
#: Share of shingles found that confirms an item or a part, and the answer's share of an item's words.
CONFIRM, ANSWER = 0.8, 1 / 3
#: Bytes of item text in one index; measured on words of Zipf's law, 8 MiB take 72 MiB of memory, 93 while built, 21 shipped.
INDEX_BYTES = 8 << 20


def _shingles(found: list[bytes]) -> list[bytes]:
    n = min(SHINGLE, len(found))
    return [b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)] if found else []


class Statistics(NamedTuple):
    """What BM25 and the passages take from all items, whatever block an item is in."""

    n: int
    average: float
    longest: int
    frequency: dict[bytes, int]


def statistics(texts: list[bytes]) -> Statistics:
    """Statistics of items that are all in one list."""
    sets = [found for raw in texts if (found := words(raw))]
    sizes = [len(f) for f in sets]
    return Statistics(len(sets), sum(sizes) / max(1, len(sizes)), max(sizes, default=1), Counter(t for f in sets for t in set(f)))


class ItemIndex:
    """Postings of test items as flat arrays, a term's postings side by side, with per-block maxima.

    An item's shingles are made when a passage has retrieved it, not stored.
    """

    def __init__(self, items: list[tuple[int, bytes]], known: Statistics | None = None):
        held = [(i, raw) for i, raw in items if words(raw)]
        self.ids, self.texts = [i for i, _ in held], [raw for _, raw in held]
        known = known or statistics(self.texts)
        self.longest = known.longest
        idf = {t: math.log(1 + (known.n - n + 0.5) / (n + 0.5)) for t, n in known.frequency.items()}
        numbers: dict[bytes, int] = {}
        term, item, share, essential = array("i"), array("i"), array("d"), array("b")
        self.idle, self.own = array("d"), array("d")
        for at, raw in enumerate(self.texts):
            found = words(raw)
            norm = K1 * (1 - B + B * len(found) / known.average)
            impact = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in Counter(found).items()}
            own = sum(impact.values())
            self.own.append(own)
            idle, quiet = 0.0, True
            for t, w in sorted(impact.items(), key=lambda x: (x[1], len(x[0]), x[0])):
                quiet = quiet and idle + w / own <= IDLE
                idle += w / own if quiet else 0
                term.append(numbers.setdefault(t, len(numbers)))
                item.append(at)
                share.append(w / own)
                essential.append(not quiet)
            self.idle.append(idle)
        order = np.argsort(np.frombuffer(term, np.int32), kind="stable") if term else np.empty(0, np.int64)
        ranked = np.frombuffer(term, np.int32)[order] if term else np.empty(0, np.int32)
        self.item = array("i", np.frombuffer(item, np.int32)[order].tobytes()) if term else item
        self.share = array("d", np.frombuffer(share, np.float64)[order].tobytes()) if term else share
        need = np.frombuffer(essential, np.int8)[order].astype(bool) if term else np.empty(0, bool)
        edges = np.searchsorted(ranked, np.arange(len(numbers) + 1)).tolist()
        needed = np.concatenate([[0], np.cumsum(need)])[edges].tolist()
        self.essential_item = array("i", np.frombuffer(self.item, np.int32)[need].tobytes()) if term else array("i")
        self.essential_share = array("d", np.frombuffer(self.share, np.float64)[need].tobytes()) if term else array("d")
        # Term -> its postings, its first block; term -> its essential postings, where it has any.
        self.block_last, self.block_most = array("i"), array("d")
        self.spans: dict[bytes, tuple[int, int, int, float]] = {}
        self.essential: dict[bytes, tuple[int, int]] = {}
        for t, k in numbers.items():
            lo, hi = edges[k], edges[k + 1]
            first = len(self.block_last)
            for b in range(lo, hi, BLOCK):
                stop = min(b + BLOCK, hi)
                self.block_last.append(self.item[stop - 1])
                self.block_most.append(max(self.share[b:stop]))
            self.spans[t] = (lo, hi, first, max(self.block_most[first:]))
            if needed[k] < needed[k + 1]:
                self.essential[t] = (needed[k], needed[k + 1])

    def postings(self, term: bytes) -> list[tuple[int, float]]:
        """``item, share`` of a term's postings."""
        lo, hi = self.spans.get(term, (0, 0))[:2]
        return list(zip(self.item[lo:hi], self.share[lo:hi], strict=True))

    def parts(self, item: int) -> tuple[list[bytes], list[bytes], list[bytes]]:
        """Shingles of an item, of its question part and of its answer part."""
        found = words(self.texts[item])
        cut = len(found) - max(1, round(len(found) * ANSWER)) if len(found) > 1 else len(found)
        return _shingles(found), _shingles(found[:cut]), _shingles(found[cut:])

    def search(self, terms: set[bytes], threshold: float = RETRIEVE) -> list[tuple[int, float]]:
        """All ``(item, share)`` of at least the threshold for a passage's distinct terms (block-max WAND)."""
        eps, items, shares = 1e-9, self.item, self.share
        # A cursor: current item, place, end, the term's first place, first block and greatest share.
        lists = [[items[s[0]], s[0], s[1], s[0], s[2], s[3]] for t in terms if (s := self.spans.get(t))]
        out = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, None
            for k, c in enumerate(lists):
                bound += c[5]
                if bound >= threshold - eps:
                    pivot = k
                    break
            if pivot is None:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # Block maxima around the pivot, and the first item beyond any of those blocks.
            bound, beyond = 0.0, math.inf if pivot + 1 == len(lists) else lists[pivot + 1][0]
            for _, at, stop, start, block, _most in lists[: pivot + 1]:
                b, end = block + (at - start) // BLOCK, block + (stop - start - 1) // BLOCK
                while b <= end and self.block_last[b] < item:
                    b += 1
                if b <= end:
                    bound += self.block_most[b]
                    beyond = min(beyond, self.block_last[b] + 1)
            if bound < threshold - eps:
                goal = max(beyond, item + 1)
            elif lists[0][0] == item:
                score = sum(shares[c[1]] for c in lists[: pivot + 1])
                if score >= threshold - eps:
                    out.append((item, score))
                goal = item + 1
            else:
                goal = item
            for c in lists[: pivot + 1]:
                at, stop = c[1], c[2]
                while at < stop and items[at] < goal:
                    at += 1
                c[1] = at
                c[0] = items[at] if at < stop else -1
            lists = [c for c in lists if c[1] < c[2]]
        return out

    def passages(self, found: list[bytes]) -> list[int]:
        """Starts of the passages that the pivot test leaves."""
        stride, essential = self.longest, self.essential
        items, shares = self.essential_item, self.essential_share
        hits = [(i, p) for i, w in enumerate(found) if (p := essential.get(w))]
        if not hits:
            return []
        last = max(0, -(-len(found) // stride) - 2)
        seen: set[tuple[int, bytes]] = set()
        sums: Counter = Counter()
        for i, (lo, hi) in hits:
            w, slot = found[i], i // stride
            for window in {min(slot, last), max(0, min(slot - 1, last))}:
                if (window, w) not in seen:
                    seen.add((window, w))
                    for k in range(lo, hi):
                        sums[window, items[k]] += shares[k]
        idle = self.idle
        return sorted({window for (window, item), s in sums.items() if s + idle[item] >= RETRIEVE - 1e-9})

    def leaks(self, raw: bytes) -> list[tuple[int, int, float, float, float, float]]:
        """``item, first word, score, share, question, answer`` of the best passage per confirmed item."""
        found, best = words(raw), {}
        for window in self.passages(found):
            start = window * self.longest
            passage = found[start : start + 2 * self.longest]
            sets: dict[int, set[bytes]] = {}
            for item, share in self.search(set(passage)):
                covered = []
                for part in self.parts(item):
                    if not part:
                        continue
                    n = part[0].count(b" ") + 1
                    if n not in sets:
                        sets[n] = {b" ".join(passage[i : i + n]) for i in range(len(passage) - n + 1)}
                    covered.append(sum(s in sets[n] for s in part) / len(part))
                if covered[0] >= CONFIRM or min(covered[1:]) >= CONFIRM:
                    question, answer = covered[1], covered[-1]
                    row = (item, start, share * self.own[item], share, question, answer)
                    if item not in best or (question + answer, share) > (sum(best[item][4:]), best[item][3]):
                        best[item] = row
        return list(best.values())


def _scanned(index: ItemIndex, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            rows = [
                (row, index.ids[item], *rest)
                for row, raw in enumerate(raw_texts(part))
                for item, *rest in index.leaks(raw)
            ]
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [part.column("doc_id").take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
            columns += [pa.array([float(r[k]) for r in rows], pa.float64()) for k in range(3, 7)]
            yield pa.RecordBatch.from_arrays(columns, list(NAMES))


NAMES = ("doc_id", "item_id", "first_word", "bm25", "own_share", "question_overlap", "answer_overlap")


def _indexes(documents: DataFrame, benchmark: DataFrame, index_bytes: int) -> Iterator[Broadcast]:
    """Broadcast indexes of the blocks that the items are dealt into by hash, each of bounded text."""
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = F.split(F.lower(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")
    size = F.size(F.filter(found, lambda w: w != ""))
    total, n, every, longest = items.agg(
        F.sum(F.octet_length("text")), F.count_if(size > 0), F.sum(size), F.max(size)
    ).first()
    blocks = max(1, math.ceil((total or 0) / index_bytes))
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b)
        rows = [(r["item_id"], r["text"].encode()) for r in own.orderBy("item_id", "text").toLocalIterator()]
        known = None
        if blocks > 1:  # document frequencies over all items, of this block's terms
            terms = spark.createDataFrame([(bytearray(t),) for t in {t for _, raw in rows for t in words(raw)}], "term binary")
            counted = items.select("text").mapInArrow(_terms, "term binary").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
            frequency = {bytes(r["term"]): r["n"] for r in counted.join(terms, "term", "left_semi").toLocalIterator()}
            known = Statistics(n, every / max(1, n), max(1, longest), frequency)
        yield spark.sparkContext.broadcast(ItemIndex(rows, known))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct terms."""
    for batch in batches:
        for raw in raw_texts(batch):
            yield pa.RecordBatch.from_arrays([pa.array(list(set(words(raw))), pa.binary())], ["term"])


def leaks(documents: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document and benchmark item that it contains."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, first_word long, bm25 double, own_share double, question_overlap double, answer_overlap double"
    rows, found = documents.select("doc_id", "text"), None
    for shared in _indexes(documents, benchmark, index_bytes):
        part = rows.mapInArrow(lambda it, s=shared: _scanned(s.value, it), schema)
        found = part if found is None else found.union(part)
    return found


def _clean(index: ItemIndex, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch):
            yield part.filter(pa.array([not index.leaks(raw) for raw in raw_texts(part)], pa.bool_()))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; each row is judged where it is read."""
    left = documents
    for shared in _indexes(documents, benchmark, index_bytes):
        left = left.mapInArrow(lambda it, s=shared: _clean(s.value, it), documents.schema)
    return left
