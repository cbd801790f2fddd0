"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash runs over the words of a text, each entering by a hash of its bytes; with 64
bits and ``SHIFT`` a word it depends on the last ``WINDOW`` words only (higher bits are cut off),
so equal passages hash equally wherever they stand. A chunk ends where the hash is the
least within ``REACH`` words on either side: boundaries follow content, insertions
disturb the chunks they touch and no others. In a stretch that repeats itself within
``REACH`` words (one word over and over) the least hash comes back once a
period and ends a chunk each time: such chunks are one period long and the same wherever
the stretch begins. All other chunks are longer than ``REACH`` words, apart from the last.

Reach and window are counted in words because passages are: of ``WORDS`` words, whatever
their length, ``WORDS - WINDOW + 1 - 2 * REACH`` boundaries depend on the passage alone. A whole
chunk, which is all it takes to find a passage, lies between two of them that end a chunk; of 200,000
passages of distinct words 15 had none (simulated).

Chunks are deduplicated by digest: one that several documents hold belongs to the
smallest ``doc_id``. Chunks in a row that stand in a row in one other document too, at their first places
there, are a passage if they have ``WORDS`` words together. All other shared chunks may be the inside of a
passage, since chunks at its ends reach out of it: so the words around them and around the ends of long
runs, in all documents that hold those chunks, are compared as sequences of ``WORDS`` words, and what several
documents hold is a passage. Sequences with a whole chunk inside that no other document holds are passed over.
Shorter repeats are left alone.

Digests with positions are shuffled, not texts; only documents with a chunk that is not
yet settled are read again. Digest joins are on uniform keys, dealt over ``SALTS``.

Edge cases: null and empty texts have no chunks; texts of fewer than ``WORDS`` words have no
passages; a passage repeated only inside one document is not reported; rows with
one ``doc_id`` are the same document, but spans are those of each row's own text; rows with
a null one are left out and never cut; repeated rows give one set of spans; of
several first holders the smallest is named; very long texts are cut into chunks whole;
empty in, empty out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import raw_texts, text_key, text_slices
from ledgerline.plans.materialise import discard, materialise

#: Bits a word moves the gear hash, words it sees, words to either side of a boundary.
SHIFT, WINDOW, REACH = 22, 3, 4
#: Words of a passage at least.
WORDS = 51
SEED = 97
#: Join keys that a digest held by very many documents is spread over.
SALTS = 4


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    letters = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
    return letters, rng.integers(0, 1 << 64, 4096, dtype=np.uint64) | np.uint64(1)


def gear_hash(words: np.ndarray) -> np.ndarray:
    """sum of word i-k << SHIFT * k over the last ``WINDOW`` words, mixed."""
    h = words.copy()
    for k in range(1, WINDOW):
        h[k:] += words[:-k] << np.uint64(SHIFT * k)
    return _mixed(h)


def boundaries(words: np.ndarray) -> np.ndarray:
    """Numbers of words after which a chunk ends: the hash is least within ``REACH`` on both sides.

    Equal hashes all end chunks. The end is a boundary always.
    """
    n = len(words)
    if n <= 2 * REACH:
        return np.array([n] if n else [], dtype=np.int64)
    h = gear_hash(words)
    around = np.lib.stride_tricks.sliding_window_view(h, 2 * REACH + 1).min(axis=1)
    # Near the start fewer than REACH words lie before; those never end a chunk, nor do the last ones.
    return np.append(np.flatnonzero(h[REACH : n - REACH] == around) + REACH + 1, n)


def _mixed(total: np.ndarray) -> np.ndarray:
    total ^= total >> np.uint64(31)
    total *= np.uint64(0x94D049BB133111EB)
    return total ^ total >> np.uint64(29)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Multilinear hash of the stretches that begin at ``starts`` and reach to the next one."""
    places = _tables()[1]
    within = np.arange(starts[0], len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    fold = (within // len(places)).astype(np.uint64)  # very long stretches go around with another odd factor
    terms = values[starts[0] :] * places[within % len(places)] * (np.uint64(2) * fold + np.uint64(1))
    return np.add.reduceat(terms, starts - starts[0])


def digests(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each chunk, with its number of words."""
    starts = np.concatenate([[0], ends[:-1]])
    return _mixed(_sums(words, starts) + (ends - starts).astype(np.uint64) * _tables()[1][-1]).view(np.int64)


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | (data >= 0x09) & (data <= 0x0D)


def spelled(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, and 64-bit hash of every word."""
    letters, places = _tables()
    gap = _blank(data)
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    ends = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
    if not len(starts):
        return starts, ends, np.empty(0, dtype=np.uint64)
    values = letters[data]
    values[gap] = 0
    return starts, ends, _mixed(_sums(values, starts) + (ends - starts).astype(np.uint64) * places[-1])


def sequences(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, and 64-bit hash of every ``length`` words in a row."""
    starts, ends, words = spelled(data)
    found = _in_a_row(words, length)
    return starts[: len(found)], ends[length - 1 :], found


def _in_a_row(words: np.ndarray, length: int) -> np.ndarray:
    if len(words) < length:
        return np.empty(0, dtype=np.int64)
    factor = 0x9E3779B97F4A7C15  # odd, so its powers have inverses
    back = np.cumprod(np.full(len(words), pow(factor, -1, 1 << 64), dtype=np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * back)])
    ahead = np.cumprod(np.full(len(words) - length + 1, factor, dtype=np.uint64))
    return _mixed((total[length:] - total[:-length]) * ahead).view(np.int64)


def _chunked(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "th", "begin", "size", "place", "words", "again", "final", "h"]
    for batch in batches:
        for part in text_slices(batch, limit=4 << 20):
            columns: list[list] = [[] for _ in names[2:]]
            rows = []
            for row, raw in enumerate(raw_texts(part)):
                if len(raw) < 2 * least - 1:
                    continue
                begin, end, words = spelled(np.frombuffer(raw, dtype=np.uint8))
                if len(words) < least:
                    continue
                ends = boundaries(words)
                starts = np.concatenate([[0], ends[:-1]])
                at, h = begin[starts], digests(words, ends)
                again = np.ones(len(h), dtype=bool)
                again[np.unique(h, return_index=True)[1]] = False
                rows.append(np.full(len(ends), row))
                for c, x in zip(columns, (at, np.diff(at, append=end[-1]), starts, ends - starts, again, ends == len(words), h), strict=True):
                    c.append(x)
            if rows:
                at = pa.array(np.concatenate(rows))
                ints = [pa.array(np.concatenate(c).astype(np.int32)) for c in columns[:4]]
                rest = [pa.array(np.concatenate(c)) for c in columns[4:]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("th").take(at), *ints, *rest], names)


def _keyed(documents: DataFrame) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), "text")
    return rows.filter("doc_id is not null")


def chunks(documents: DataFrame, least: int = WORDS) -> DataFrame:
    """Every chunk of the texts of ``least`` words or more: ``doc_id, th, begin, size, place, words, again, final, h``.

    Byte span, number of the first word, words, whether the text had the chunk before and ends with it, digest.
    """
    schema = "doc_id long, th long, begin int, size int, place int, words int, again boolean, final boolean, h long"
    return _keyed(documents).mapInArrow(lambda it: _chunked(it, least), schema)


def _held_by_several(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` several documents hold, with the smallest and the largest of them as ``first`` and ``last``."""
    shared = rows.groupBy(key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    return _met(rows, shared, key)


def _met(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    many = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int")).join(many, [key, "salt"]).drop("salt")


def _by_document(rows: DataFrame, *columns: str) -> DataFrame:
    """A document's own spans as a sorted list ``spans``: as many as it has chunks or words, no more."""
    return rows.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct(*columns))).alias("spans"))


def _shared_chunks(every: DataFrame) -> DataFrame:
    """The chunks that several documents hold, with the smallest and largest of them and the chunk's first place there."""
    shared = every.filter("not again").groupBy("h").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
        F.min_by("place", "doc_id").alias("first_place"), F.max_by("place", "doc_id").alias("last_place"),
    )
    return _met(every.drop("again"), shared.filter("first < last"), "h")


def repeated_passages(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per repeated passage of a document.

    ``doc_id, begin_byte, end_byte, first_doc_id, dropped, text_key``: the passage's bytes, the
    smallest document that holds a part of it, whether dedup takes it out, which it does
    in all but the first, and the key of the row's text.
    """
    every = materialise(chunks(documents, words), "gear-chunks")
    hits = materialise(_shared_chunks(every), "gear-hits")
    discard(every)
    columns = ("begin", "size", "place", "words", "first", "last", "first_place", "last_place", "final", "h")
    runs = materialise(_by_document(hits, *columns).mapInArrow(lambda it: _runs(it, words), _RUNS), "gear-runs")
    unsure = runs.select(F.explode("unsure").alias("h")).distinct()
    around = _by_document(_met(hits, unsure, "h"), "place")
    around = materialise(around.join(runs.select("doc_id", "th", "hits"), ["doc_id", "th"]), "gear-around")
    discard(hits)
    near = _keyed(documents).join(around, ["doc_id", "th"]).mapInArrow(
        lambda it: _sequences(it, words), "doc_id long, th long, begin int, end int, s long"
    )
    near = materialise(near, "gear-sequences")
    discard(around)
    spans = _held_by_several(near, "s").select("doc_id", "th", "begin", "end", "first").union(
        runs.select("doc_id", "th", F.inline("sure")).select("doc_id", "th", "begin", "end", "first")
    )
    return _by_document(spans, "begin", "end", "first").mapInArrow(_passages, PASSAGES)


_RUNS = "doc_id long, th long, sure array<struct<begin: int, end: int, first: bigint>>, unsure array<bigint>, hits array<int>"
PASSAGES = "doc_id long, begin_byte int, end_byte int, first_doc_id long, dropped boolean, text_key long"


def _flat(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    """Number of the row, and the fields, of the structs in the lists ``spans``."""
    lists = batch.column("spans")
    flat = lists.flatten()
    counts = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), counts), *(flat.field(k).to_numpy(zero_copy_only=False) for k in names)


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Per document the runs that are passages for sure, and the digests of their ends within the text and of all other shared chunks; all places."""
    for batch in batches:
        row, begin, size, place, words, first, last, first_place, last_place, final, h = _flat(
            batch, "begin", "size", "place", "words", "first", "last", "first_place", "last_place", "final", "h"
        )
        if not len(row):
            continue
        own = first == batch.column("doc_id").to_numpy(zero_copy_only=False)[row]
        partner, there = np.where(own, last, first), np.where(own, last_place, first_place)
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (own[1:] != own[:-1]) | (partner[1:] != partner[:-1])
        new[1:] |= (place[1:] != place[:-1] + words[:-1]) | (there[1:] != there[:-1] + words[:-1])
        at, part = np.flatnonzero(new), np.cumsum(new) - 1
        sure = np.add.reduceat(words, at) >= least
        unsettled = ~sure[part]
        stops = np.append(at[1:], len(row))[sure] - 1
        at = at[sure]
        unsettled[at[place[at] > 0]] = True
        unsettled[stops[~final[stops].astype(bool)]] = True
        spans = pa.StructArray.from_arrays(
            [pa.array(begin[at]), pa.array((begin + size)[stops]), pa.array(first[at])], ["begin", "end", "first"]
        )
        rest = np.flatnonzero(unsettled)
        edges = np.arange(batch.num_rows + 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"),
             pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], edges).astype(np.int32)), spans),
             pa.ListArray.from_arrays(pa.array(np.searchsorted(row[rest], edges).astype(np.int32)), pa.array(h[rest])),
             pa.ListArray.from_arrays(pa.array(np.searchsorted(row, edges).astype(np.int32)), pa.array(place))],
            ["doc_id", "th", "sure", "unsure", "hits"],
        )


def _ranges(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of 0 to n-1 lie in one of the ranges, both ends included."""
    low, high = np.maximum(low, 0), np.minimum(high, n - 1)
    some = low <= high
    steps = np.bincount(low[some], minlength=n + 1) - np.bincount(high[some] + 1, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def possible(words: np.ndarray, length: int, hits: np.ndarray, unsettled: np.ndarray) -> np.ndarray:
    """Numbers of the first words of those sequences around unsettled chunks that another document can hold.

    Chunks are given by the number of their first word. A sequence holds an unsettled chunk whole. A chunk
    whose both boundaries depend on the sequence alone is in every document that holds the sequence: where
    it is no hit, there is no such document.
    """
    n = len(words) - length + 1
    if n < 1:
        return np.empty(0, dtype=np.int64)
    ends = boundaries(words)
    starts = np.concatenate([[0], ends[:-1]])
    held = _ranges((ends - length)[np.isin(starts, unsettled)], starts[np.isin(starts, unsettled)], n)
    alone = ~np.isin(starts, hits)
    return np.flatnonzero(held & ~_ranges((ends + REACH - length)[alone], (starts - REACH - WINDOW)[alone], n))


def _sequences(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The sequences of words around a document's unsettled chunks."""
    names = ["doc_id", "th", "begin", "end", "s"]
    for batch in batches:
        for part in text_slices(batch, limit=4 << 20):
            rows, columns = [], [[], [], []]
            lists = zip(raw_texts(part), part.column("hits"), part.column("spans"), strict=True)
            for row, (raw, hits, spans) in enumerate(lists):
                begin, end, words = spelled(np.frombuffer(raw, dtype=np.uint8))
                at = possible(words, length, hits.values.to_numpy(), spans.values.field("place").to_numpy(zero_copy_only=False))
                rows.append(np.full(len(at), row))
                for c, x in zip(columns, (begin[at], end[at + length - 1], _in_a_row(words, length)[at]), strict=True):
                    c.append(x)
            if rows:
                at = pa.array(np.concatenate(rows))
                begin, end, s = (np.concatenate(c) for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("th").take(at), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(s)], names
                )


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping spans of a document as one passage; what the document itself held first stays apart."""
    for batch in batches:
        row, begin, end, first = _flat(batch, "begin", "end", "first")
        own = first == batch.column("doc_id").to_numpy(zero_copy_only=False)[row]
        out: list[tuple] = []
        for mine in (False, True):
            pick = np.flatnonzero(own == mine)
            if not len(pick):
                continue
            r, b, e = row[pick], begin[pick].astype(np.int64), end[pick].astype(np.int64)
            size = int(e.max()) + 2
            reach = np.maximum.accumulate(r * size + e)  # the end of all spans so far, beyond those of earlier rows
            new = np.concatenate([[True], r[1:] * size + b[1:] > reach[:-1]])
            at = np.flatnonzero(new)
            out.append((r[at], b[at], np.maximum.reduceat(e, at), np.minimum.reduceat(first[pick], at), np.full(len(at), not mine)))
        if out:
            r, b, e, f, dropped = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(r)), pa.array(b.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(f), pa.array(dropped),
                 batch.column("th").take(pa.array(r))],
                ["doc_id", "begin_byte", "end_byte", "first_doc_id", "dropped", "text_key"],
            )


def _within_characters(raw: bytes, begin: int, end: int) -> tuple[int, int]:
    """The span without the parts of characters at its ends."""
    while begin < end and raw[begin] & 0xC0 == 0x80:
        begin += 1
    while end > begin and end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return begin, end


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, raw, spans in zip(batch.column("text"), raw_texts(batch), batch.column("spans").to_pylist(), strict=True):
            parts, at = [], 0
            for span in spans or []:
                begin, end = _within_characters(raw, span["begin_byte"], span["end_byte"])
                parts.append(raw[at : max(at, begin)])
                at = max(at, end)
            texts.append(b"".join([*parts, raw[at:]]).decode() if spans else text.as_py())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def drop_passages(documents: DataFrame) -> DataFrame:
    """``doc_id, text``: each row's text without passages that a smaller document holds."""
    spans = (
        repeated_passages(documents).filter("dropped").groupBy("doc_id", F.col("text_key").alias("th"))
        .agg(F.sort_array(F.collect_list(F.struct("begin_byte", "end_byte"))).alias("spans"))
    )
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), "text")
    return rows.join(spans, ["doc_id", "th"], "left").mapInArrow(_cut, "doc_id long, text string")
