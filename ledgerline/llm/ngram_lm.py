"""Language-model scoring with an Elias-Fano n-gram trie.

The trie has a level per n-gram length, each cut into shards, each shard one file in
the shared folder that workers map into memory:

* level 1: 64-bit word hashes in order (a word's id is its position) and exact counts;
* level n: for the n-grams that extend each entry of level n-1, monotone pointers to
  their range and their last words. A range's words are stored above the last value
  of the range before it, which makes the level one monotone sequence; a lookup is a
  successor search for base + word within the context's range. Beside them stand
  log10 probabilities quantised to 8 bits, and per context a quantised back-off weight.

Level 1 holds every training word and higher levels every n-gram of the training
rows, those seen once included, at every size. Probabilities are absolutely
discounted and interpolated; what a discount takes is the back-off weight, so each
context's probabilities sum to one up to quantisation.

Texts are read twice for counting: once for words, once for n-grams of the full
length, which hold the shorter ones as their beginnings (texts are padded at the end).
Each slice counts its own n-grams, sorts them and ships them as compressed runs, one per
part. Parts are ranges of n-grams of about equal mass: the place of an n-gram is
worked out from the counts of its words, as if words were independent, by a rule that
keeps their order, so no sample and no table of cuts is needed, and n-grams of a
frequent word are spread over many parts. A task merges the runs of one part, adding
up equal n-grams whenever its buffer is full, so a common n-gram costs a row a slice.
An entry or context that lies across parts is completed from the two edges of each
part, the only thing that passes through the driver. Tasks write files under temporary
names and rename them; repeated attempts write the same bytes.

Edge cases: null and blank texts hold the end token only; a null ``doc_id`` is not held
out; rows that share an id are scored each for itself; repeated rows count each time; a
very long text is one slice of its own; without training rows every token has c = 0;
words are told apart by 64-bit hash; empty in, empty out; other columns are ignored.
"""

from __future__ import annotations

import mmap
import os
import re
from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import materialise, raw_texts, text_slices
from ledgerline.llm.eliasfano import EliasFano, encode
from ledgerline.plans.materialise import discard
from ledgerline.session import remove_path, scratch_path

#: Longest n-gram, discount, entries aimed at in a shard, most tasks of a stage.
ORDER, DISCOUNT, SHARD, TASKS = 3, 0.75, 1_000_000, 20_000
#: Bytes of text that are counted or scored as one slice.
SLICE = 4 << 20
#: Shards a worker keeps mapped, and bytes of shards it holds from a store that cannot be mapped.
OPEN, HELD = 2048, 256 << 20
_SIGN = np.uint64(1 << 63)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 5, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


# Files in the shared folder


def _located(uri: str):
    uri = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", uri))
    return pa.fs.FileSystem.from_uri(uri)


def _store(uri: str, data: bytes) -> None:
    fs, path = _located(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    partial = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with fs.open_output_stream(partial) as out:
        out.write(data)
    fs.move(partial, path)


def _fetched(uri: str) -> tuple[mmap.mmap | bytes, int]:
    """A file, mapped, and the memory it takes; where the store cannot be mapped its bytes are read."""
    fs, path = _located(uri)
    if isinstance(fs, pa.fs.LocalFileSystem):
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), 0
    with fs.open_input_stream(path) as source:
        data = source.read()
    return data, len(data)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of sorted rows of numbers from 0 on: the first as steps, each as narrow as it may be, compressed."""
    out = [np.array([len(columns), len(columns[0])], dtype=np.int64).tobytes()]
    for k, column in enumerate(columns):
        column = np.diff(column, prepend=0) if k == 0 else column
        kind = np.min_scalar_type(int(column.max())) if len(column) else np.dtype(np.uint8)
        # Bytes of equal weight lie together, which compresses better.
        out += [np.array([kind.itemsize], dtype=np.int64).tobytes(), column.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpacked(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    (count, n), at, out = np.frombuffer(data, np.int64, 2).tolist(), 16, []
    for k in range(count):
        size = int(np.frombuffer(data, np.int64, 1, at)[0])
        column = np.frombuffer(data, np.uint8, n * size, at + 8).reshape(size, n).T.copy().view(f"u{size}").ravel().astype(np.int64)
        out.append(np.cumsum(column) if k == 0 else column)
        at += 8 + n * size
    return out


# The trie


class Level(NamedTuple):
    """A level's shards in order: file number, first key, entries and tokens before each, and the level's size."""

    number: np.ndarray
    first: np.ndarray
    child: np.ndarray
    offset: np.ndarray
    before: np.ndarray
    size: int


def _level(rows: list[tuple[int, int, int, int, int]]) -> Level:
    """From ``number, first, child, entries, tokens`` of each shard."""
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    entries, tokens = (np.concatenate([[0], np.cumsum(table[:, k])]) for k in (3, 4))
    return Level(table[:, 0], table[:, 1], table[:, 2], entries[:-1], tokens[:-1], int(entries[-1]))


class Trie:
    """Shards by level and corpus totals; pickles small, maps files when they are used."""

    def __init__(self, name: str):
        self.name, self.levels, self.total, self.vocabulary = name, [], 0, 0
        self._open: OrderedDict = OrderedDict()
        self._held = 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_open", "_held")}

    def __setstate__(self, state):
        self.__dict__.update(state, _open=OrderedDict(), _held=0)

    def file(self, level: int, number: int) -> str:
        return f"{self.name}/level{level}/{number:08d}.bin"

    def _shard(self, level: int, i: int):
        key = (level, i)
        if key in self._open:
            self._open.move_to_end(key)
        else:
            kind = VocabularyShard if level == 1 else LevelShard
            data, held = _fetched(self.file(level, int(self.levels[level - 1].number[i])))
            self._open[key] = kind(data), held
            self._held += held
            while len(self._open) > 1 and (len(self._open) > OPEN or self._held > HELD):
                self._held -= self._open.popitem(last=False)[1][1]
        return self._open[key][0]

    def shards(self, level: int) -> Iterator[VocabularyShard | LevelShard]:
        return (self._shard(level, i) for i in range(len(self.levels[level - 1].number)))

    @staticmethod
    def _runs(of: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Slices of an ascending array that hold one value, none of them negative."""
        edges = [*np.flatnonzero(np.diff(of, prepend=-1 if not len(of) else of[0] - 1)).tolist(), len(of)]
        for a, b in pairwise(edges):
            if of[a] >= 0:
                yield int(of[a]), slice(a, b)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (-1: unknown), exact counts and tokens of smaller ids, of signed hashes in any order."""
        ids, counts, before = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        level, order = self.levels[0], np.argsort(hashes)
        ranked = hashes[order]
        for i, part in self._runs(np.searchsorted(level.first, ranked, side="right") - 1):
            shard = self._shard(1, i)
            at = shard.hashes.find(ranked[part].view(np.uint64) ^ _SIGN)
            hit = at >= 0
            to, at = order[part][hit], at[hit]
            ids[to] = at + level.offset[i]
            before[to] = shard.upto[at] + level.before[i]
            counts[to] = shard.upto[at + 1] - shard.upto[at]
        return ids, counts, before

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by id, in any order."""
        out, level, order = np.zeros(len(ids), dtype=np.int64), self.levels[0], np.argsort(ids)
        ranked = ids[order]
        for i, part in self._runs(np.searchsorted(level.offset, ranked, side="right") - 1):
            at = ranked[part] - level.offset[i]
            upto = self._shard(1, i).upto
            out[order[part]] = upto[at + 1] - upto[at]
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.vocabulary + 1)))

    def _shard_of(self, level: int, parents: np.ndarray, children: np.ndarray) -> np.ndarray:
        """Number of the shard of each n-gram, ascending; -1 before the first."""
        first, child = self.levels[level - 1].first, self.levels[level - 1].child
        of = np.searchsorted(first, parents, side="right") - 1
        tied = (of >= 0) & (first[of] == parents)  # a context may begin in one shard and go on in others
        for i, part in self._runs(np.where(tied, of, -1)[tied]):
            rows = np.flatnonzero(tied)[part]
            low = np.searchsorted(first, first[i])
            of[rows] = low + np.searchsorted(child[low : i + 1], children[rows], side="right") - 1
        return of

    def extend(self, level: int, parents: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position (-1: absent) and log10 probability of each n-gram, and its context's log10 back-off.

        ``parents`` are positions in the level below, -1 for a context that is absent.
        """
        n = len(parents)
        ids, logs, weights = np.full(n, -1, dtype=np.int64), np.zeros(n), np.zeros(n)
        live = np.flatnonzero(parents >= 0)
        if len(self.levels) < level or not self.levels[level - 1].size or not len(live):
            return ids, logs, weights
        # Unknown words are looked up as an id beyond all others, for the back-off weight.
        p, c = parents[live], np.where(children[live] < 0, self.vocabulary, children[live])
        at, back = _grouped([p, c], [self.levels[level - 2].size, self.vocabulary + 1])
        p, c = p[at], c[at]
        found, log, weight = np.full(len(at), -1, dtype=np.int64), np.zeros(len(at)), np.zeros(len(at))
        for i, part in self._runs(self._shard_of(level, p, c)):
            place, log[part], weight[part] = self._shard(level, i).find(p[part], c[part])
            found[part] = np.where(place >= 0, place + self.levels[level - 1].offset[i], -1)
        ids[live], logs[live], weights[live] = found[back], log[back], weight[back]
        return ids, logs, weights

    def scores(self, ids: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each token of running text; ``first`` marks the first token of a text."""
        logs = self.base(counts)
        context = ids  # position, in the level below, of the n-1 tokens that end here
        for level in range(2, len(self.levels) + 1):
            parents = np.concatenate([[-1], context[:-1]])
            parents[first] = -1
            context, found, weight = self.extend(level, parents, ids)
            logs = np.where(context >= 0, found, logs + weight)
        return logs


def _keys(columns: list[np.ndarray], bounds: list[int]) -> np.ndarray:
    """One number per row that orders rows as their columns do; ranks stand in where the numbers get too large."""
    key, size = columns[0], bounds[0]
    for column, bound in zip(columns[1:], bounds[1:], strict=True):
        if size * bound >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1]
            size = len(key)
        if size * bound >= 1 << 63:
            column = np.unique(column, return_inverse=True)[1]
            bound = len(column)
        key, size = key * bound + column, size * bound
    return key


def _grouped(columns: list[np.ndarray], bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct combination, in order, and the place of each row's combination among them."""
    key = _keys(columns, bounds)
    order = np.argsort(key)
    ranked = key[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    back = np.empty(len(key), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


class VocabularyShard:
    def __init__(self, buffer):
        self.hashes = EliasFano(buffer)
        self.upto = np.frombuffer(buffer, np.int64, self.hashes.n + 1, self.hashes.end)

    def __len__(self) -> int:
        return self.hashes.n

    @staticmethod
    def build(keys: np.ndarray, counts: np.ndarray) -> bytes:
        return encode(keys.view(np.uint64) ^ _SIGN, (1 << 64) - 1) + np.cumsum(counts, dtype=np.int64).tobytes().rjust(8 * len(keys) + 8, b"\0")


class LevelShard:
    """Pointers, relative last words, probability and back-off codes of one shard."""

    def __init__(self, buffer):
        self.start, n, contexts = (int(x) for x in np.frombuffer(buffer, np.int64, 3))
        self.levels = np.frombuffer(buffer, np.float64, 256, 24)
        self.backs = np.frombuffer(buffer, np.float64, 256, 24 + 2048)
        self.pointers = EliasFano(buffer, 24 + 4096)
        self.words = EliasFano(buffer, self.pointers.end)
        at = self.words.end
        self.codes = np.frombuffer(buffer, np.uint8, n, at)
        self.back_codes = np.frombuffer(buffer, np.uint8, contexts, at + n)

    def __len__(self) -> int:
        return len(self.codes)

    @staticmethod
    def build(parents: np.ndarray, words_: np.ndarray, logs: np.ndarray, backs: np.ndarray) -> bytes:
        """From entries in order; ``backs`` has log10 weights of the distinct parents."""
        start, n = int(parents[0]), len(parents)
        contexts = int(parents[-1]) - start + 1
        pointers = np.searchsorted(parents - start, np.arange(contexts + 1))
        ends = np.flatnonzero(np.concatenate([parents[1:] != parents[:-1], [True]]))
        bases = np.concatenate([[0], np.cumsum(words_[ends])[:-1]])
        relative = words_ + np.repeat(bases, np.diff(np.concatenate([[-1], ends])))
        codes, levels = _quantised(logs)
        own, steps = _quantised(backs)
        spread = np.zeros(contexts, dtype=np.uint8)
        spread[parents[ends] - start] = own
        return b"".join([
            np.array([start, n, contexts], dtype=np.int64).tobytes(), levels.tobytes(), steps.tobytes(),
            encode(pointers.astype(np.uint64), n), encode(relative.astype(np.uint64), int(relative[-1])),
            codes.tobytes(), spread.tobytes(),
        ])

    def find(self, parents: np.ndarray, words_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, log10 probabilities and log10 back-off weights for ascending contexts."""
        new = np.concatenate([[True], parents[1:] != parents[:-1]])
        contexts, back = parents[new] - self.start, np.cumsum(new) - 1
        inside = (contexts >= 0) & (contexts < len(self.back_codes))
        c = contexts[inside]
        lo, hi = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        lo[inside] = self.pointers.access(c).astype(np.int64)
        hi[inside] = self.pointers.access(c + 1).astype(np.int64)
        used = hi > lo
        bases, weights = np.zeros(len(contexts), np.uint64), np.zeros(len(contexts))
        later = used & (lo > 0)
        bases[later] = self.words.access(lo[later] - 1)
        weights[used] = self.backs[self.back_codes[contexts[used]]]
        at = self.words.find(words_.astype(np.uint64) + bases[back], lo[back], hi[back])
        logs = np.where(at >= 0, self.levels[self.codes[np.maximum(at, 0)]], 0.0)
        return at, logs, weights[back]


def _quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes in equal steps between the least and the greatest value, and the steps' values."""
    low, high = float(values.min()), float(values.max())
    steps = np.linspace(low, high, 256)
    width = (high - low) / 255 or 1.0
    return np.rint((values - low) / width).astype(np.uint8), steps


# Counting and building


#: Bytes hashed at once, and the longest stretch of a word that has multipliers of its own.
BLOCK, PLACES = 1 << 20, 256


@lru_cache(maxsize=1)
def _hash_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """White space, a random number per letter whatever its case (0 for white space), odd ones per place."""
    rng = np.random.default_rng(1_000_003)
    blank = np.zeros(256, dtype=bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    letters = rng.integers(1, 1 << 64, 256, dtype=np.uint64)
    letters[ord("A") : ord("Z") + 1] = letters[ord("a") : ord("z") + 1]
    letters[blank] = 0
    return blank, letters, rng.integers(0, 1 << 64, PLACES, dtype=np.uint64) | np.uint64(1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and multilinear 64-bit hash of each word; upper and lower case A-Z are the same letter."""
    blank, letters, places = _hash_tables()
    gap = blank[data]
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    sizes = np.diff(np.append(starts, len(data)))
    within = np.arange(starts[0], len(data), dtype=np.int32) - np.repeat(starts, sizes).astype(np.int32)
    terms = letters[data[starts[0] :]] * places[within & (PLACES - 1)]
    if sizes.max() > PLACES:  # a very long word: each round of the places has a factor of its own
        terms *= (within >> 8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16) + np.uint64(1)
    found = np.add.reduceat(terms, starts - starts[0])
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    return starts, found ^ found >> np.uint64(32)


#: Hash of the end token, which no sum of letters is made for.
END_HASH = np.uint64(0)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order of appearance and the place of each value among them, by hash table."""
    coded = pa.array(values).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


class Tokens:
    """Texts of a slice as positions of distinct words, each text closed by an end token."""

    def __init__(self, texts: list[bytes]):
        hashes, counts, held, n = [], [], [], 0
        for i, raw in enumerate(texts):
            held.append(raw)
            n += len(raw) + 1
            if n >= BLOCK or i + 1 == len(texts):
                starts, found = word_hashes(np.frombuffer(b"".join(t + b" " for t in held), dtype=np.uint8))
                ends = np.cumsum([len(t) + 1 for t in held])
                upto = np.searchsorted(starts, ends)  # words that start before the end of each text
                hashes.append(np.insert(found, upto, END_HASH))
                counts.append(np.diff(upto, prepend=0) + 1)
                held, n = [], 0
        every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        distinct, self.at = _distinct(every.view(np.int64))
        self.hashes = distinct
        self.counts = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, limit=SLICE):
            tokens = Tokens(raw_texts(part))
            n = np.bincount(tokens.at, minlength=len(tokens.hashes))
            yield pa.RecordBatch.from_arrays([pa.array(tokens.hashes), pa.array(n)], ["key", "n"])


def _ngrams(trie: Trie, order: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice's n-grams and their counts as sorted runs, one per part: columns of word ids from 1, 0 is padding."""
    for batch in batches:
        for slice_ in text_slices(batch, limit=SLICE):
            tokens = Tokens(raw_texts(slice_))
            ids, counts, before = trie.words(tokens.hashes)
            ranked = np.argsort(ids)
            rank = np.empty(len(ids), dtype=np.int64)
            rank[ranked] = np.arange(1, len(ids) + 1)
            local = rank[tokens.at]
            last = np.repeat(tokens.starts + tokens.counts - 1, tokens.counts)
            at = np.flatnonzero(np.arange(len(local)) < last)  # an end token begins nothing
            last, columns = last[at], [local[at]]
            for k in range(1, order):
                columns.append(np.where(at + k <= last, local[np.minimum(at + k, last)], 0))
            if not len(at):
                continue
            place, back = _grouped(columns, [len(ids) + 1] * order)
            n = np.bincount(back)
            columns = [c[place] for c in columns]
            low, mass = np.concatenate([[0.0], before[ranked]]), np.concatenate([[0.0], counts[ranked]])
            x = low[columns[-1]]
            for c in columns[-2::-1]:
                x = np.minimum(low[c] + mass[c] * (x / trie.total), low[c] + mass[c])
            part = np.minimum((x * (parts / trie.total)).astype(np.int64), parts - 1)
            known = np.concatenate([[0], ids[ranked] + 1])
            columns = [known[c] for c in columns]
            numbers, blobs = [], []
            for number, own in Trie._runs(part):
                numbers.append(number)
                blobs.append(_packed([*(c[own] for c in columns), n[own]]))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], ["part", "run"])


def _added(rows: list[np.ndarray], bound: int) -> list[np.ndarray]:
    """Sorted distinct n-grams with their counts added up."""
    at, back = _grouped(rows[:-1], [bound] * (len(rows) - 1))
    total = np.bincount(back, weights=rows[-1]).astype(np.int64)
    return [*(c[at] for c in rows[:-1]), total]


def _starts(columns: list[np.ndarray]) -> list[np.ndarray]:
    """For each n-gram length, where among sorted rows a new one begins."""
    change, out = np.zeros(len(columns[0]), dtype=bool), []
    change[0] = True
    for column in columns:
        change = change.copy()
        change[1:] |= column[1:] != column[:-1]
        out.append(np.flatnonzero(change & (column > 0)))
    return out


def _totals(columns: list[np.ndarray], n: np.ndarray, starts: list[np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Count of each n-gram of length m, and number of different words that follow it here."""
    if not len(starts[m - 1]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    held = np.add.reduceat(np.where(columns[m - 1] > 0, n, 0), starts[m - 1])
    if m == len(columns):
        return held, np.zeros(len(held), dtype=np.int64)
    child = np.zeros(len(n), dtype=np.int64)
    child[starts[m]] = 1
    return held, np.add.reduceat(child, starts[m - 1])


def _merged(trie: Trie, order: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of each part, store them as one, and report the part's edges.

    Per length: number of n-grams; count, followers and words of the first and of the last.
    """
    part, held, size = None, [], 0

    def added() -> list[np.ndarray]:
        return _added([np.concatenate(c) for c in zip(*held, strict=True)], trie.vocabulary + 2)

    def finished() -> pa.RecordBatch:
        *columns, n = added()
        _store(f"{trie.name}/run/{part:08d}.bin", _packed([*columns, n]))
        starts, edges = _starts(columns), []
        for m in range(1, order + 1):
            counts, followers = _totals(columns, n, starts, m)
            edges.append(len(counts))
            for at in (0, -1):
                words_ = [int(c[starts[m - 1][at]]) for c in columns[:m]] if len(counts) else [0] * m
                edges += [int(counts[at]), int(followers[at]), *words_] if len(counts) else [0, 0, *words_]
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([edges], pa.list_(pa.int64()))], ["part", "edges"])

    for batch in batches:
        for number, run in zip(batch.column("part").to_pylist(), batch.column("run"), strict=True):
            if part is not None and number != part:
                yield finished()
                held, size = [], 0
            part = number
            held.append(_unpacked(run.as_py()))
            size += len(held[-1][0])
            if size > 2 * SHARD and len(held) > 1:
                held = [added()]
                size = min(len(held[0][0]), SHARD)  # the next SHARD rows at least before adding up again
    if part is not None:
        yield finished()


class Edge(NamedTuple):
    """A part's n-grams of one length: position of its first, whether that began in an earlier part, totals of first and last."""

    base: int
    goes_on: int
    first: tuple[int, int]
    last: tuple[int, int]


def _resolved(rows: list, order: int) -> list[list[Edge]]:
    """Per length, per part in order: positions, and totals over all parts of what lies across them."""
    parsed = []
    for row in rows:
        edges, at, own = row["edges"], 0, []
        for m in range(1, order + 1):
            size, step = edges[at], 2 + m
            ends = [edges[at + 1 + k * step : at + 1 + (k + 1) * step] for k in (0, 1)]
            own.append((size, *((tuple(e[2:]), e[0], e[1]) for e in ends)))
            at += 1 + 2 * step
        parsed.append(own)
    totals = [defaultdict(lambda: [0, 0]) for _ in range(order)]
    places: list[list[tuple[int, int]]] = [[] for _ in range(order)]
    for m in range(order):
        position, open_ = 0, None
        for own in parsed:
            size, first, last = own[m]
            goes_on = int(size > 0 and first[0] == open_)
            places[m].append((position - goes_on, goes_on))
            position += size - goes_on
            for words_, count, followers in ((first, last) if size > 1 else (first,) * min(size, 1)):
                totals[m][words_][0] += count
                totals[m][words_][1] += followers
            if goes_on and m:  # counted as a follower in each part
                totals[m - 1][first[0][:-1]][1] -= 1
            open_ = last[0] if size else open_
    return [
        [Edge(*places[m][k], tuple(totals[m][own[m][1][0]]), tuple(totals[m][own[m][2][0]])) for k, own in enumerate(parsed)]
        for m in range(order)
    ]


def _built(trie: Trie, level: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write a level's shard of each part; ``number, first, child, entries, tokens``."""
    for batch in batches:
        for row in batch.to_pylist():
            fetched, _ = _fetched(f"{trie.name}/run/{row['part']:08d}.bin")
            *columns, n = _unpacked(bytes(fetched))
            context, own = (Edge(x[0], x[1], tuple(x[2:4]), tuple(x[4:6])) for x in (row["context"], row["own"]))
            starts = _starts(columns)
            at = starts[level - 1]
            if len(at) <= own.goes_on:
                continue
            counts, _ = _totals(columns, n, starts, level)
            whole, followers = _totals(columns, n, starts, level - 1)
            counts[-1], whole[-1], followers[-1] = own.last[0], *context.last
            counts[0], whole[0], followers[0] = own.first[0], *context.first
            group = np.searchsorted(starts[level - 2], at, side="right") - 1
            parents = columns[0][at] - 1 if level == 2 else context.base + group
            words_ = columns[level - 1][at] - 1
            if level == 2:
                lower = trie.base(trie.counts(words_))
            else:
                place = columns[1][at] - 1
                for lower_level, column in enumerate(columns[2:level], 2):
                    place, lower, _ = trie.extend(lower_level, place, column[at] - 1)
            weight = np.clip(DISCOUNT * followers / whole, 1e-9, 1)
            p = np.minimum((counts - DISCOUNT) / whole[group] + weight[group] * 10**lower, 1)
            keep = slice(own.goes_on, None)
            parents, words_, group = parents[keep], words_[keep], group[keep]
            _store(trie.file(level, row["part"]), LevelShard.build(parents, words_, np.log10(p[keep]), np.log10(weight[np.unique(group)])))
            # What a context lacks is looked up where the context begins.
            begun = context.goes_on and not group[0]
            yield pa.RecordBatch.from_pylist([{"number": row["part"], "first": int(parents[0]), "child": int(words_[0]) if begun else 0, "entries": len(words_), "tokens": 0}], _SHARD)


_SHARD = pa.schema([(k, pa.int64()) for k in ("number", "first", "child", "entries", "tokens")])
_SHARD_SQL = "number long, first long, child long, entries long, tokens long"


def _vocabulary(trie: Trie, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write a shard of words from a partition's sorted rows."""
    held = [[batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "key", "n")] for batch in batches if batch.num_rows]
    if held:
        part, key, n = (np.concatenate(c) for c in zip(*held, strict=True))
        for number, own in Trie._runs(part):
            _store(trie.file(1, number), VocabularyShard.build(key[own], n[own]))
            yield pa.RecordBatch.from_pylist(
                [{"number": number, "first": int(key[own][0]), "child": 0, "entries": len(key[own]), "tokens": int(n[own].sum())}], _SHARD
            )


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows by their column ``part``, neighbours together, in as many tasks as parts up to a bound."""
    tasks = min(parts, TASKS)
    return rows.repartitionById(tasks, F.floor(F.col("part") * tasks / parts).cast("int")).sortWithinPartitions("part")


def _add_words(trie: Trie, rows: DataFrame) -> None:
    """Level 1: words in the order of their hashes, which are uniform, so equal ranges are shards of equal size."""
    counted = rows.mapInArrow(_word_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "ngram-words")
    trie.vocabulary = counted.count()
    parts = max(1, -(-trie.vocabulary // SHARD))
    share = F.col("key").cast("double") / F.lit(2.0**64) + 0.5
    placed = counted.withColumn("part", F.least(F.floor(share * parts), F.lit(parts - 1)).cast("long"))
    tasks = min(parts, TASKS)
    dealt = placed.repartitionById(tasks, F.floor(F.col("part") * tasks / parts).cast("int")).sortWithinPartitions("part", "key")
    shards = dealt.mapInArrow(lambda it: _vocabulary(trie, it), _SHARD_SQL).collect()
    trie.levels.append(_level([tuple(r) for r in shards]))
    trie.total = sum(r["tokens"] for r in shards)
    discard(counted)


def train(documents: DataFrame, order: int = ORDER) -> Trie:
    """Count the rows that are not held out and build the trie, level by level."""
    spark = documents.sparkSession
    trie = Trie(scratch_path(spark, "ngram-trie"))
    rows = documents.filter(~held_out(F.col("doc_id"))).select("text")
    _add_words(trie, rows)
    if order < 2 or not trie.total:
        return trie
    parts = max(1, -(-trie.total // SHARD))
    words_only = spark.sparkContext.broadcast(trie)
    runs = rows.mapInArrow(lambda it: _ngrams(words_only.value, order, parts, it), "part long, run binary")
    merged = _dealt(runs, parts).mapInArrow(lambda it: _merged(words_only.value, order, it), "part long, edges array<long>").collect()
    merged.sort(key=lambda r: r["part"])
    edges = _resolved(merged, order)
    for level in range(2, order + 1):
        plan = [
            (k, r["part"], *([e.base, e.goes_on, *e.first, *e.last] for e in (edges[level - 2][k], edges[level - 1][k])))
            for k, r in enumerate(merged)
        ]
        trie.levels.append(_level(_shards_of(spark, trie, level, plan)))
        if not trie.levels[-1].size:
            break
    remove_path(spark, f"{trie.name}/run")
    return trie


def _shards_of(spark: SparkSession, trie: Trie, level: int, plan: list[tuple]) -> list[tuple]:
    if not plan:
        return []
    todo = spark.createDataFrame(plan, "id long, part long, context array<long>, own array<long>")
    tasks = min(len(plan), TASKS)
    shared = spark.sparkContext.broadcast(trie)
    built = todo.repartitionById(tasks, (F.col("id") % tasks).cast("int")).mapInArrow(lambda it: _built(shared.value, level, it), _SHARD_SQL)
    return [tuple(r) for r in built.collect()]


# Scoring

SCORES = "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(trie: Trie, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, limit=SLICE):
            tokens = Tokens(raw_texts(part))
            distinct, counts, _ = trie.words(tokens.hashes)
            ids, counts = distinct[tokens.at], counts[tokens.at]
            sums = [np.add.reduceat(x, tokens.starts) for x in (trie.base(counts), trie.scores(ids, counts, tokens.starts), (counts > 0).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(tokens.counts), pa.array(sums[2]),
                 pa.array(np.full(part.num_rows, trie.total)), pa.array(sums[0]), pa.array(sums[1])],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )


def score(documents: DataFrame, trie: Trie) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(trie)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(lambda it: _scored(shared.value, it), SCORES.format(kind))


def score_corpus(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """Train on the documents that are not held out and score them all."""
    return score(documents, train(documents, order))
