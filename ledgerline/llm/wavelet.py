"""A wavelet matrix of token ids in one compressed file, read in place from a buffer.

Plane k holds bit k (from the highest) of every id, ids being dealt stably by that bit
before the next plane: zeros first, then ones. A plane is cut into blocks of ``BLOCK`` bits,
each stored compressed where that is shorter; a directory has each block's place and the
ones before it. So rank is a directory entry and a count in one block, select a search in
the directory and a step in one block, and

* the id at a position follows its bits down the planes by rank,
* the occurrences of an id before a position are a range followed down by rank,
* the place of an id's k-th occurrence goes down by rank and back up by select.

Positions and occurrence numbers start at 0; all operations take and give whole arrays
and decompress only the blocks they touch. Beside the planes stand documents: their ids, and
where each ends, as an Elias-Fano sequence.

Layout: 8 bytes of magic; int64s: tokens, planes, documents, blocks a plane, bytes of the
document ids; the document ids (a compressed Arrow stream of one column, padded to 8 bytes);
their ends (Elias-Fano); ones before each block and in total, by plane; place of
each block, by plane, and of the end; the blocks.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from ledgerline.llm.eliasfano import EliasFano, encode

MAGIC = b"TOKWAVE1"
#: Bits of a block (a multiple of 64), blocks a reader keeps decompressed, and ids dealt at once, few enough for a processor's cache.
BLOCK, KEPT, WINDOW = 1 << 15, 4096, 1 << 16
_WORDS = BLOCK // 64


def _held(planes: int) -> type:
    """The smallest type that holds ids of so many bits."""
    return np.uint16 if planes <= 16 else np.uint32


def _dealt(set_: np.ndarray) -> Iterator[tuple[slice, np.ndarray, slice, np.ndarray, slice]]:
    """By windows of a plane: the window, the places of zeros and of ones in it, each with where these stand in the next plane."""
    zero, one = 0, len(set_) - int(np.count_nonzero(set_))
    for low in range(0, len(set_), WINDOW):
        own = slice(low, low + WINDOW)
        off, on = np.flatnonzero(~set_[own]), np.flatnonzero(set_[own])
        yield own, off, slice(zero, zero + len(off)), on, slice(one, one + len(on))
        zero, one = zero + len(off), one + len(on)


def pack(ids: np.ndarray, ends: np.ndarray, documents: pa.Array) -> bytes:
    """The file of a shard: token ids, the end of each document among them, and the documents' ids."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    rest = ids.astype(_held(planes))
    below = np.empty_like(rest)
    blocks = -(-len(rest) // BLOCK)
    squeeze, stored, ones = zstandard.ZstdCompressor(level=3), [], np.zeros((planes, blocks + 1), dtype=np.int64)
    for k in range(planes):
        set_ = (rest & rest.dtype.type(1 << (planes - 1 - k))) != 0
        raw = np.zeros(blocks * BLOCK // 8, dtype=np.uint8)
        packed = np.packbits(set_, bitorder="little")
        raw[: len(packed)] = packed
        for b, block in enumerate(raw.reshape(blocks, BLOCK // 8)):
            ones[k, b + 1] = ones[k, b] + int(np.bitwise_count(block).sum())
            short = squeeze.compress(block.tobytes())
            stored.append(short if len(short) < BLOCK // 8 else block.tobytes())
        for own, off, low, on, high in _dealt(set_):
            below[low], below[high] = rest[own][off], rest[own][on]
        rest, below = below, rest
    sink = pa.BufferOutputStream()
    table = pa.table({"doc_id": documents})
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    named = sink.getvalue().to_pybytes()
    named += b"\0" * (-len(named) % 8)
    head = [len(ids), planes, len(documents), blocks, len(named)]
    front = [MAGIC, np.array(head, dtype=np.int64).tobytes(), named, encode(ends.astype(np.uint64), len(ids)), ones.tobytes()]
    places = np.cumsum([sum(map(len, front)) + 8 * (len(stored) + 1), *map(len, stored)]).astype(np.int64)
    return b"".join([*front, places.tobytes(), *stored])


class WaveletMatrix:
    """A view on a shard's file."""

    def __init__(self, buffer):
        self.buffer = memoryview(buffer)
        if bytes(self.buffer[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.n, self.planes, self.count_documents, self.blocks, named = np.frombuffer(buffer, np.int64, 5, 8).tolist()
        self._named = (48, named)
        self.ends = EliasFano(buffer, 48 + named)
        self.ones = np.frombuffer(buffer, np.int64, self.planes * (self.blocks + 1), self.ends.end).reshape(self.planes, -1)
        at = self.ends.end + 8 * self.ones.size
        self.places = np.frombuffer(buffer, np.int64, self.planes * self.blocks + 1, at)
        self.zeros = self.n - self.ones[:, -1]
        self._kept: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def documents(self) -> pa.Array:
        start, size = self._named
        with pa.ipc.open_stream(pa.py_buffer(self.buffer[start : start + size])) as source:
            return source.read_all().column(0).combine_chunks()

    def bounds(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First position and position after the last of documents k."""
        last = self.ends.access(k).astype(np.int64)
        return np.where(k > 0, self.ends.access(np.maximum(k - 1, 0)).astype(np.int64), 0), last

    def document_of(self, positions: np.ndarray) -> np.ndarray:
        """The document that holds each position (every document holds one token at least)."""
        low, high = np.zeros(len(positions), dtype=np.int64), np.full(len(positions), self.count_documents)
        while (live := np.flatnonzero(low < high)).size:
            mid = low[live] + high[live] >> 1
            past = self.ends.access(mid).astype(np.int64) <= positions[live]
            low[live], high[live] = np.where(past, mid + 1, low[live]), np.where(past, high[live], mid)
        return low

    def _raw(self, plane: int, block: int) -> bytes:
        at = plane * self.blocks + block
        data = self.buffer[self.places[at] : self.places[at + 1]]
        return bytes(data) if len(data) == BLOCK // 8 else zstandard.ZstdDecompressor().decompress(bytes(data))

    def _block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of a block, and the ones before each word of the plane."""
        key = plane * self.blocks + block
        if key in self._kept:
            self._kept.move_to_end(key)
        else:
            words = np.frombuffer(self._raw(plane, block), np.uint64)
            before = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words) + self.ones[plane, block]
            self._kept[key] = words, before
            while len(self._kept) > KEPT:
                self._kept.popitem(last=False)
        return self._kept[key]

    def _rank(self, plane: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each position of a plane, and the bit there (0 at the end)."""
        ones, bit = np.full(len(at), self.ones[plane, -1]), np.zeros(len(at), dtype=np.int64)
        for block in np.unique(at[at < self.n] // BLOCK).tolist():
            own = np.flatnonzero(at // BLOCK == block)
            words, before = self._block(plane, block)
            word, off = (at[own] % BLOCK) // 64, (at[own] % 64).astype(np.uint64)
            ones[own] = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << off) - np.uint64(1)))
            bit[own] = (words[word] >> off & np.uint64(1)).astype(np.int64)
        return ones, bit

    def _select(self, plane: int, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of one (or zero) number k in a plane."""
        directory = self.ones[plane] if one else np.minimum(np.arange(self.blocks + 1) * BLOCK, self.n) - self.ones[plane]
        block, out = np.searchsorted(directory, k, side="right") - 1, np.empty(len(k), dtype=np.int64)
        for b in np.unique(block).tolist():
            own = np.flatnonzero(block == b)
            words, before = self._block(plane, b)
            if not one:
                before = b * BLOCK + np.arange(_WORDS) * 64 - before
            word = np.searchsorted(before, k[own], side="right") - 1
            held = words[word] if one else ~words[word]
            out[own] = b * BLOCK + word * 64 + EliasFano._in_word(held, k[own] - before[word])
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at positions."""
        out = np.zeros(len(at), dtype=np.int64)
        for k in range(self.planes):
            ones, bit = self._rank(k, at)
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return out

    def _range(self, token: int, at: np.ndarray) -> np.ndarray:
        """Where each position's prefix ends among the bottom plane's ids equal to ``token``."""
        for k in range(self.planes):
            ones, _ = self._rank(k, at)
            at = self.zeros[k] + ones if token >> (self.planes - 1 - k) & 1 else at - ones
        return at

    def rank(self, token: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of an id before positions (0 to n)."""
        if not 0 <= token < 1 << self.planes:
            return np.zeros(len(at), dtype=np.int64)
        ends = self._range(token, np.concatenate([[0], at]))
        return ends[1:] - ends[0]

    def count(self, token: int) -> int:
        return int(self.rank(token, np.array([self.n]))[0])

    def select(self, token: int, k: np.ndarray) -> np.ndarray:
        """Positions of an id's occurrences k, each below ``count(token)``."""
        at = self._range(token, np.zeros(1, dtype=np.int64))[0] + k
        for plane in range(self.planes - 1, -1, -1):
            one = bool(token >> (self.planes - 1 - plane) & 1)
            at = self._select(plane, at - self.zeros[plane] if one else at, one)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order: the planes undone from the last, each a stable merge of its two halves."""
        out = np.zeros(self.n, dtype=_held(self.planes))
        above = np.empty_like(out)
        for k in range(self.planes - 1, -1, -1):
            raw = np.frombuffer(b"".join(self._raw(k, b) for b in range(self.blocks)), np.uint8)
            set_ = np.unpackbits(raw, count=self.n, bitorder="little").astype(bool)
            bit = out.dtype.type(1 << (self.planes - 1 - k))
            for own, off, low, on, high in _dealt(set_):
                window = above[own]
                window[off], window[on] = out[low], out[high] | bit
            out, above = above, out
        return out.astype(np.uint32)
