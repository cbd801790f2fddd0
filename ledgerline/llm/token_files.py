"""Token ids of a corpus in files, a wavelet matrix per shard.

Texts are dealt to ranges of ``doc_id`` and sorted; each task encodes its range and writes
shards one after the other, closing one once it holds ``SHARD`` tokens, so a worker holds
one shard and one slice of text. Every document is closed by the id ``END``. What a task
returns is a row per shard: the manifest. Where a shard begins in the whole corpus is the
tokens of all ranges before (one row a range passes a window) and of the shards before it in its range.

Texts are encoded by the vocabulary file's tokenizer. For byte-level BPE a text may be cut
before a lone space between visible characters, around a lone line feed there, and
between a letter and a mark: pre-tokens begin at these places whatever stands around them,
so the pieces' ids are the whole text's ids (tested). Hence each distinct piece of a slice is encoded once,
words that are new are encoded together, and a worker keeps the pieces that it met last with their ids. Pieces and
their ids stay in Arrow arrays. A text without such places is one piece; texts of
other kinds of tokenizer are never cut.

Reading back takes a task per shard. Beside whole documents, the files answer what an id
is at a position of the corpus, how often ids occur and where, without decoding a shard.

Files go to the shared folder under temporary names and are renamed; repeated attempts write
the same bytes. Rows that share an id are ordered by a hash of their text, so equal rows lie
together; a null id comes first. Rows alike in both are dealt over ranges as well.

Edge cases: a null text is empty and holds the end id only; a very long text makes a long
shard of its own; repeated rows are documents of their own; an empty table gives no shard
and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import text_key, text_slices
from ledgerline.llm.ngram_lm import _fetched as fetched
from ledgerline.llm.ngram_lm import _store as store
from ledgerline.llm.wavelet import WaveletMatrix, pack
from ledgerline.plans.materialise import discard, materialise
from ledgerline.plans.spread import estimated_bytes
from ledgerline.session import scratch_path

#: Default vocabulary file; a parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Id that closes a document, tokens that close a shard, bytes of text encoded at once.
END, SHARD, SLICE = 0, 1 << 22, 8 << 20
#: Bytes of input (as the plan estimates it) in a range, and most tasks that read shards.
RANGE, TASKS = 128 << 20, 20_000
#: Pieces that a worker remembers, the longest of them in bytes, pieces encoded in one call, and words in one text of it.
KNOWN, LONGEST, GROUP, TOGETHER = 1 << 19, 64, 4096, 64


# Encoding

_VISIBLE = np.array([0x20 < b < 0x7F for b in range(256)])
_LETTER = np.array([chr(b).isalpha() and b < 0x80 for b in range(256)])
#: Lead bytes of U+00C0 to U+07FF, among which there is no white space, and what follows them.
_LEAD = np.array([0xC3 <= b <= 0xDF for b in range(256)])
_LATER = np.array([0x80 <= b <= 0xBF for b in range(256)])


def _closing_marks(spec: dict) -> bytes | None:
    """Marks before which a text may be cut after a letter; None where texts may not be cut at all.

    Cuts need byte-level pre-tokens, and must not divide an added token.
    """
    before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = spec.get("normalizer") is None and spec.get("truncation") is None and spec.get("padding") is None
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not (plain and byte_level) or any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return None
    inside = "".join(t["content"] for t in added)
    return bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'" + inside)


def piece_starts(data: np.ndarray, starts: np.ndarray, marks: bytes) -> np.ndarray:
    """Where pieces begin among the bytes of texts that begin at ``starts``.

    Cuts lie before a lone space, before and after a lone line feed between visible characters, and
    between an ASCII letter and a mark.
    """
    begins = np.zeros(len(data), dtype=bool)
    table = np.zeros(256, dtype=np.uint8)
    table[list(marks)], table[_LETTER], table[[0x20, 0x0A]] = 1, 2, 4
    kinds = np.frombuffer(data.tobytes().translate(table.tobytes()), np.uint8)
    begins[1:] = kinds[1:] & kinds[:-1] >> 1 & 1
    at = np.flatnonzero(kinds & 4)
    at = at[(at > 1) & (at + 1 < len(data))]
    before, after = data[at - 1], data[at + 1]
    clear = _VISIBLE[before] | _LATER[before] & _LEAD[data[at - 2]]
    at = at[clear & (_VISIBLE[after] | _LEAD[after])]
    begins[at] = True
    begins[at[data[at] == 0x0A] + 1] = True
    begins[starts] = True
    return np.flatnonzero(begins)


def _laid_out(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values (without nulls), and where each begins among them and the last ends."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset) if len(pieces) else np.zeros(1, np.int64)
    return np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _are_words(pieces: pa.Array) -> np.ndarray:
    """Which pieces keep their ids between others of their kind: a space, a visible character, and one at the end."""
    data, offsets = _laid_out(pieces)
    word, size = np.zeros(len(pieces), dtype=bool), np.diff(offsets)
    own = np.flatnonzero(size > 1)
    low, high = offsets[own], offsets[own + 1] - 1
    first, second = data[low], data[low + 1]
    clear = _VISIBLE[second] | _LEAD[second] & (size[own] > 2) & _LATER[data[np.minimum(low + 2, high)]]
    word[own] = (first == 0x20) & clear & (_VISIBLE[data[high]] | _LATER[data[high]] & _LEAD[data[high - 1]])
    return word


class Encoder:
    """Ids of texts, each closed by ``END``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.marks = _closing_marks(json.load(f))
        added = {k: len(t.content.encode()) for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # bytes of each id
        for token, k in vocabulary.items():
            self.sizes[k] = added.get(k, len(token))
        # Pieces met before, the bytes of their ids, and the slice that held each last; the first, an empty piece, closes each text.
        self.known, self.ids = pa.array([b""], pa.large_binary()), _binary(np.array([END], dtype=np.uint32), np.array([0, 4]))
        self.last, self.slices = np.array([np.iinfo(np.int64).max]), 0

    def _coded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(code.ids, dtype=np.uint32) for code in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of words, several of them encoded as one text and told apart by the bytes of their ids, and which words were encoded."""
        data, offsets = _laid_out(words)
        done, coded = np.ones(len(words), dtype=bool), []
        for low in range(0, len(words), GROUP):
            texts = []
            for a in range(low, min(low + GROUP, len(words)), TOGETHER):
                b = min(a + TOGETHER, len(words))
                try:
                    texts.append(str(data[offsets[a] : offsets[b]], "utf-8"))
                except UnicodeDecodeError:  # what replaces broken characters has other sizes
                    done[a:b] = False
            coded += self._coded(texts)
        ids = np.concatenate([np.zeros(0, np.uint32), *coded])
        upto = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(np.diff(offsets)[done])) + 1
        return _binary(ids, 4 * np.concatenate([[0], upto])), done

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids of distinct pieces, as bytes."""
        word = np.flatnonzero(_are_words(pieces) & (self.marks is not None))
        words, done = self._words(pieces.take(pa.array(word)))
        others = np.setdiff1d(np.arange(len(pieces)), word[done])
        found = [words]
        for low in range(0, len(others), GROUP):
            own = pieces.take(pa.array(others[low : low + GROUP])).to_pylist()
            found.append(pa.array([ids.tobytes() for ids in self._coded([p.decode("utf-8", "replace") for p in own])], pa.large_binary()))
        return pa.concat_arrays(found).take(pa.array(np.argsort(np.concatenate([word[done], others]))))

    def _fresh(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each piece with its ids."""
        return zip(pieces, self._pieces(pa.array(pieces, pa.large_binary())).to_pylist(), strict=True)

    def _remember(self, pieces: pa.Array, ids: pa.Array, last: np.ndarray) -> None:
        """Keep the short pieces, at most ``KNOWN``, of which those that a slice held last."""
        keep = np.flatnonzero(np.diff(_laid_out(pieces)[1]) <= LONGEST)
        if len(keep) > KNOWN:
            keep = np.sort(keep[np.argpartition(-last[keep], KNOWN)[:KNOWN]])
        at = pa.array(keep)
        self.known, self.ids, self.last = pieces.take(at), ids.take(at), last[keep]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's ids end."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data, bounds = _laid_out(texts.fill_null("").cast(pa.large_binary()))
        starts, ends = bounds[:-1], bounds[1:]
        starts = starts[starts < ends]
        begin = starts if self.marks is None or not len(data) else piece_starts(data, starts, self.marks)
        closed = np.searchsorted(begin, ends, side="left")  # pieces before each text's end
        cut = _binary(data, np.append(np.insert(begin, closed, ends), len(data)))
        numbered = pa.chunked_array([self.known, cut]).dictionary_encode()  # known pieces keep their places
        pieces, at = numbered.chunk(0).dictionary, numbered.chunk(1).indices
        ids = pa.concat_arrays([self.ids, self._pieces(pieces.slice(len(self.known)))])
        self.slices += 1
        last = np.full(len(pieces), self.slices)
        last[: len(self.known)] = self.last
        last[at.to_numpy()[at.to_numpy() > 0]] = self.slices
        self._remember(pieces, ids, last)
        flat, upto = _laid_out(ids.take(at))
        return flat.view(np.uint32), upto[closed + np.arange(1, len(ends) + 1)] // 4


@lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


# Writing

_MANIFEST = "part long, number long, path string, before long, n_docs long, n_tokens long"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in slices of some ``SLICE`` bytes, small batches together: each slice goes through the known pieces."""
    held, size = [], 0
    for batch in batches:
        for piece in text_slices(batch, limit=SLICE):
            if held and size + piece.nbytes > SLICE:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(piece)
            size += piece.nbytes
    if held:
        yield pa.concat_batches(held)


def _written(path: str, name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encode a range's sorted rows, write its shards and return a row for each."""
    encoder, part = _encoder(SparkFiles.get(name)), TaskContext.get().partitionId()
    held, size, number, before = [], 0, 0, 0

    def close() -> pa.RecordBatch:
        ids = np.concatenate([h[0] for h in held])
        shift = np.cumsum([0, *(len(h[0]) for h in held)])
        ends = np.concatenate([h[1] + s for h, s in zip(held, shift, strict=False)])
        file = f"{path}/{part:06d}-{number:06d}.wave"
        store(file, pack(ids, ends, pa.concat_arrays([h[2] for h in held])))
        return pa.RecordBatch.from_pydict(
            {"part": [part], "number": [number], "path": [file], "before": [before], "n_docs": [len(ends)], "n_tokens": [len(ids)]}
        )

    for piece in _gathered(batches):
        ids, ends = encoder.encode(piece.column("text"))
        first = 0
        while first < len(ends):  # documents up to the one that fills the shard
            begin = int(ends[first - 1]) if first else 0
            last = min(int(np.searchsorted(ends, begin + SHARD - size)) + 1, len(ends))
            held.append((ids[begin : ends[last - 1]], ends[first:last] - begin, piece.column("doc_id").slice(first, last - first)))
            size += int(ends[last - 1]) - begin
            first = last
            if size >= SHARD:
                yield close()
                held, size, number, before = [], 0, number + 1, before + size
    if held:
        yield close()


def write(documents: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write all texts and return the manifest: ``part, number, path, n_docs, n_tokens, start`` of each shard.

    ``path`` is a folder that all executors share, by default one below the shared folder.
    """
    spark = documents.sparkSession
    path = path or scratch_path(spark, "token-files")
    name = _shipped(spark, tokenizer)
    rows = documents.select("doc_id", "text", text_key().alias("_text"), F.monotonically_increasing_id().alias("_row"))
    size = estimated_bytes(documents)  # Spark takes what it knows nothing of to be endless
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE) if size < 1 << 60 else 0)
    order = [F.col("doc_id").asc_nulls_first(), F.col("_text"), F.col("_row")]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
    shards = materialise(dealt.mapInArrow(lambda it: _written(path, name, it), _MANIFEST), "token-shards")
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = shards.join(totals, "part").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")
    manifest = materialise(placed, "token-manifest")
    discard(shards)
    return manifest


def _shipped(spark, tokenizer: str) -> str:
    spark.sparkContext.addFile(tokenizer)
    return os.path.basename(tokenizer)


# Reading


def _per_shard(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(max(1, min(manifest.count(), TASKS)), "part", "number")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, WaveletMatrix]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row, WaveletMatrix(fetched(row["path"])[0])


def _documents(whole: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each shard with their ids, or with a checksum of these."""
    for row, shard in _opened(batches):
        ids, named = shard.ids(), shard.documents()
        first, last = shard.bounds(np.arange(shard.count_documents))
        for low in range(0, len(named), 4096):
            cut = slice(low, low + 4096)
            bounds = list(zip(first[cut].tolist(), last[cut].tolist(), strict=True))
            if whole:
                offsets = np.append(first[cut], last[cut][-1]) - first[low]
                told = pa.ListArray.from_arrays(offsets.astype(np.int32), ids[first[low] : last[cut][-1]].astype(np.int32))
            else:
                told = pa.array([zlib.crc32(ids[a:b].astype("<u4")) for a, b in bounds], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [named.slice(low, 4096), pa.array(first[cut] + row["start"]), pa.array(last[cut] - first[cut]), told],
                ["doc_id", "start", "n_tokens", "ids" if whole else "ids_crc32"],
            )


def read(manifest: DataFrame, kind: str = "long") -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, from the files; ``kind`` is the type of its id."""
    return _per_shard(manifest).mapInArrow(lambda it: _documents(True, it), f"doc_id {kind}, start long, n_tokens long, ids array<int>")


def checksums(manifest: DataFrame, kind: str = "long") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files: of its ids as little-endian 32-bit numbers."""
    return _per_shard(manifest).mapInArrow(lambda it: _documents(False, it), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def _counted(tokens: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, shard in _opened(batches):
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], ["token", "n"])


def count(manifest: DataFrame, tokens: list[int]) -> DataFrame:
    """``token, n``: how often each of the ids occurs."""
    each = _per_shard(manifest).mapInArrow(lambda it: _counted(tokens, it), "token long, n long")
    return each.groupBy("token").agg(F.sum("n").alias("n"))


def _found(tokens: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, shard in _opened(batches):
        named = shard.documents()
        for token in tokens:
            total = shard.count(token)
            for low in range(0, total, 1 << 16):
                at = shard.select(token, np.arange(low, min(low + (1 << 16), total)))
                document = shard.document_of(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), token)), named.take(pa.array(document)), pa.array(at - shard.bounds(document)[0]), pa.array(at + row["start"])],
                    ["token", "doc_id", "place", "position"],
                )


def occurrences(manifest: DataFrame, tokens: list[int], kind: str = "long") -> DataFrame:
    """``token, doc_id, place, position``: where the ids occur, in their document and in the corpus."""
    return _per_shard(manifest).mapInArrow(lambda it: _found(tokens, it), f"token long, doc_id {kind}, place long, position long")


def _looked_up(positions: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, shard in _opened(batches):
        own = positions[(positions >= row["start"]) & (positions < row["start"] + shard.n)]
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(shard.access(own - row["start"]))], ["position", "token"])


def tokens_at(manifest: DataFrame, positions: list[int]) -> DataFrame:
    """``position, token`` for positions of the corpus."""
    asked = np.unique(np.array(positions, dtype=np.int64))
    low, high = (int(asked[0]), int(asked[-1])) if len(asked) else (0, -1)
    near = manifest.filter((F.col("start") <= high) & (F.col("start") + F.col("n_tokens") > low))
    return _per_shard(near).mapInArrow(lambda it: _looked_up(asked, it), "position long, token long")


def round_trip(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Write all texts and return ``doc_id, start, n_tokens, ids_crc32`` of each document as read back."""
    return checksums(write(documents, tokenizer=tokenizer), documents.schema["doc_id"].dataType.simpleString())
