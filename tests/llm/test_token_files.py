"""Token files: the wavelet matrix, cutting before encoding, and the round trip."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import queries, token_files, wavelet

DOCS = "doc_id long, text string, part long, start string, n_tokens long"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_files.TOKENIZER)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], DOCS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=60), max_size=12), st.integers(0, 2**31))
def test_matrix_answers_as_the_list(texts, add):
    flat = [t + add * (t == 7) for text in texts for t in text]
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
    data = wavelet.pack(np.array(flat, dtype=np.uint32), ends, pa.array(range(len(texts)), pa.int64()))
    shard = wavelet.WaveletMatrix(data)
    assert shard.ids().tolist() == flat and shard.documents().to_pylist() == list(range(len(texts)))
    every = np.arange(len(flat))
    assert shard.access(every).tolist() == flat
    assert shard.document_of(every).tolist() == [k for k, text in enumerate(texts) for _ in text]
    for token in {*flat, 5, 10**10}:
        places = [k for k, t in enumerate(flat) if t == token]
        assert shard.count(token) == len(places)
        assert shard.select(token, np.arange(len(places))).tolist() == places
        assert shard.rank(token, np.arange(len(flat) + 1)).tolist() == [sum(p < i for p in places) for i in range(len(flat) + 1)]


def test_matrix_over_many_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    flat = np.minimum(rng.geometric(0.002, 3 * wavelet.BLOCK + 777), 50_000).astype(np.uint32)
    data = wavelet.pack(flat, np.array([len(flat)]), pa.array(["a"]))
    assert len(data) < flat.nbytes / 2
    monkeypatch.setattr(wavelet, "KEPT", 3)
    shard = wavelet.WaveletMatrix(data)
    asked = rng.integers(0, len(flat), 500)
    assert (shard.access(asked) == flat[asked]).all() and (shard.ids() == flat).all() and len(shard._kept) == 3
    places = np.flatnonzero(flat == 9)
    assert (shard.select(9, np.arange(len(places))) == places).all()
    with pytest.raises(ValueError, match="token file"):
        wavelet.WaveletMatrix(b"x" * 100)


@pytest.mark.parametrize("top", [0, 65_535, 65_536, 2**32 - 1])
def test_matrix_dealt_by_windows(monkeypatch, top):
    monkeypatch.setattr(wavelet, "WINDOW", 7)
    flat = np.array([top, 0, 1, top // 2, top] * 5, dtype=np.uint32)
    data = wavelet.pack(flat, np.array([len(flat)]), pa.array(["a"]))
    monkeypatch.setattr(wavelet, "WINDOW", 1 << 16)
    assert wavelet.pack(flat, np.array([len(flat)]), pa.array(["a"])) == data
    monkeypatch.setattr(wavelet, "WINDOW", 4)
    shard = wavelet.WaveletMatrix(data)
    assert shard.ids().dtype == np.uint32 and (shard.ids() == flat).all() and (shard.access(np.arange(len(flat))) == flat).all()


ALPHABET = st.sampled_from([*"abc1 .,'!&\n\tsé ж    　\u0085漢😀ß", "<|endoftext|>", " the", " <", "|>", "'ll", "  "])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=30).map("".join), max_size=5))
def test_pieces_give_the_ids_of_whole_texts(texts):
    plain = token_files._encoder(token_files.TOKENIZER).tokenizer
    ids, ends = token_files._encoder(token_files.TOKENIZER).encode(pa.array(texts, pa.string()))
    want = [[*plain.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == want and (len(ids) == ends[-1] if texts else not len(ids))


def test_broken_characters_are_replaced():
    encoder = token_files.Encoder(token_files.TOKENIZER)
    words = [b" new\xff\xc3word", " nextéword".encode()]
    want = [np.array(encoder.tokenizer.encode(w.decode("utf-8", "replace")).ids, dtype=np.uint32).tobytes() for w in words]
    assert dict(encoder._fresh(words)) == dict(zip(words, want, strict=True))


def test_other_tokenizers_are_never_cut(tokenizer):
    assert token_files._encoder(token_files.TOKENIZER).marks
    path = token_files.TOKENIZER.replace("byte_bpe_50k", "word_bpe_49k")
    other = token_files._encoder(path)
    text = "Some words , twice some  words"
    assert other.marks is None
    assert other.encode(pa.array([text]))[0].tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 0]


def test_other_tokenizers_encode_texts_apart():
    path = token_files.TOKENIZER.replace("byte_bpe_50k", "word_bpe_49k")
    plain, texts = Tokenizer.from_file(path), [" two words", " two", None, " two words", " éa b"]
    ids, ends = token_files._encoder(path).encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [[*plain.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


class Counting:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.given += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_pieces_that_every_slice_holds_are_encoded_once(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN", 5)  # four pieces of a slice and what closes a text
    encoder = token_files.Encoder(token_files.TOKENIZER)
    encoder.tokenizer = Counting(tokenizer)
    for k in range(9):
        text = f"often common {'abcdefghi'[k] * 7} words"
        ids, ends = encoder.encode(pa.array([text, None]))
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0, 0] and ends.tolist() == [len(ids) - 1, len(ids)]
    given = "".join(encoder.tokenizer.given)
    assert [given.count(w) for w in ("often", " common", " words", " bbbbbbb")] == [1, 1, 1, 1]
    assert len(encoder.known) <= 5


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b" ", b"a", b"\n", b",", b"\xc3", b"\xa9", b"\xc2", b"\xe4", b"\xdf"]), max_size=5).map(b"".join), max_size=9))
def test_words_are_told_apart_at_once(pieces):
    letter = rb"(?:[!-~]|[\xc3-\xdf][\x80-\xbf])"
    word = re.compile(rb" %b(?:.*%b)?" % (letter, letter), re.DOTALL)
    padded = pa.array([b" before", *pieces, b"after"], pa.large_binary()).slice(1, len(pieces))
    assert token_files._are_words(padded).tolist() == [bool(word.fullmatch(p)) for p in pieces]


def test_small_batches_are_encoded_together(monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 4000)
    rows = [(k, None if k % 3 == 0 else "x" * (k % 7)) for k in range(300)] + [(300, "y" * 9000), (301, "z")]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    slices = list(token_files._gathered(iter(table.to_batches(max_chunksize=2))))
    assert [(r["doc_id"], r["text"]) for s in slices for r in s.to_pylist()] == rows
    assert len(slices) < 10 and all(s.nbytes <= 4000 or s.num_rows == 1 for s in slices)
    assert list(token_files._gathered(iter([]))) == []


def brute(rows, tokenizer):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


ROWS = [(5, "one two"), (3, None), (None, "no id here"), (9, ""), (4, "word " * 30_000), (8, "x" * 5000), (-2, "<|endoftext|> a"), (7, "one two")]


@pytest.mark.parametrize("shard", [1 << 22, 1, 9])
def test_round_trip_equals_brute_force(spark, tokenizer, monkeypatch, shard):
    monkeypatch.setattr(token_files, "SHARD", shard)
    got = token_files.round_trip(docs(spark, ROWS))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute(ROWS, tokenizer)


def test_rows_that_share_ids_and_no_rows(spark, tokenizer):
    rows = [(None, "")] * 40 + [(1, "b"), (1, "a a"), (1, "b")]
    got = sorted(map(tuple, token_files.round_trip(docs(spark, rows)).collect()), key=lambda r: r[1])
    assert sorted((i, n, c) for i, _, n, c in got if i) == sorted((i, n, c) for i, _, n, c in brute(rows, tokenizer) if i)
    assert [s for _, s, _, _ in got] == [0, *np.cumsum([n for _, _, n, _ in got])[:-1].tolist()]
    assert token_files.round_trip(docs(spark, [])).collect() == []


def test_lookups_on_the_files(spark, tokenizer):
    manifest = token_files.write(docs(spark, ROWS))
    assert sum(r["n_docs"] for r in manifest.collect()) == len(ROWS)
    whole = sorted((tuple(r) for r in token_files.read(manifest).collect()), key=lambda r: r[1])
    flat = [t for _, _, _, ids in whole for t in ids]
    assert [(i, n) for i, _, n, _ in whole] == [(i, n) for i, _, n, _ in brute(ROWS, tokenizer)]
    word = tokenizer.encode(" two").ids[0]
    assert {tuple(r) for r in token_files.count(manifest, [0, word, 49_999]).collect()} == {(t, flat.count(t)) for t in (0, word, 49_999)}
    found = sorted((r["position"], r["doc_id"], r["place"]) for r in token_files.occurrences(manifest, [word]).collect())
    assert found == [(s + k, i, k) for i, s, _, ids in whole for k, t in enumerate(ids) if t == word]
    asked = [0, 5, len(flat) - 1, len(flat), -1]
    assert sorted(map(tuple, token_files.tokens_at(manifest, asked).collect())) == sorted((p, flat[p]) for p in asked[:3])


def test_query_equals_brute_force(spark, sf, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.queries()["op12_token_files"](spark, sf).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows, tokenizer)
