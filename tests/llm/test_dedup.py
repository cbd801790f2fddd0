"""Exact, near, substring and line dedup against brute force."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import exact_dedup, golay, line_dedup, queries, simhash, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, first long, h string"


def frame(spark, rows):
    """Documents with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, "x") for i, t in rows], DOCS)


LONG = "".join(f"Sentence number {i} of a rather long text about nothing. " for i in range(4000))
CASES = [
    (1, "same"), (2, "same"), (3, None), (4, ""), (5, "Same"), (6, LONG), (7, LONG), (8, LONG + "x"), (9, "a\nb"), (9, "a\nb"), (None, "lonely"),
]


# Exact


def test_chunks_join_to_text(spark):
    rows = frame(spark, CASES).filter("text is not null")
    out = rows.select("text", F.array_join(exact_dedup.chunk_list(F.col("text"), 16, 64), "").alias("again")).collect()
    assert all(r["text"] == r["again"] for r in out)


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_groups_even_when_digests_collide(spark, bits):
    got = exact_dedup.exact_duplicates(frame(spark, CASES), bits).collect()
    groups = {}
    for i, t in CASES:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(CASES)
    for r in got:
        text = next(t or "" for i, t in CASES if hashlib.sha256((t or "").encode()).hexdigest() == r["text_sha256"])
        ids = groups[text]
        assert r["group_size"] == len(ids)
        keep = max((i for i in ids if i is not None), default=None)
        assert r["keep_id"] == keep and r["kept"] == (r["doc_id"] == keep)


def test_exact_empty_and_drop(spark):
    assert exact_dedup.exact_duplicates(frame(spark, CASES).limit(0)).count() == 0
    kept = exact_dedup.drop_exact_duplicates(frame(spark, CASES[:8]))
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 7, 8]


# Lines


def brute_lines(rows):
    strip = " \t\n\x0b\f\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    first = {}
    for i, t in sorted(rows):
        for line in (t or "").split("\n"):
            key = line.strip(strip).translate(lower)
            if len(key) >= 10:
                first.setdefault(key, i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(k := x.strip(strip).translate(lower)) < 10 or first[k] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


LINES = [
    (4, "A shared line here\nown line of four"), (2, "  a SHARED line here\t\nshort\nshort\na shared line here"), (3, None), (7, ""),
    (5, "short\nÉCOLE partagée ici\n"), (6, "École partagée ici\nÉCOLE PARTAGÉE ICI\nécole partagée ici"), (8, "\n\n a shared line here \n"), (1, "x" * 9 + "\n" + "x" * 10), (9, "X" * 10),
]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (3, 3)])
def test_lines_match_brute_force(spark, batches, fanout):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(frame(spark, LINES), batches, fanout).collect()}
    assert got == brute_lines(LINES)


def test_lines_empty_table_and_null_id(spark):
    assert line_dedup.dedup_lines(frame(spark, LINES).limit(0)).count() == 0
    rows = [(None, "a shared line here"), (1, "a shared line here")]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {None: 1, 1: 0}


def test_runs_are_compacted(spark):
    store = line_dedup.LineRuns(spark, buckets=2, fanout=2)
    for i in range(5):
        store.add(spark.createDataFrame([(i, i, i), (i + 1, i + 1, i)], "h long, g long, owner long"))
    assert [len(level) for level in store.runs] == [1, 0, 1]
    seen = sorted(r["h"] for t in store.tables() for r in spark.table(t).collect())
    assert seen == list(range(6))
    store.close()


# SimHash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_golay_code_is_perfect():
    words = golay.codewords()
    weights = np.bitwise_count(words[1:])
    assert weights.min() == 7 and len(set(words.tolist())) == 4096
    rng = np.random.default_rng(1)
    some = rng.integers(0, 1 << 23, 500, dtype=np.uint32)
    near = words[golay.decoder()[some]]
    assert (np.bitwise_count(near ^ some) <= 3).all()


def test_nearby_holds_neighbours_codeword():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 22, 300, dtype=np.uint32)
    b = a ^ (np.uint32(1) << rng.integers(0, 22, 300).astype(np.uint32))
    (near, mask), own = golay.nearby(a, 22), golay.decoder()[b]
    assert all(o in n[m] for o, n, m in zip(own, near, mask, strict=True))


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_connect_all_near_fingerprints(spark, limit):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base.tolist():
        for _ in range(14):
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    want = components(fps, [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4])
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit).collect()
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in got]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    assert components(fps, pairs) == want


def test_near_duplicates_match_brute_force(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[: 200 + i % 3])) for i in range(6)]
    rows += [(10, None), (11, " \t\n"), (12, "one two"), (13, "ONE Two"), (14, "É a b c d"), (15, "é a b c d"), (20, LONG), (21, LONG + " tail")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = components(fps, [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_near_duplicates_on_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fps = {i: brute_fingerprint(t) for i, t in rows}
    want = components(fps, [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    got = queries.op2_simhash(spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


# Substrings


def spelled(text):
    return substring_dedup.spelled(np.frombuffer(text, dtype=np.uint8))[2]


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=0, max_size=60), st.binary(min_size=0, max_size=60))
def test_boundaries_resist_insertions(head, other):
    body = b" " + b" ".join(np.random.default_rng(5).integers(97, 123, 600, dtype=np.uint8).reshape(200, 3).view("S3").ravel())
    cuts = []
    for lead in (head, other):
        words, before = spelled(lead + body), len(spelled(lead)) if lead else 0
        ends = substring_dedup.boundaries(words)
        assert ends[-1] == len(words) == before + 200 and (np.diff(ends) > 0).all()
        cuts.append({int(e) - before for e in ends if e - before > substring_dedup.WINDOW + 2 * substring_dedup.REACH})
    assert cuts[0] == cuts[1] and len(cuts[0]) > 10


@pytest.mark.parametrize("passage", [b"the " * 51, b". " * 51, b"0 1 2 3 4 " * 11, b"once upon a " * 17, b"a bb ccc dddd eeeee ffffff " * 9])
@pytest.mark.parametrize("skip", [0, 4])
def test_repeats_of_one_word_are_found_in_any_context(passage, skip):
    rng = np.random.default_rng(11)
    runs = []
    for k in range(2):
        lead, tail = (b" ".join(rng.integers(97, 123, 240, dtype=np.uint8).reshape(-1, 4).view("S4").ravel()) + b" " for _ in range(2))
        words = spelled(lead + passage[skip * k :] + tail)
        ends = substring_dedup.boundaries(words)
        runs.append((np.diff(ends, prepend=0).tolist(), substring_dedup.digests(words, ends).tolist()))
    assert set(runs[0][1]) & set(runs[1][1])


def test_digest_depends_on_content_only():
    words = spelled(b"a b c a b c " * 2000)
    h = substring_dedup.digests(words, np.array([3, 6, 9, 10, 12000]))
    assert h[0] == h[1] == h[2] != h[3]


@pytest.mark.parametrize("letters", [(1, 1), (1, 2), (1, 3), (2, 3), (2, 4), (3, 5), (1, 12), (12, 12)])
def test_a_passage_of_51_words_of_any_length_holds_a_shared_chunk(letters):
    """At most one of 400 planted passages may be without; single letters repeat, which only adds boundaries."""
    rng = np.random.default_rng(3)
    word = lambda: bytes(rng.integers(97, 123, rng.integers(letters[0], letters[1] + 1), dtype=np.uint8))
    text = lambda n: b" ".join(word() for _ in range(n))
    missed = 0
    for _ in range(400):
        passage, found = text(51), []
        for _ in range(2):
            lead = text(30)
            words = spelled(b" ".join([lead, passage, text(30)]))
            ends = substring_dedup.boundaries(words)
            inside = (np.concatenate([[0], ends[:-1]]) >= 30) & (ends <= 81)
            found.append(set(substring_dedup.digests(words, ends)[inside].tolist()))
        missed += not found[0] & found[1]
    assert missed <= 1


@settings(max_examples=60, deadline=None)
@given(st.text("ab \t\né\x1c", max_size=60), st.integers(1, 4))
def test_sequences_are_told_apart_by_their_words(text, length):
    raw = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    begin, end, s = substring_dedup.sequences(np.frombuffer(raw, dtype=np.uint8), length) if raw else ([], [], [])
    want = [tuple(words[i : i + length]) for i in range(len(words) - length + 1)]
    assert [tuple(re.findall(rb"[^\x20\x09-\x0D]+", raw[b:e])) for b, e in zip(begin, end, strict=True)] == want
    assert len(set(s)) == len(set(want)) and len(set(zip(s, want, strict=True))) == len(set(want))


def brute_passages(rows, length=51):
    """Which documents hold which sequences of words that others hold as well."""
    held = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - length + 1):
            held.setdefault(tuple(w[k : k + length]), set()).add(i)
    return {i for ids in held.values() if len(ids - {None}) > 1 for i in ids - {None}}


def test_repeated_passages_are_found(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, half, other = text(60), text(40), text(51)
    rows = [(1, f"{text(80)} {passage} {text(40)}"), (2, f"{text(33)} {passage}"), (3, text(150)), (4, None), (5, ""), (None, passage), (6, passage + " " + passage)]
    # A long one in very many documents, two half ones side by side, one of exactly 51 words, one word over and over.
    rows += [(i, f"{text(5)} {half} {text(5)}") for i in range(100, 400)] + [(7, f"{text(60)} {half}"), (8, f"{text(30)} {half} {other} {text(9)}"), (9, other)]
    rows += [(10, f"{text(9)} {'the ' * 70}{text(9)}"), (11, f"{text(9)} {'the ' * 30}{text(9)}"), (12, "x" * 200_000 + f" {other}"), (2, text(150))]
    out = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == brute_passages(rows) == {1, 2, 6, 8, 9, 12}
    texts = {i: (t or "").encode() for i, t in rows[:-1]}
    for i in (2, 6):
        assert all(r["dropped"] and r["first_doc_id"] == 1 for r in by[i])
    assert not any(r["dropped"] for r in by[1] + by[8]) and passage.encode() in texts[1][by[1][0]["begin_byte"] : by[1][0]["end_byte"]]
    cut = {}
    for r in substring_dedup.drop_passages(frame(spark, rows)).collect():
        cut.setdefault(r["doc_id"], []).append(r["text"])
    assert cut[1] == [rows[0][1]] and cut[3] == [rows[2][1]] and cut[4] == [None] and cut[None] == [passage]
    # Of two rows with one id, only the one with the passage is cut.
    assert sorted(map(len, cut[2])) == sorted([len(rows[1][1]) - len(passage), len(rows[-1][1])])
    assert substring_dedup.repeated_passages(frame(spark, rows).limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(0, 60), st.integers(0, 60), st.integers(51, 90), st.sampled_from([2, 5, 30, 5000]))
def test_sequences_that_others_hold_are_never_passed_over(seed, lead, tail, size, vocabulary):
    rng = np.random.default_rng(seed)
    text = lambda n: b"".join(b"%d " % k for k in rng.integers(0, vocabulary, n))
    passage, places, digests = text(size), [], []
    for before in (lead, tail):
        words = spelled(text(before) + passage + text(lead + tail))
        ends = substring_dedup.boundaries(words)
        places.append((before, words, np.concatenate([[0], ends[:-1]])))
        digests.append(substring_dedup.digests(words, ends))
    shared = np.intersect1d(*digests)
    for (before, words, starts), h in zip(places, digests, strict=True):
        hits = starts[np.isin(h, shared)]
        got = set(substring_dedup.possible(words, 51, hits, hits).tolist())
        ends = np.append(starts[1:], len(words))
        for p in range(before, before + size - 50):  # every sequence of the passage that holds a hit whole
            if any(b >= p and e <= p + 51 for b, e in zip(starts, ends, strict=True) if b in hits):
                assert p in got


def test_passages_of_short_long_and_mixed_words(spark):
    """Words of 1 to 12 letters, digits and several scripts; clean documents with the same vocabularies beside them."""
    rng = np.random.default_rng(13)
    kinds = [("abcdefghijklmnopqrstuvwxyz", 1, 2), ("abcdefghijklmnopqrstuvwxyz", 1, 3), ("abcdefghij", 2, 3), ("abcdefghijklmnop", 2, 4), ("abcdefg", 1, 12)]
    kinds += [("0123456789", 1, 4), ("абвгдежзик", 1, 5), ("日本語中文字", 1, 3), ("añé1жd日", 1, 6), ("ab", 1, 1), ("x", 1, 1)]
    rows = []
    for letters, least, most in kinds:
        word = lambda: "".join(rng.choice(list(letters), rng.integers(least, most + 1)))  # noqa: B023, E731
        text = lambda n: " ".join(word() for _ in range(n))  # noqa: B023, E731
        for length in (50, 51, 51, 52, 70, 140):
            passage = text(length)
            rows += [(len(rows) + k, f"{text(int(rng.integers(0, 90)))} {passage}\n{text(int(rng.integers(0, 90)))}") for k in range(2)]
        rows += [(len(rows) + k, text(120)) for k in range(6)]
    found = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    assert {r["doc_id"] for r in found} == brute_passages(rows)
    texts = dict(rows)
    for r in found:  # every passage reported is one: all of its words lie in sequences that another document holds
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", texts[r["doc_id"]].encode()[r["begin_byte"] : r["end_byte"]]))
        assert words >= 51


def test_chunks_of_one_document_in_another_order_are_no_passage(spark):
    rng = np.random.default_rng(17)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    parts = [" ".join(word() for _ in range(40)) for _ in range(12)]
    rows = [(1, " ".join(parts)), (2, " ".join(parts[::-1])), (3, " ".join(parts[::2] + parts[1::2]))]
    assert brute_passages(rows) == set()
    assert substring_dedup.repeated_passages(frame(spark, rows)).count() == 0


def test_cuts_keep_characters_whole(spark):
    passage = " ".join(f"ñandú日本{i}" for i in range(80))
    rows = [(1, passage), (2, f"aé{passage}éa"), (3, f"日{passage}語")]
    for r in substring_dedup.drop_passages(frame(spark, rows)).collect():
        assert "\ufffd" not in r["text"] and (r["doc_id"] == 1 or len(r["text"]) < 120)


def test_long_repeats_of_documents_and_nothing_else(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r["doc_id"] for r in queries.op1_substring_dedup(spark, sf).collect()} == brute_passages(rows)
