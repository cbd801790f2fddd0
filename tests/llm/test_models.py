"""Toxicity, decontamination, chat, language model, language ID, mixing and the pipeline."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import chat, common, decontam, eliasfano, exact_dedup, langid, mixing, ngram_lm, queries, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, held_out string, p string, host string"


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1], *(r[2:] or ("en", "s")), 0, 1, "x", "y", "z") for r in rows], DOCS)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


# Elias-Fano and the language model


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=200), st.lists(st.integers(0, 2**40), max_size=20))
def test_elias_fano_round_trip(values, others):
    v = np.array(sorted(values), dtype=np.uint64)
    ef = eliasfano.EliasFano(eliasfano.encode(v, 2**40))
    assert (ef.access(np.arange(len(v))) == v).all()
    asked = np.array([*values, *others], dtype=np.uint64)
    for x, k in zip(asked.tolist(), ef.find(asked).tolist(), strict=True):
        assert (k >= 0) == (x in values) and (k < 0 or v[k] == x)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aAbB \t\n\x0b\x1c\x85é", max_size=40), min_size=1, max_size=6))
def test_tokens_are_the_words(texts):
    got = ngram_lm.Tokens([t.encode() for t in texts])
    want = [w for t in texts for w in [*words(t), b""]]
    assert len(got.at) == len(want) and got.counts.tolist() == [len(words(t)) + 1 for t in texts]
    same = defaultdict(set)
    for w, k in zip(want, got.at.tolist(), strict=True):
        same[w].add(k)
    assert all(len(k) == 1 for k in same.values()) and len({min(k) for k in same.values()}) == len(same)


def test_very_long_words_differ():
    a, b = b"x" * 1000 + b"ab", b"x" * 1000 + b"ba"
    _, found = ngram_lm.word_hashes(np.frombuffer(a + b" " + b + b" " + a + b" ", dtype=np.uint8))
    assert found[0] == found[2] != found[1]


def brute_lm(rows, order=3, discount=ngram_lm.DISCOUNT):
    tokens = [[*words(t), b""] for _, t in rows]
    train = [t for (i, _), t in zip(rows, tokens, strict=True) if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    counts = [Counter(x for t in train for x in zip(*(t[k:] for k in range(n)), strict=False)) for n in range(1, order + 1)]
    total, size = sum(counts[0].values()), len(counts[0])
    for n in range(1, order):
        counts[n] = dict(counts[n])
    below = [defaultdict(lambda: [0, 0]) for _ in range(order)]
    for n in range(1, order):
        for g, c in counts[n].items():
            below[n][g[:-1]][0] += c
            below[n][g[:-1]][1] += 1

    def p(context, w):
        n = len(context)
        if not n:
            return (counts[0].get((w,), 0) + 0.5) / (total + 0.5 * (size + 1))
        if context not in below[n]:
            return p(context[1:], w)
        held, kinds = below[n][context]
        whole = counts[n - 1][context]
        return max(counts[n].get((*context, w), discount) - discount, 0) / whole + (whole - held + discount * kinds) / whole * p(context[1:], w)

    out = []
    for t in tokens:
        base = sum(math.log10(p((), w)) for w in t)
        score = sum(math.log10(p(tuple(t[max(0, k - order + 1) : k]), w)) for k, w in enumerate(t))
        out.append((len(t), sum((w,) in counts[0] for w in t), total, base, score))
    return out


def test_language_model_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD", 40)  # contexts fall across shards
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "Mat", "a", "dog", f"x{i % 9}"], 40))) for i in range(60)]
    rows += [(100, None), (101, " \t"), (None, "the cat"), (102, "unseen words only")]
    got = ngram_lm.score_corpus(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {i: w for (i, _), w in zip(rows, brute_lm(rows), strict=True)}
    for r in got:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert abs(r["score"] - score) / n < 0.02
    held = [r for r in got if r["held_out"]]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in held)


@pytest.mark.parametrize(("order", "shard"), [(1, 9), (2, 5), (3, 3), (3, 100), (4, 11)])
def test_language_model_whatever_the_parts(spark, monkeypatch, order, shard):
    """Entries and contexts that lie across parts, common and rare ones, against brute force token by token."""
    monkeypatch.setattr(ngram_lm, "SHARD", shard)
    rng = np.random.default_rng(order)
    rows = [(i, " ".join(rng.choice(["a", "a", "a", "b", "b", "c", f"r{i % 4}"], int(rng.integers(1, 12))))) for i in range(40)] + [(i, "a b a b a") for i in range(40, 60)]
    got = {r["doc_id"]: r for r in ngram_lm.score_corpus(frame(spark, rows), order).collect()}
    for (i, _), (n, known, total, base, score) in zip(rows, brute_lm(rows, order), strict=True):
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (n, known, total)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9) and abs(got[i]["score"] - score) / n < 0.015


def test_keys_order_rows_even_where_numbers_are_large():
    rng = np.random.default_rng(13)
    columns = [rng.integers(0, 9, 300) * big for big in (1, 10**9, 10**12)]
    at, back = ngram_lm._grouped(columns, [9, 9 * 10**9, 9 * 10**12])
    rows = list(zip(*columns, strict=True))
    assert [rows[i] for i in at] == sorted(set(rows)) and [sorted(set(rows))[k] for k in back] == rows


def test_packed_columns_come_back():
    rng = np.random.default_rng(14)
    columns = [np.sort(rng.integers(0, 2**40, 500)), rng.integers(0, 70_000, 500), rng.integers(0, 3, 500)]
    assert all((a == b).all() for a, b in zip(ngram_lm._unpacked(ngram_lm._packed(columns)), columns, strict=True))


def test_language_model_keeps_ngrams_seen_once(spark):
    learned = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5 != 1]
    asked = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(learned[0], "one two three four"), (learned[1], "two one four three"), (asked, "one two three")]
    trie = ngram_lm.train(frame(spark, rows))
    assert [sum(map(len, trie.shards(n))) for n in (1, 2, 3)] == [level.size for level in trie.levels] == [5, 8, 6]
    got = {r["doc_id"]: r["score"] for r in ngram_lm.score(frame(spark, rows), trie).collect()}
    for (i, _), (n, *_, want) in zip(rows, brute_lm(rows), strict=True):
        assert abs(got[i] - want) / n < 0.02


def test_language_model_probabilities_sum_to_one(spark):
    rows = [(i, "a b a c a b c b a d") for i in range(1, 6)]
    trie = ngram_lm.train(frame(spark, rows))
    vocabulary = [b"a", b"b", b"c", b"d", b"", b"unknown"]
    for context in (b"", b"a ", b"a b ", b"b a ", b"zz "):
        total = 0.0
        for w in vocabulary:
            tokens = ngram_lm.Tokens([context + w])
            ids, counts, _ = trie.words(tokens.hashes)
            place = len(words(context.decode())) + (0 if w == b"" else 0)
            logs = trie.scores(ids[tokens.at], counts[tokens.at], tokens.starts)
            total += 10 ** logs[place]
        assert total == pytest.approx(1, abs=0.03)


def test_language_model_without_rows(spark):
    assert ngram_lm.score_corpus(frame(spark, [(1, "x")]).limit(0)).count() == 0
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = ngram_lm.score_corpus(frame(spark, [(only, "never seen")])).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["n_tokens"] == 3


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(4)
    calm = [f"word{i}" for i in range(400)]
    rude = ["idiot", "scum", "moron"]
    rows, marks = [], []
    for i in range(900):
        bad = i % 3 == 0
        lang = ("en", "de")[i % 2]
        text = list(rng.choice(calm, int(rng.integers(5, 120))))
        for _ in range(3 if bad else 0):
            text.insert(int(rng.integers(0, len(text))), str(rng.choice(rude)) if lang == "en" else f"lowei{rng.integers(1000)}")
        rows.append((i, " ".join(text), lang, "s"))
        marks.append((i, 0, int(bad)))
    rows += [(5000, None, None, None), (5001, "", "en", "s"), (5002, "idiot " * 30_000, "en", "s")]
    labels = spark.createDataFrame([*marks, (7000, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(frame(spark, rows), labels).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    unseen = [r for i, r in got.items() if i < 900 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in unseen]) > 0.95
    assert got[5002]["predicted"] == 1 and got[5000]["predicted"] == 0
    kept = toxicity.drop_toxic(frame(spark, rows), labels)
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and kept.filter("doc_id = 5002").count() == 0


def test_scores_match_a_plain_forward_pass(spark):
    """Word by word, filter by filter, without the projection of distinct words."""
    rng = np.random.default_rng(16)
    texts = [" ".join(rng.choice(["idiot", "kind", "word", "Über", "a", "b"], int(rng.integers(0, 12)))).encode() for _ in range(80)]
    model = toxicity.Classifier().fit(texts, np.array([float(b"idiot" in t) for t in texts], dtype=np.float32))
    for text, score in zip(texts, model.scores(texts), strict=True):
        found = words(text.decode())
        vectors = [model.embed[toxicity.word_buckets([w])[0]].sum(axis=0) for w in found] + [np.zeros(toxicity.DIM, np.float32)] * (max(toxicity.WIDTHS) - 1)
        best = []
        for kernel in model.kernels:
            replies = [sum(vectors[i + k] @ kernel[k] for k in range(len(kernel))) for i in range(len(found))]
            best.append(np.max(replies, axis=0) if replies else np.full(toxicity.FILTERS, -np.inf))
        pooled = np.maximum(np.concatenate(best) + model.bias, 0)
        assert score == pytest.approx(1 / (1 + math.exp(-float(pooled @ model.out + model.shift))), abs=1e-4)
    import pickle

    assert (pickle.loads(pickle.dumps(model)).scores(texts) == model.scores(texts)).all()


def test_toxicity_of_odd_rows(spark):
    """Null, shared and repeated ids: one row each, by its own text."""
    rows = [(None, "calm"), (7, "calm"), (7, "idiot"), (7, "idiot"), (8, None)]
    got = toxicity.toxicity(frame(spark, rows), spark.createDataFrame([(7, 0, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 7, 7, 7, 8]
    assert not next(r for r in got if r["doc_id"] is None)["held_out"]


def test_toxicity_without_both_classes(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, labels).collect()} == {0.1}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


# Decontamination


def test_wand_finds_all_above_threshold():
    rng = np.random.default_rng(6)
    vocab = [f"t{i}" for i in range(120)]
    items = [(i, " ".join(rng.choice(vocab, int(rng.integers(3, 30)))).encode()) for i in range(150)]
    index = decontam.ItemIndex(items)
    for _ in range(60):
        query = {w.encode() for w in rng.choice(vocab, int(rng.integers(1, 60)))}
        want = {}
        for t in query:
            for item, share in index.postings(t):
                want[item] = want.get(item, 0) + share
        got = dict(index.search(query, 0.5))
        assert got.keys() == {i for i, s in want.items() if s >= 0.5 - 1e-9}
        assert all(got[i] == pytest.approx(want[i]) for i in got)


@pytest.mark.parametrize("size", [decontam.INDEX_BYTES, 600])
def test_leaks_match_brute_force(spark, sf, size):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench, size).collect()}
    want = set()
    items = [(r["item_id"], [b" ".join(words(r["text"])[k : k + 5]) for k in range(len(words(r["text"])) - 4)]) for r in bench.collect()]
    for r in docs.collect():
        w = words(r["text"])
        held = {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)}
        want |= {(r["doc_id"], i) for i, s in items if s and sum(x in held for x in s) >= 0.8 * len(s)}
    assert want and got == want


def test_leaks_of_odd_rows(spark):
    item = "which river flows through the old stone town of ambleford and who built its first bridge"
    bench = spark.createDataFrame([(1, item), (2, None), (3, " "), (4, "tiny one"), (5, item)], "item_id long, text string")
    other = " ".join(f"filler{i}" for i in range(500))
    docs = frame(spark, [(1, f"{other} {item.upper()} {other}"), (2, other), (3, None), (4, ""), (5, item), (5, item), (6, " ".join(item.split()[:9])), (7, f"the {other} tiny one")])
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect())
    assert got == [(1, 1), (1, 5), (5, 1), (5, 1), (5, 5), (5, 5), (7, 4)]
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()) == [2, 3, 4, 6]


def test_leaks_in_very_long_and_nameless_rows(spark):
    item = "which river flows through the old stone town of ambleford and who built its first bridge"
    bench = spark.createDataFrame([(1, item)] * 2 + [(None, "one two three four five six")], "item_id long, text string").withColumn("bm25", F.lit("x"))
    filler = " ".join(f"filler{i % 977}" for i in range(60_000))
    rows = [(None, f"{filler} {item} {filler}"), (None, filler), (4, "x" * 300_000), (4, f"{item} {item}"), (5, "zero one two three four five six seven")]
    got = Counter((r["doc_id"], r["item_id"], r["first_word"]) for r in decontam.leaks(frame(spark, rows), bench).collect())
    # The first of equally good passages; both of two equal items; an item without an id is an item.
    assert {k[:2]: n for k, n in got.items()} == {(None, 1): 2, (4, 1): 2, (5, None): 1}
    assert all(first == 0 if i else 60_000 - 32 < first <= 60_000 for i, _, first in got)


def test_leaks_with_a_glued_last_word(spark):
    item = "which river flows through the old stone town of ambleford and who built its first bridge"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = frame(spark, [(1, f"so {item}?! they asked"), (2, item.replace("ambleford and", "somewhere but")), (3, " ".join(item.split()[:10]))])
    got = decontam.leaks(docs, bench).collect()
    assert [(r["doc_id"], r["question_overlap"]) for r in got] == [(1, 1.0)] and got[0]["answer_overlap"] < 0.8


# Chat


TEXT = st.lists(st.sampled_from(["[INST]", "[/INST]", "</s>", "\\", "[", "é", "日本", " ", "\n", "a", "<", "/", "🙂"]), max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "</s>"]), TEXT), max_size=6))
def test_rendering_is_reversible(turns):
    text, spans = chat.render(turns)
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]


def test_masks_hold_assistant_texts_once(spark):
    rng = np.random.default_rng(8)
    parts = ["[INST]", "</s>", " ", "\n\n", "word", "ä", "🙂", "\\", "日", "  x", "[/INST]"]
    rows = []
    for c in range(60):
        for t in range(int(rng.integers(1, 6))):
            rows.append((c, t, ["user", "assistant", "system"][int(rng.integers(3))], "".join(rng.choice(parts, int(rng.integers(0, 9))))))
    rows += [(100, 0, "user", None), (100, 1, "assistant", None), (101, 0, None, "hi"), (101, None, "assistant", "first"), (None, 0, "assistant", "x" * 50_000), (102, 1, "user", "b"), (102, 1, "user", "a")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(table)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(table.limit(0))).count() == 0


def test_conversations_of_the_driver(spark, sf):
    got = {r["conv_id"]: r for r in queries.op7_chat_formatting(spark, sf).collect()}
    assert got[-7]["n_turns"] == 2 and got[-7]["loss_chars"] == len(queries.PROBE)
    n = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    assert len(got) == n + 1


# Language ID


def test_languages_of_documents_and_pages(spark, sf):
    docs, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages"))
    out = queries.op10_language_id(spark, sf)
    assert out.count() == docs.count() + pages.count()
    joined = out.filter("kind = 'document'").join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id")
    right = joined.agg(F.avg((F.col("lang") == F.col("true")).cast("int"))).first()[0]
    assert right > 0.98
    said = out.filter("kind = 'page' and declared is not null").agg(F.avg((F.col("lang") == F.col("declared")).cast("int"))).first()[0]
    assert said > 0.95


def test_evidence_beyond_text(spark):
    rows = [(i, f"h{i % 3}.site.de", "de", [0.1, 0.9]) for i in range(30)] + [(i, "other.fr", "fr", [0.9, 0.1]) for i in range(30, 60)]
    rows += [(100, "h0.site.de", None, [0.5, 0.5]), (101, None, "fr", [0.5, 0.5]), (102, None, None, [0.2, 0.8]), (103, "new.example.fr", None, [0.5, 0.5])]
    judged = spark.createDataFrame(rows, "id long, host string, declared string, p array<double>")
    got = {r["id"]: r for r in langid.posterior(judged, ["fr", "de"]).collect()}
    assert len(got) == len(rows)
    assert (got[100]["lang"], got[101]["lang"], got[102]["lang"], got[103]["lang"]) == ("de", "fr", "de", "fr")
    assert got[102]["text_lang"] == "de" and 0.5 < got[100]["confidence"] <= 1


def test_language_id_of_odd_rows(spark):
    docs = frame(spark, [(1, "the cat and the dog", "en", "a"), (2, "der hund und die katze", "de", "b"), (3, None, None, None), (4, "", "en", "a")])
    pages = spark.createDataFrame(
        [(1, "https://u:p@Sub.Example.DE:80/x", "<html lang='de-AT'><script>the the</script><p>der hund &amp; die katze"), (2, None, None), (3, "no address", "")],
        "page_id long, url string, html string",
    )
    got = langid.identify(docs, pages).collect()
    assert len(got) == 7
    page = next(r for r in got if r["page_id"] == 1)
    assert (page["host"], page["declared"], page["lang"]) == ("sub.example.de", "de", "de")
    assert langid.identify(docs.limit(0), pages).filter("lang is not null").count() == 0
    assert langid.visible("<style>x</style>a<!-- b -->&lt;c<b>d</b>").split() == [b"a", b"<c", b"d"]


def test_fused_posterior_matches_brute_force(spark):
    """Every factor worked out by hand for a few rows: text, declaration, suffix, host within domain within corpus."""
    rng = np.random.default_rng(15)
    hosts = ["a.site.de", "b.site.de", "x.co.uk", "y.co.uk", "solo", None, "new.fr"]
    rows = []
    for i in range(80):
        p = float(rng.uniform(0.02, 0.98))
        rows.append((i, hosts[int(rng.integers(len(hosts)))], [None, "de", "fr"][int(rng.integers(3))], [p, 1 - p]))
    got = {r["id"]: r for r in langid.posterior(spark.createDataFrame(rows, "id long, host string, declared string, p array<double>"), ["de", "fr"]).collect()}

    def domain(h):
        parts = h.split(".")
        return h if len(parts) == 1 else ".".join(parts[-3 if len(parts) >= 3 and len(parts[-1]) == 2 and parts[-2] in langid.SECOND_LABELS else -2 :])

    suffix = lambda h: h.rsplit(".", 1)[1] if "." in h else ""
    total = np.array([1.0 + sum(r[3][k] for r in rows) for k in (0, 1)])
    corpus = total / total.sum()
    for i, host, said, p in rows:
        host = host or ""
        alike = lambda same: np.sum([r[3] for r in rows if r[0] != i and same(r[1] or "", r[2])] or [[0, 0]], axis=0)
        smooth = lambda n, below: (n + langid.KAPPA * below) / (n.sum() + langid.KAPPA)
        prior = smooth(alike(lambda h, s: h == host), smooth(alike(lambda h, s: domain(h) == domain(host)), corpus)) if host else corpus
        odds = np.array(p) * prior
        if said:
            odds = odds * smooth(alike(lambda h, s: s == said), corpus) / corpus
        if suffix(host):
            odds = odds * smooth(alike(lambda h, s: suffix(h) == suffix(host)), corpus) / corpus
        odds = odds / odds.sum()
        assert got[i]["lang"] == ("de", "fr")[int(odds.argmax())] and got[i]["confidence"] == pytest.approx(odds.max(), rel=1e-6)


def test_language_sample_has_rare_languages(spark):
    rows = [(i, f"the cat and the dog number {i}", "en", "a") for i in range(300)] + [(1000 + i, f"der hund und die katze gehen nach hause {i}", "de", "b") for i in range(4)] + [(1100, None, "xx", "a")]
    rows += [(7, "again and again", "en", "a")] * 50
    docs = frame(spark, rows)
    got = Counter(r["lang"] for r in langid.training_rows(docs, 20).collect())
    assert got == {"en": 20, "de": 4}
    assert langid.train(docs, 20).languages == ["de", "en"]
    small = [r for r in langid.training_rows(docs, 200, 500).collect() if r["lang"] == "en"]
    assert sum(len(r["text"]) for r in small) <= 500
    out = {r["doc_id"]: r["lang"] for r in langid.identify(docs, spark.createDataFrame([], "page_id long, url string, html string")).collect()}
    assert out[1000] == "de" and out[5] == "en" and len(out) == len({r[0] for r in rows})


def test_rows_without_a_host_share_nothing(spark):
    """English documents without a source say nothing of a page without an address; a source is no address."""
    docs = frame(spark, [(i, "the cat and the dog", "en", None) for i in range(12)] + [(i, "der hund und die katze", "de", "de.site") for i in range(12, 18)])
    pages = spark.createDataFrame(
        [(1, None, ""), (2, "http://x.site/", ""), (3, None, "<!-- <html lang=en> --><script>'<html lang=fr>'</script><html lang=de>")], "page_id long, url string, html string"
    )
    got = {r["page_id"]: r for r in langid.identify(docs, pages).filter("kind = 'page'").collect()}
    # Two thirds of the corpus are English: an empty page without address has that share and no more.
    assert got[1]["lang"] == "en" and 0.55 < got[1]["confidence"] < 0.7
    assert abs(got[2]["confidence"] - got[1]["confidence"]) < 0.05 and got[3]["declared"] == "de"


def test_languages_are_a_bound_that_can_be_lifted(spark):
    rows = [(i, f"{name} " * 30, name, "s") for i, name in enumerate(["aa", "aa", "bb", "bb", "cc", "dd"])]
    assert langid.train(frame(spark, rows), languages=2).languages == ["aa", "bb"]
    assert langid.train(frame(spark, rows), languages=None).languages == ["aa", "bb", "cc", "dd"]


def test_many_languages_are_fused_in_time(spark):
    rng = np.random.default_rng(3)
    names = [f"l{k:03d}" for k in range(100)]
    p = rng.dirichlet(np.ones(100) * 0.05, 200)
    rows = [(i, f"h{i % 7}.org", None, [float(x) for x in p[i]]) for i in range(200)]
    began = time.time()
    out = langid.posterior(spark.createDataFrame(rows, "id long, host string, declared string, p array<double>"), names).collect()
    assert len(out) == 200 and time.time() - began < 30


def test_language_of_a_very_long_page(spark):
    docs = frame(spark, [(1, "the cat and the dog", "en", "a"), (2, "der hund und die katze", "de", "b")])
    page = "<p>der hund</p>" * 40_000 + "<script>" + "the " * 40_000 + "</script>"
    pages = spark.createDataFrame([(1, None, page), (1, None, page), (None, None, "the cat")], "page_id long, url string, html string").withColumn("p", F.lit(1)).withColumn("said", F.lit("x"))
    got = langid.identify(docs, pages).filter("kind = 'page'").collect()
    assert sorted((r["page_id"] or 0, r["lang"]) for r in got) == [(0, "en"), (1, "de"), (1, "de")]


def test_language_declared_late_in_a_page(spark):
    docs = frame(spark, [(1, "the cat and the dog", "en", "a"), (2, "der hund und die katze", "de", "b")])
    pages = spark.createDataFrame([(1, None, f"<!-- {'licence ' * 3000} -->\n<html class=x lang=de>")], "page_id long, url string, html string")
    assert [r["declared"] for r in langid.identify(docs, pages).filter("kind = 'page'").collect()] == ["de"]


# Mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        left, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= set(over)
    return target


@pytest.mark.parametrize("shard", [mixing.SHARD, 300])
def test_mix_meets_targets(spark, shard):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 200))), "en", [None, "a", "b", "ä", "B", "c", "tiny"][i % 7] if i % 5 else "a") for i in range(400)]
    rows += [(1000, None, "en", "a"), (1001, "x", "en", "only"), (1002, "y\x1cz \t w", "en", "b"), (5, "again", "en", "b")]
    got = mixing.mix(frame(spark, rows), shard=shard).collect()
    again = mixing.mix(frame(spark, rows).repartition(7), shard=shard).collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = brute_targets(sizes)
    shards = {s: max(1, -(-n // shard)) for s, n in sizes.items()}
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK * shards[s]
    assert {r["size"] for r in got if r["doc_id"] == 1002} == {2}


def test_taken_matches_brute_force(spark):
    """Quotas by ranked quotients, then each shard's circular run of blocks, word by word."""
    rng = np.random.default_rng(17)
    rows = [(i % 90 if i % 11 else None, " ".join(["w"] * int(rng.integers(0, 40))), "en", ["a", "b", None][i % 3]) for i in range(150)] + [(500, "z " * 9_000, "en", "b"), (501, "", "en", "empty"), (502, None, "en", "empty")]
    block, shard = 8, 400
    docs = frame(spark, rows)
    keys = docs.select(
        "doc_id", "source", mixing.word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(mixing.SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).alias("draw"),
        F.xxhash64(F.xxhash64(F.lit(mixing.SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))).alias("deal"),
    ).collect()
    sizes = defaultdict(int)
    for r in keys:
        sizes[r["source"]] += r["size"]
    target = brute_targets(sizes)

    def quotas(votes, most, seats, name):
        ranked = sorted((-v / (2 * k + 1), name[p], k, p) for p, v in votes.items() if v for k in range(most[p]))[:seats]
        return Counter(p for *_, p in ranked)

    half = lambda x: math.floor(x + 0.5)
    hashed = spark.createDataFrame([(s,) for s in sizes], "source string").select("source", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("h")).collect()
    given_ = quotas(target, {s: max(sizes[s] * 2 // block, half(target[s] / block)) for s in sizes}, half(sum(target.values()) / block), {r["source"]: r["h"] for r in hashed})
    shards = {s: max(1, -(-sizes[s] // shard)) for s in sizes}
    lanes = defaultdict(list)
    for r in keys:
        lanes[r["source"], r["deal"] % shards[r["source"]]].append(r)
    names = spark.createDataFrame(list(lanes), "source string, shard long").select(
        "source", "shard", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), "shard").alias("h"), F.xxhash64(F.lit(mixing.SEED + 1), "source", "shard").alias("start")
    ).collect()
    want = Counter()
    for s in sizes:
        own = {k: sum(r["size"] for r in lane) for k, lane in lanes.items() if k[0] == s}
        won = quotas(own, {k: -(-n * 2 // block) for k, n in own.items()}, given_[s], {(r["source"], r["shard"]): r["h"] for r in names})
        for k, n in own.items():
            lane = sorted(lanes[k], key=lambda r: (r["draw"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"]))
            seed = next(r["start"] for r in names if (r["source"], r["shard"]) == k)
            at, owner = seed % max(n // block, 1) * block, [j for j, r in enumerate(lane) for _ in range(r["size"])]
            taken = Counter(owner[(at + w) % n] for w in range(min(won[k] * block, n * 2)))
            for j, r in enumerate(lane):
                want[r["doc_id"], r["size"], r["source"], taken[j]] += 1
    got = mixing.mix(docs, block=block, shard=shard).collect()
    assert Counter((r["doc_id"], r["size"], r["source"], r["taken"]) for r in got) == want


def test_mix_spreads_rows_without_an_id(spark):
    """Rows that share an id, or a source of empty texts, are dealt over shards like all others."""
    rows = [(None, f"w{i} word", "en", "a") for i in range(300)] + [(1, "", "en", "b")] * 3
    got = mixing.mix(frame(spark, rows), shard=100, rows=50).collect()
    assert len(got) == 303 and abs(sum(r["taken"] for r in got) - 900) <= mixing.BLOCK and all(r["taken"] == 0 for r in got if r["doc_id"] == 1)


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [(1, "x")]).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, None), (2, " ")])).collect()] == [0, 0]


def test_highest_quotients(spark):
    rng = np.random.default_rng(10)
    for seats in (0, 1, 7, 100):
        votes = [float(v) for v in rng.integers(0, 1000, 9)]
        table = spark.createDataFrame([(1, i, v, 1000, seats) for i, v in enumerate(votes)], "g int, party long, v double, most long, n long")
        got = {r["party"]: r["quota"] for r in mixing.sainte_lague(table, ["g"], "v", "most", "n").collect()}
        ranked = sorted(((-v / (2 * k + 1), i, k) for i, v in enumerate(votes) for k in range(seats)))[:seats]
        assert got == {i: sum(x[1] == i for x in ranked) for i in range(len(votes))}


# Pipeline


def test_pipeline_applies_each_stage(spark, sf):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("flagged")
    left = {r["doc_id"]: r["text"] for r in docs.join(toxic.select("doc_id"), "doc_id", "left_anti").collect()}
    newest = {t: i for i, t in sorted(left.items())}
    left = {i: t for t, i in newest.items()}
    from tests.llm.test_dedup import brute_fingerprint, components

    fps = {i: brute_fingerprint(t) for i, t in left.items()}
    named = components(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    left = {i: t for i, t in left.items() if named[i] == i}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    items = [[b" ".join(words(r["text"])[k : k + 5]) for k in range(len(words(r["text"])) - 4)] for r in bench]
    for i in list(left):
        w = words(left[i])
        held = {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)}
        if any(s and sum(x in held for x in s) >= 0.8 * len(s) for s in items):
            del left[i]
    out = pipeline.run(spark, sf)
    assert {r["doc_id"] for r in out.collect()} == set(left)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert [name for name, _ in pipeline.STAGES][0] == "toxicity" and len(pipeline.STAGES) == 5


def test_stages_take_odd_rows(spark, sf):
    import corpus_pipeline as pipeline

    rows = [(1, None), (2, ""), (2, ""), (3, "plain words here"), (3, "other words there"), (None, "plain words here"), (4, "a " * 60_000), (5, "x" * 50_000, None, None)]
    odd = frame(spark, rows).withColumn("target", F.lit(1)).withColumn("taken", F.lit(2)).withColumn("component_id", F.lit(3)).withColumn("keep_id", F.lit(4))
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
            assert out.count() <= n, name
    kept = pipeline.STAGES[1][1](spark, odd, sf).select("doc_id", "text").collect()
    assert sorted((r["doc_id"], r["text"][:5]) for r in kept) == [(2, ""), (3, "other"), (3, "plain"), (4, "a a a"), (5, "xxxxx")]


def bag(frame):
    return Counter((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect())


@pytest.mark.parametrize("marks", [common.MARKS, 0])
def test_stages_decide_by_row_not_by_id(spark, monkeypatch, marks):
    """Null, shared and repeated ids: every stage that drops rows against the rows it should keep."""
    monkeypatch.setattr(common, "MARKS", marks)  # decisions by broadcast and by shuffle
    rng = np.random.default_rng(12)
    long = lambda seed: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, 300))
    a, b, near = long(1), long(2), long(1) + " tail"
    rows = [(3, a), (5, a), (5, b), (None, a), (None, b), (7, near), (8, None), (8, ""), (9, b), (9, b)]
    docs = frame(spark, rows)
    # Of equal texts the largest id, once.
    assert bag(exact_dedup.drop_exact_duplicates(docs)) == Counter([(5, a), (9, b), (7, near), (8, "")]) or \
        bag(exact_dedup.drop_exact_duplicates(docs)) == Counter([(5, a), (9, b), (7, near), (8, None)])
    # Of linked texts the smallest id, once.
    got = bag(simhash.drop_near_duplicates(docs))
    assert got == Counter([(3, a), (5, b), (8, None)]) or got == Counter([(3, a), (5, b), (8, "")])
    assert bag(simhash.drop_near_duplicates(frame(spark, [(None, a), (None, a), (None, near)]))).total() == 1
    # A leak goes whatever its id, and takes no other row with it.
    item = "which river flows through the old stone town of ambleford and who built its first bridge"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    odd = [(None, item), (7, f"so {item}"), (7, "clean text"), (None, "clean text"), (7, "clean text"), (8, None)]
    for size in (decontam.INDEX_BYTES, 10):
        assert bag(decontam.drop_contaminated(frame(spark, odd), bench, size)) == Counter([(7, "clean text"), (None, "clean text"), (7, "clean text"), (8, None)])
    # Toxic texts go whatever their id.
    calm = [" ".join(rng.choice([f"word{i}" for i in range(300)], 30)) for _ in range(400)]
    known = [(i, t + (" idiot scum" if i % 2 else "")) for i, t in enumerate(calm)]
    marks = spark.createDataFrame([(i, 0, i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    odd = [(None, "word1 idiot scum word2"), (9001, "idiot scum word5"), (9001, "word5 word6"), (None, "word7"), (9001, "word5 word6")]
    kept = bag(toxicity.drop_toxic(frame(spark, known + odd), marks))
    assert {k: n for k, n in kept.items() if k[0] in (None, 9001)} == {(9001, "word5 word6"): 2, (None, "word7"): 1}
    # Shared and null ids mix like any others.
    mixed = mixing.mix(docs, block=1).collect()
    assert len(mixed) == len(rows) and sum(r["taken"] for r in mixed) == round(1.5 * sum(len(words(t)) for _, t in rows))


def test_training_rows_are_bounded(spark):
    rows = [(1, "bad words")] * 50 + [(i, f"text number {i} " * 10) for i in range(2, 200)]
    marks = spark.createDataFrame([(i, 0, int(i < 3)) for i in range(1, 200)], "doc_id long, quality int, toxic int")
    got = toxicity.training_rows(frame(spark, rows), marks, 5, 20, 1 << 20).collect()
    assert sum(r["text"] == "bad words" for r in got) == 1 and sum(r["toxic"] == 0 for r in got) == 20
    small = toxicity.training_rows(frame(spark, rows), marks, 5, 20, 2000).collect()
    assert sum(len(r["text"]) for r in small if r["toxic"] == 0) <= 1000 and len(small) < len(got)


def test_item_statistics_cover_all_blocks(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda size: sorted((r["doc_id"], r["item_id"], round(r["bm25"], 6), round(r["own_share"], 6)) for r in decontam.leaks(docs, bench, size).collect())
    assert key(decontam.INDEX_BYTES) == key(2000)


def test_repeated_runs_agree(spark, sf):
    first = {(r["doc_id"], r["taken"]) for r in queries.op4_mixing(spark, sf).collect()}
    assert first == {(r["doc_id"], r["taken"]) for r in queries.op4_mixing(spark, sf).collect()}


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """Words of rows beyond the first draw count, thresholds come from all kept rows, reruns agree."""
    rng = np.random.default_rng(8)
    calm = [f"calm{i}" for i in range(80)]
    rows, marks = [], []
    for i in range(1200):
        bad = i % 3 == 0
        rows.append((i, " ".join([*rng.choice(calm, 8), *([f"rude{i % 5}x"] if bad else [])]), "en", "s"))
        marks.append((i, 0, int(bad)))
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SHARD_BYTES", 20_000)
    models = [toxicity.train(docs, labels, 6, 12) for _ in range(2)]
    few = toxicity.fitted([(r["text"].encode(), r["toxic"], "en") for r in toxicity.training_rows(docs, labels, 6, 12, 1 << 20).collect()])
    live = [int(m.used.sum()) for m in (few, *models)]
    assert live[1] > live[0] and "en" in models[0].thresholds and "en" not in few.thresholds
    texts = [r[1].encode() for r in rows]
    scores = [m.scores(texts) for m in models]
    assert (scores[0] == scores[1]).all() and np.mean((scores[0] >= models[0].thresholds["en"]) == (np.arange(1200) % 3 == 0)) > 0.99


def test_toxicity_shuffles_texts_that_may_be_labelled_only(spark, monkeypatch):
    """Most texts without a label stay where they are read; no labelled one does, however full the filter is."""
    docs = frame(spark, [(i, f"text {i}", "en", "s") for i in range(2000)] + [(None, "none", "en", "s"), (10, "other", None, "s")])
    rows, marked = toxicity.labelled_keys(docs, spark.createDataFrame([(i, 0, i % 2) for i in range(0, 2000, 10)], "doc_id long, quality int, toxic int"))
    want = {(r["doc_id"], r["th"]) for r in marked.collect()}
    for bits, most in ((1 << 25, len(want)), (1 << 10, rows.count() // 2), (64, rows.count())):
        monkeypatch.setattr(toxicity, "FILTER_BITS", bits)
        near = toxicity.narrowed(rows, marked)
        assert near.columns == rows.columns
        got = [(r["doc_id"], r["th"]) for r in near.collect()]
        assert want <= set(got) and len(set(got)) == len(got) <= most
