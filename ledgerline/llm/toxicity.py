"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of three hashed embeddings: of itself and of its first four and
five bytes, so inflected and compound forms share strength. Filters of width one,
two and three run over the words, the best response of each over the whole text is
kept, and a logistic unit scores the result. Since filters are linear in the
embeddings, each distinct word is projected once per slice and texts are scored by
adding looked-up rows.

The classifier learns from every labelled row that is not held out. It starts in one executor task on a bounded draw of them,
``POSITIVES`` and ``NEGATIVES`` rows and ``SAMPLE_BYTES`` of text at most. If that is not all of them, ``PASSES`` rounds over
all rows follow: rows are dealt over shards of some ``SHARD_BYTES`` of text by a seeded hash, each shard goes on from the
common weights, and the changes are averaged, an embedding's over the shards that changed it, in whole numbers, so that
reruns agree. Embeddings that no row used stay zero. A fifth of the rows is kept from the weights; all of
it sets the thresholds by language. Language decides only ``flagged``, never a score.

Edge cases: a null or blank text gets the score of a text without words; rows with
null labels are not learned from, conflicting ones count as the larger label; a null
``doc_id`` has no label and is scored like any other; rows that share an id are scored
each by its own text, and repeated rows count once in training; with no positive or
no negative row the score is the smoothed share of positives; a language without
enough rows takes the default threshold; a very long text is scored whole; equal
scores at a threshold are flagged alike; empty in, empty out; other columns are
ignored, and ``drop_toxic`` passes them on.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import raw_texts, text_key, text_slices, words
from ledgerline.plans.materialise import discard, materialise

#: Bounds of the rows that training starts on, and its seed.
POSITIVES, NEGATIVES, SEED = 1500, 2500, 11
#: Bytes of text of those rows at most.
SAMPLE_BYTES = 32 << 20
#: Rounds over all rows, bytes of text in a shard, about, and steps of an averaged weight in one unit.
PASSES, SHARD_BYTES, STEPS = 2, 8 << 20, 1 << 24
#: Bits of the filter by which texts without a label are left out before texts are shuffled.
FILTER_BITS = 1 << 25
#: Hash buckets, embedding length, filter widths, filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 16, (1, 2, 3), 8
EPOCHS, RATE, BATCH = 12, 0.08, 32
#: Contract threshold, and share of the rows held for calibration.
THRESHOLD, CALIBRATION = 0.3, 0.2
#: Rows of each class that a language needs for a threshold of its own.
ENOUGH = 10


def word_buckets(found: list[bytes]) -> np.ndarray:
    """Bucket numbers, shape (n, 3), of distinct words; bucket 0 is padding."""
    crc, m = zlib.crc32, BUCKETS - 1
    rows = [(crc(w) % m + 1, crc(w[:4], 1) % m + 1, crc(w[:5], 2) % m + 1) for w in found]
    return np.array(rows, dtype=np.int32).reshape(-1, 3)


class Layout:
    """Words of several texts as positions of distinct words, texts parted by padding."""

    def __init__(self, parts: list[np.ndarray], buckets: np.ndarray):
        """``parts`` are the texts' words as rows of ``buckets``."""
        gap = np.full(max(WIDTHS) - 1, -1, dtype=np.int64)
        self.buckets = buckets
        self.at = np.concatenate([x for part in parts for x in (part, gap)] + [gap]) + 1
        self.n = len(self.at) - len(gap)
        sizes = np.array([len(part) + len(gap) for part in parts], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if parts else np.empty(0, np.int64)
        self.pad = self.at[: self.n] == 0

    @classmethod
    def of(cls, texts: list[bytes]) -> Layout:
        return cls(*numbered(texts))

    def picked(self) -> Layout:
        """The same texts over the distinct words they use."""
        used, at = np.unique(self.at, return_inverse=True)
        used = used[1:] - 1  # the first is padding, which every text has
        small = Layout([], self.buckets[used])
        small.at, small.n, small.starts, small.pad = at, self.n, self.starts, self.pad
        return small


def numbered(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's words as numbers of distinct words, and the buckets of those."""
    seen: dict[bytes, int] = {}
    parts = [np.array([seen.setdefault(w, len(seen)) for w in words(raw)], dtype=np.int64) for raw in texts]
    return parts, word_buckets(list(seen))


class Classifier:
    """Hashed embeddings, convolutions, max pooling, a logistic unit."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.embed = (rng.standard_normal((BUCKETS, DIM)) * 1e-3).astype(np.float32)
        self.embed[0] = 0
        self.used = np.zeros(BUCKETS, dtype=bool)
        self.kernels = [(rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = (np.abs(rng.standard_normal(len(self.bias))) * 0.3).astype(np.float32) * np.tile([1, -1], len(self.bias) // 2)
        self.shift = np.float32(-1.0)
        self.thresholds: dict[str, float] = {}

    def __getstate__(self):
        live = np.flatnonzero(self.used)
        return {k: v for k, v in self.__dict__.items() if k not in ("embed", "used")} | {"live": live, "vectors": self.embed[live]}

    def dense(self) -> np.ndarray:
        """All weights but the embeddings, in rows of ``DIM``."""
        flat = np.concatenate([*(k.ravel() for k in self.kernels), self.bias, self.out, [self.shift]])
        return np.append(flat, np.zeros(-len(flat) % DIM)).reshape(-1, DIM)

    def move(self, key: np.ndarray, change: np.ndarray) -> None:
        """Add changes: keys from 0 on are embeddings, -1 - k is row k of the others."""
        own = key >= 0
        self.embed[key[own]] += change[own].astype(np.float32)
        self.used[key[own]] = True
        flat = self.dense()
        flat[-1 - key[~own]] += change[~own]
        flat, at = flat.ravel().astype(np.float32), 0
        for i, k in enumerate(self.kernels):
            self.kernels[i], at = flat[at : at + k.size].reshape(k.shape), at + k.size
        n = len(self.bias)
        self.bias, self.out, self.shift = flat[at : at + n], flat[at + n : at + 2 * n], np.float32(flat[at + 2 * n])

    def __setstate__(self, state):
        live, vectors = state.pop("live"), state.pop("vectors")
        self.__dict__.update(state, embed=np.zeros((BUCKETS, DIM), np.float32), used=np.zeros(BUCKETS, dtype=bool))
        self.embed[live], self.used[live] = vectors, True

    def pooled(self, lay: Layout, where: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """Best response of each filter per text, its position if asked for, and the buckets used."""
        buckets = lay.buckets
        vectors = np.zeros((len(buckets) + 1, DIM), dtype=np.float32)
        vectors[1:] = self.embed[buckets].sum(axis=1)
        best, places = [], []
        for kernel in self.kernels:
            reply = None
            for k in range(kernel.shape[0]):
                part = (vectors @ kernel[k])[lay.at[k : k + lay.n]]
                reply = part if reply is None else reply + part
            reply[lay.pad] = -np.inf
            top = np.maximum.reduceat(reply, lay.starts, axis=0)
            best.append(top)
            if where:
                ends = np.append(lay.starts[1:], lay.n)
                places.append(np.stack([s + reply[s:e].argmax(axis=0) for s, e in zip(lay.starts, ends, strict=True)]))
        pooled = np.maximum(np.hstack(best) + self.bias, 0)
        return pooled, np.hstack(places) if where else None, buckets

    def logits(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0, dtype=np.float32)
        return self.pooled(Layout.of(texts))[0] @ self.out + self.shift

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts).astype(np.float64), -30, 30)))

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> Classifier:
        """Train, going on where an earlier call ended."""
        rng = np.random.default_rng(seed)
        sums, kernel_sums, shift_sum = getattr(self, "state", None) or self._fresh()
        parts, known = numbered(texts)  # once for all epochs
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for start in range(0, len(order), BATCH):
                rows = order[start : start + BATCH]
                lay = Layout([parts[i] for i in rows], known).picked()
                pooled, places, buckets = self.pooled(lay, where=True)
                logit = np.clip(pooled @ self.out + self.shift, -30, 30)
                delta = ((1 / (1 + np.exp(-logit)) - labels[rows]) / len(rows)).astype(np.float32)
                grad_out, grad_shift = pooled.T @ delta, float(delta.sum())
                back = delta[:, None] * self.out * (pooled > 0)
                grad_bias = back.sum(axis=0)
                every, grads = [], []
                first = 0
                for i, kernel in enumerate(self.kernels):
                    b, p = back[:, first : first + FILTERS], places[:, first : first + FILTERS]
                    grad_kernel = np.empty_like(kernel)
                    for k in range(kernel.shape[0]):
                        word = lay.at[p + k]  # (texts, filters); 0 is padding
                        used = np.where(word[..., None] > 0, buckets[np.maximum(word, 1) - 1], 0) if len(buckets) else np.zeros((*word.shape, 3), np.int32)
                        vector = self.embed[used].sum(axis=2)
                        grad_kernel[k] = np.einsum("tf,tfd->df", b, vector)
                        every.append(used.reshape(-1, 3))
                        grads.append((b[..., None] * kernel[k].T[None]).reshape(-1, DIM))
                    kernel_sums[i] += grad_kernel**2
                    self.kernels[i] = kernel - RATE * 0.3 * grad_kernel / np.sqrt(kernel_sums[i])
                    first += FILTERS
                used, grad = np.concatenate(every), np.concatenate(grads)
                self.used[used] = True
                live, back_to = np.unique(used, return_inverse=True)
                total = np.zeros((len(live), DIM), dtype=np.float32)
                back_to = back_to.reshape(used.shape)
                for c in range(3):
                    np.add.at(total, back_to[:, c], grad)
                sums["embed"][live] += (total**2).mean(axis=1)
                self.embed[live] -= RATE * total / np.sqrt(sums["embed"][live])[:, None]
                self.embed[0] = 0
                sums["bias"] += grad_bias**2
                self.bias -= RATE * 0.3 * grad_bias / np.sqrt(sums["bias"])
                sums["out"] += grad_out**2
                self.out -= RATE * 0.3 * grad_out / np.sqrt(sums["out"])
                shift_sum += grad_shift**2
                self.shift = np.float32(self.shift - RATE * 0.3 * grad_shift / np.sqrt(shift_sum))
        self.used[0] = False
        self.embed[~self.used] = 0
        self.state = sums, kernel_sums, shift_sum
        return self

    def _fresh(self) -> tuple[dict, list, float]:
        """Sums of squared gradients before the first step."""
        sums = {"embed": np.full(BUCKETS, 1e-4, np.float32), "bias": np.full_like(self.bias, 1e-4), "out": np.full_like(self.out, 1e-4)}
        return sums, [np.full_like(k, 1e-4) for k in self.kernels], 1e-4


class Constant:
    """What is left when only one class, or none, has labelled rows."""

    def __init__(self, share: float):
        self.share, self.thresholds = share, {}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the best-F1 gap, kept within 0.1 to 0.9."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    i = int(np.argmax(f1))
    low = s[i + 1] if i + 1 < len(s) else 0.0
    return float(np.clip((s[i] + low) / 2, 0.1, 0.9))


def fitted(sample: list[tuple[bytes, int, str]], calibration: float = CALIBRATION) -> Classifier | Constant:
    """A classifier from ``text, label, language`` rows; the first part of them sets the thresholds."""
    texts, y = [r[0] for r in sample], np.array([r[1] for r in sample], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return Constant((float(y.sum()) + 0.5) / (len(y) + 5))
    cut = int(len(y) * calibration)
    model = Classifier().fit(texts[cut:], y[cut:])
    scores, langs = model.scores(texts[:cut]), np.array([r[2] for r in sample[:cut]])
    for lang in sorted(set(langs)):
        own = langs == lang
        if min(y[:cut][own].sum(), (1 - y[:cut][own]).sum()) >= ENOUGH:
            model.thresholds[lang] = best_threshold(scores[own], y[:cut][own])
    return model


def _fitted(calibration: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in batch.to_pylist()]
    rows.sort(key=lambda r: (r["draw"], str(r["doc_id"]), r["text"], r["lang"]))
    model = fitted([(r["text"].encode(), r["toxic"], r["lang"]) for r in rows], calibration)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def labelled_keys(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that are not held out, and ``doc_id, th, size, toxic, draw`` of the labelled ones; rows alike in id and text count once."""
    marks = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = documents.filter(~held_out(F.col("doc_id"))).select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), text_key().alias("th")
    )
    # Only ids, keys and sizes are shuffled.
    found = rows.groupBy("doc_id", "th").agg(F.max(F.octet_length("text")).alias("size"))
    return rows, found.join(marks, "doc_id").withColumn("draw", F.xxhash64(F.lit(SEED), "doc_id", "th"))


def narrowed(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows whose id may be among those of ``marked``: all that are, and of the others those whose hash is taken.

    The filter goes to the rows by broadcast, as up to ``FILTER_BITS`` bits in words of 64, whatever the number of ids.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    word, bit = F.shiftright(spot, 6), (spot % 64).cast("int")
    taken = marked.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    near = rows.withColumns({"_at": word, "_bit": bit}).join(F.broadcast(taken), F.col("_at") == F.col("_word"))
    return near.filter(F.getbit("_bits", F.col("_bit")) == 1).select(*rows.columns)


def _drawn(rows: DataFrame, marked: DataFrame, positives: int, negatives: int, most_bytes: int) -> DataFrame:
    upto = Window.partitionBy("toxic").orderBy("draw", "doc_id", "th")
    drawn = [marked.filter(F.col("toxic") == label).orderBy("draw", "doc_id", "th").limit(most) for label, most in ((1, positives), (0, negatives))]
    chosen = drawn[0].unionByName(drawn[1]).withColumn("upto", F.sum("size").over(upto)).filter(F.col("upto") <= most_bytes // 2)
    picked = rows.join(F.broadcast(chosen.select("doc_id", "th", "toxic", "draw")), ["doc_id", "th"])
    return picked.groupBy("doc_id", "th", "toxic", "draw").agg(F.min("text").alias("text"), F.min("lang").alias("lang")).drop("th")


def training_rows(documents: DataFrame, labels: DataFrame, positives: int, negatives: int, most_bytes: int) -> DataFrame:
    """``doc_id, text, lang, toxic, draw``: the bounded, seeded draw of the labelled rows that training starts on.

    Of each class as many are drawn as its bound says, and of those as many as fit into its half of ``most_bytes``.
    """
    return _drawn(*labelled_keys(documents, labels), positives, negatives, most_bytes)


def train(
    documents: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, most_bytes: int = SAMPLE_BYTES
) -> Classifier | Constant:
    """Fit on all training rows; the driver gets the weights, and a row per language and thousandth of a score."""
    rows, marked = labelled_keys(documents, labels)
    marked = materialise(marked, "labelled-keys")
    number, bad, size, bad_size = marked.agg(
        F.count(F.lit(1)), F.count_if(F.col("toxic") == 1), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("size"))), F.lit(0))
    ).first()
    whole = bad <= positives and number - bad <= negatives and max(bad_size, size - bad_size) <= most_bytes // 2
    kept = F.pmod(F.xxhash64("draw"), F.lit(1000)) < int(CALIBRATION * 1000)
    start = _drawn(rows, marked if whole else marked.filter(~kept), positives, negatives, most_bytes).select("doc_id", "text", "lang", "toxic", "draw")
    share = CALIBRATION if whole else 0.0
    found = start.repartition(1).mapInArrow(lambda it: _fitted(share, it), "model binary").first()
    model = pickle.loads(found["model"]) if found else fitted([])
    if whole or isinstance(model, Constant):
        if not whole:
            model.share = (bad + 0.5) / (number + 5)
    else:
        shards = max(1, -(-size // SHARD_BYTES))
        every = narrowed(rows, marked).join(marked.select("doc_id", "th", "toxic", "draw"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
        every = materialise(every.select(
            F.pmod(F.xxhash64("draw", F.lit(SEED)), F.lit(shards)).cast("int").alias("shard"), kept.alias("kept"), "draw", F.col("toxic").cast("int").alias("toxic"), "lang", "text"
        ), "labelled-texts")
        for k in range(PASSES):
            _improve(model, every.filter("not kept"), SEED + 1 + k)
        _calibrate(model, every.filter("kept"))
        discard(every)
    discard(marked)
    model.__dict__.pop("state", None)
    return model


def _changes(model: Classifier, seed: int, rows: pa.Table) -> pa.Table:
    """What one pass over a shard changes: ``key`` and ``change`` in steps."""
    rows = rows.sort_by([("draw", "ascending"), ("text", "ascending")])
    own = pickle.loads(pickle.dumps(model)).fit([t.encode() for t in rows.column("text").to_pylist()], rows.column("toxic").to_numpy().astype(np.float32), seed, 1)
    change = own.embed - model.embed
    live = np.flatnonzero(change.any(axis=1))
    dense = own.dense() - model.dense()
    steps = np.rint(np.concatenate([change[live].astype(np.float64), dense]) * STEPS).astype(np.int64)
    columns = {f"c{i}": steps[:, i] for i in range(DIM)}
    return pa.table({"key": np.concatenate([live, -1 - np.arange(len(dense))])} | columns)


def _improve(model: Classifier, rows: DataFrame, seed: int) -> None:
    """One round: every shard goes on from the model, changes are averaged by Spark and added."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(DIM)]
    moved = rows.groupBy("shard").applyInArrow(lambda t: _changes(shared.value, seed, t), ", ".join(f"{c} long" for c in ("key", *names)))
    total = moved.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow()
    change = np.stack([total.column(c).to_numpy() for c in names], axis=1) / STEPS
    model.move(total.column("key").to_numpy(), change / total.column("n").to_numpy()[:, None])
    shared.unpersist()


def _judged(model: Classifier, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, limit=2 << 20):
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("toxic"), pa.array(model.scores(raw_texts(part)))], ["lang", "toxic", "score"])


def _calibrate(model: Classifier, rows: DataFrame) -> None:
    """Thresholds of the languages with enough rows of both classes, between thousandths of a score that all kept rows are counted by."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    judged = rows.select("lang", "toxic", "text").mapInArrow(lambda it: _judged(shared.value, it), "lang string, toxic int, score double")
    bins = judged.groupBy("lang", F.floor(F.col("score") * 1000).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"), F.min("score").alias("low"), F.max("score").alias("high")
    ).collect()
    model.thresholds = {}
    for lang in sorted({r["lang"] for r in bins}):
        own = sorted((r for r in bins if r["lang"] == lang), key=lambda r: -r["bin"])
        n, bad = (np.array([r[k] for r in own]) for k in ("n", "bad"))
        if min(bad.sum(), (n - bad).sum()) >= ENOUGH:
            i = int(np.argmax(2 * np.cumsum(bad) / (np.cumsum(n) + bad.sum())))
            following = own[i + 1]["high"] if i + 1 < len(own) else 0.0
            model.thresholds[lang] = float(np.clip((own[i]["low"] + following) / 2, 0.1, 0.9))


def _scored(model: Classifier | Constant, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, limit=2 << 20):
            score = model.scores(raw_texts(part))
            limit = [model.thresholds.get(x or "", THRESHOLD) for x in part.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)),
                 pa.array(score >= np.array(limit))],
                ["doc_id", "held_out", "score", "predicted", "flagged"],
            )


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, flagged`` for every document.

    ``predicted`` holds the score against the fixed threshold, ``flagged`` against
    that of the document's language.
    """
    model = train(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", "lang")
    return rows.mapInArrow(
        lambda it: _scored(shared.value, it), f"doc_id {kind}, held_out boolean, score double, predicted int, flagged boolean"
    )


def _unflagged(model: Classifier | Constant, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, limit=2 << 20):
            limit = [model.thresholds.get(x or "", THRESHOLD) for x in part.column("lang").to_pylist()]
            yield part.filter(pa.array(model.scores(raw_texts(part)) < np.array(limit)))


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not flagged, with all their columns; each row is judged where it is read."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels))
    return documents.mapInArrow(lambda it: _unflagged(shared.value, it), documents.schema)
