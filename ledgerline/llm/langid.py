"""Language ID by Bayesian evidence fusion.

Four pieces of evidence are multiplied for each page: byte-trigram likelihoods of
its whole visible text (tempered, since trigrams overlap), the language its markup
declares, the suffix of its address, and a prior for its host. The host prior is
smoothed towards its registered domain's, that one towards the corpus's. Counts
behind declared language, suffix, domain and host are sums of text posteriors made
by grouped aggregation; a page's own share is taken out before it is judged by them.

Documents are judged beside pages, with their source in place of a host (a name of its
own that has neither domain nor suffix) and no markup or address. Text likelihoods are
fitted on at most ``SAMPLE`` labelled documents, and ``SAMPLE_BYTES`` of text, of each
language, drawn by a seeded hash. A model holds the ``LANGUAGES`` commonest labels, by
default 400, which bounds what every task holds (256 KiB a language); ``languages=None`` takes
every label. Everything else covers all rows.

Edge cases: null or empty texts and pages are judged by the other evidence; a row without
source or address has no host, domain or suffix, and the corpus's shares for a prior; markup
without a declaration gives no evidence, and none is looked for in comments, scripts and styles;
without labelled documents every language is null; repeated rows and rows that share an
id are judged each for itself; a very long text or page is read whole; of equally likely
languages the first by name is taken; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import materialise, raw_texts, salted_left_join, text_key, text_slices

#: Bounds of the labelled sample: documents and bytes of each language, languages (the commonest); its seed; hash buckets of trigrams.
SAMPLE, SAMPLE_BYTES, LANGUAGES, SEED, BUCKETS = 1000, 8 << 20, 400, 5, 1 << 16
#: Exponent on text likelihoods, trigrams that count at most, pseudo-counts of trigrams and levels.
TEMPER, MOST, ALPHA, KAPPA = 0.3, 200.0, 0.5, 4.0
#: Second labels under which countries register domains.
SECOND_LABELS = ("ac", "co", "com", "edu", "gob", "gov", "net", "or", "org")
#: What stands before a document's source, and in no host's name.
SOURCE = "source:"
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.IGNORECASE)


def trigram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram at each byte (``BUCKETS`` where it would leave its text) and text starts."""
    data = np.frombuffer(b"".join(t.lower() + b"\0\0" for t in texts) + b"\0\0", dtype=np.uint8)
    sizes = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    b = data.astype(np.uint32)
    n = len(b) - 2
    mixed = b[:n] * np.uint32(_MULTIPLIERS[0]) + b[1 : n + 1] * np.uint32(_MULTIPLIERS[1]) + b[2:] * np.uint32(_MULTIPLIERS[2])
    bucket = (mixed >> np.uint32(16)).astype(np.int32)
    ends = starts + sizes
    for back in (1, 2):
        bucket[ends - back] = BUCKETS
    for back in (3, 4):  # trigrams of a text's last two bytes reach into the padding
        bucket[ends[sizes >= back] - back] = BUCKETS
    return bucket, starts


class TrigramModel:
    """Log likelihood of hashed byte trigrams per language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.table = np.zeros((BUCKETS + 1, max(1, len(self.languages))), dtype=np.float32)
        for k, lang in enumerate(self.languages):
            smoothed = counts[lang] + ALPHA
            self.table[:BUCKETS, k] = np.log(smoothed / smoothed.sum())

    def posteriors(self, texts: list[bytes]) -> np.ndarray:
        """Tempered text posterior under a flat prior, shape (texts, languages)."""
        if not texts or not self.languages:
            return np.zeros((len(texts), len(self.languages)))
        bucket, starts = trigram_buckets(texts)
        sums = np.stack([np.add.reduceat(self.table[:, k][bucket], starts, dtype=np.float64) for k in range(len(self.languages))], axis=1)
        n = np.maximum(np.array([len(t) for t in texts]) - 2, 1)
        logs = sums * (TEMPER * np.minimum(1, MOST / n))[:, None]
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def visible(page: str) -> bytes:
    """Text of a page without scripts, styles, comments and tags."""
    return _text(_HIDDEN.sub(" ", page))


def _text(markup: str) -> bytes:
    return html.unescape(_TAG.sub(" ", markup)).encode("utf-8", errors="ignore")


def _judged(model: TrigramModel, batches: Iterator[pa.RecordBatch], markup: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, limit=4 << 20):
            if markup:
                raw = [x or "" for x in part.column("text").to_pylist()]
                raw = [_HIDDEN.sub(" ", x) for x in raw]
                declared = [m[1].lower() if (m := _DECLARED.search(x)) else None for x in raw]
                texts = [_text(x) for x in raw]
            else:
                texts, declared = raw_texts(part), [None] * part.num_rows
            p = model.posteriors(texts)
            flat = pa.array(p.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * p.shape[1]), flat)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("host"), pa.array(declared, pa.string()), lists], ["id", "host", "declared", "p"]
            )


def host_of(url: Column) -> Column:
    """Lower-cased host of an address; null without one."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def _log(c: Column) -> Column:
    return F.log(F.greatest(c, F.lit(1e-12)))


def _arrays(columns: int, name: str) -> list[Column]:
    return [F.sum(F.element_at("p", k + 1)).alias(f"{name}{k}") for k in range(columns)]


def _packed(name: str, columns: int) -> Column:
    return F.array(*[F.col(f"{name}{k}") for k in range(columns)]).alias(name)


def _counted(texts: pa.Table) -> pa.Table:
    """Trigram counts of one language's sampled texts."""
    counts = np.zeros(BUCKETS + 1, dtype=np.int64)
    for batch in texts.to_batches():
        for part in text_slices(batch, limit=2 << 20):
            counts += np.bincount(trigram_buckets(raw_texts(part))[0], minlength=BUCKETS + 1)
    return pa.table({"lang": texts.column("lang").slice(0, 1), "counts": pa.array([counts[:BUCKETS].astype(np.int32).tobytes()], pa.binary())})


def training_rows(documents: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, languages: int | None = LANGUAGES) -> DataFrame:
    """``lang, text``: a bounded, seeded sample of every language's labelled documents, rare languages too.

    Equal texts count once. Ranks are cut on the map side, so no task sees all of a common language.
    """
    rows = documents.filter("lang is not null and text is not null").select("lang", "text", "doc_id", text_key().alias("th"))
    if languages is not None:
        listed = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
        rows = rows.join(F.broadcast(listed), "lang")
    drawn = rows.groupBy("lang", "th").agg(
        F.min(F.xxhash64(F.lit(SEED), "doc_id", "th")).alias("draw"), F.max(F.octet_length("text")).alias("size")
    )
    order = Window.partitionBy("lang").orderBy("draw", "th")
    first = drawn.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= sample)
    fits = first.withColumn("upto", F.sum("size").over(order)).filter((F.col("upto") <= most_bytes) | (F.col("at") == 1))
    chosen = fits.select("lang", "th")
    return rows.join(chosen if languages is None else F.broadcast(chosen), ["lang", "th"]).groupBy("lang", "th").agg(F.min("text").alias("text")).select("lang", "text")


def train(documents: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, languages: int | None = LANGUAGES) -> TrigramModel:
    """Count each language's sample in a task of its own; the driver gets counts, no texts."""
    counted = training_rows(documents, sample, most_bytes, languages).groupBy("lang").applyInArrow(_counted, "lang string, counts binary")
    return TrigramModel({r["lang"]: np.frombuffer(r["counts"], np.int32).astype(np.float64) for r in counted.collect()})


def identify(documents: DataFrame, pages: DataFrame, languages: int | None = LANGUAGES) -> DataFrame:
    """``kind, doc_id, page_id, host, declared, lang, confidence, text_lang`` for all documents and pages."""
    model = train(documents, languages=languages)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = "id long, host string, declared string, p array<double>"
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), F.concat(F.lit(SOURCE), "source").alias("host"), "text")
    web = pages.select(F.col("page_id").cast("long").alias("id"), host_of(F.col("url")).alias("host"), F.col("html").alias("text"))
    rows = (
        docs.mapInArrow(lambda it: _judged(shared.value, it, False), schema).withColumn("kind", F.lit("document"))
        .unionByName(web.mapInArrow(lambda it: _judged(shared.value, it, True), schema).withColumn("kind", F.lit("page")))
    )
    judged = materialise(rows, "langid-rows")
    return posterior(judged, model.languages).select(
        "kind", F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
        "host", "declared", "lang", "confidence", "text_lang",
    )


def posterior(judged: DataFrame, languages: list[str]) -> DataFrame:
    """Add ``lang, confidence, text_lang`` to rows of ``host, declared, p`` (further columns stay)."""
    n = len(languages)
    if not n:
        nothing = F.lit(None).cast("string")
        return judged.select("*", nothing.alias("lang"), F.lit(None).cast("double").alias("confidence"), nothing.alias("text_lang"))
    rows = judged.withColumn("host_key", F.coalesce("host", F.lit(""))).withColumn("said", F.coalesce("declared", F.lit("")))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    parts, address = F.split("host_key", r"\."), ~F.col("host_key").startswith(SOURCE)
    suffix = F.when(address & F.col("host_key").contains("."), F.element_at(parts, -1)).otherwise("")
    # Below a country's suffix, a general second label is part of the suffix: the domain is one label longer.
    general = F.size(parts).between(3, 1 << 20) & (F.length(suffix) == 2) & F.element_at(parts, -2).isin(*SECOND_LABELS)
    labels = F.when(general, 3).otherwise(2)
    domain = F.when(address & (F.size(parts) > 1), F.array_join(F.slice(parts, -labels, labels), ".")).otherwise(F.col("host_key"))
    cells = rows.groupBy("host_key", "said").agg(*_arrays(n, "p"))
    cells = materialise(cells.select("host_key", "said", suffix.alias("suffix"), domain.alias("domain"), _packed("p", n)), "langid-cells")

    def level(key: str) -> DataFrame:
        return cells.groupBy(key).agg(*_arrays(n, "x")).select(key, _packed("x", n).alias(f"by_{key}"))

    total = cells.agg(*_arrays(n, "x")).first()
    total = [float(total[f"x{k}"] or 0.0) for k in range(n)]
    corpus = [(t + 1.0) / (sum(total) + n) for t in total]
    known = cells.select("host_key", "said", "suffix", "domain")
    for key, spread in (("host_key", "said"), ("domain", "host_key"), ("suffix", "host_key"), ("said", "host_key")):
        known = salted_left_join(known, level(key), key, spread)
    known = known.select(F.struct("host_key", "said").alias("cell"), "suffix", "by_host_key", "by_domain", "by_suffix", "by_said")
    joined = salted_left_join(rows.withColumn("cell", F.struct("host_key", "said")), known, "cell", "_row")

    # Rows of a level without the row's own share, once per row.
    size = lambda name: F.greatest(F.aggregate(name, F.lit(0.0), lambda a, x: a + x) - 1, F.lit(0.0))
    levels = ("by_host_key", "by_domain", "by_suffix", "by_said")
    sized = joined.withColumns({f"n_{name}": size(name) for name in levels} | {"corpus": F.array(*[F.lit(c) for c in corpus])})

    def evidence(p: Column, k: Column) -> Column:
        """Log of what speaks for language k."""
        share = F.element_at("corpus", k + 1)

        def smoothed(name: str, below: Column) -> Column:
            return (F.greatest(F.element_at(name, k + 1) - p, F.lit(0.0)) + KAPPA * below) / (F.col(f"n_{name}") + KAPPA)

        prior = F.when(F.col("host_key") == "", share).otherwise(smoothed("by_host_key", smoothed("by_domain", share)))
        # P(value | language) against P(value): how the value's rows shift the language shares.
        return (
            _log(p) + _log(prior)
            + F.when(F.col("said") != "", _log(smoothed("by_said", share) / share)).otherwise(0.0)
            + F.when(F.col("suffix") != "", _log(smoothed("by_suffix", share) / share)).otherwise(0.0)
        )

    names = F.array(*[F.lit(x) for x in languages])
    scored = sized.withColumn("logs", F.transform("p", evidence)).withColumn("top", F.array_max("logs"))
    norm = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return scored.withColumn("norm", norm).select(
        *judged.columns,
        F.element_at(names, F.array_position("logs", F.col("top")).cast("int")).alias("lang"),
        (1 / F.col("norm")).alias("confidence"),
        F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("text_lang"),
    )
