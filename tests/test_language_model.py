"""The trained language model and evaluation per distinct text."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import descriptions, language, language_model
from ledgerline.plans.distinct import per_distinct, per_row, repeated_share

NAMES = {"de": "German", "en": "English", "es": "Spanish", "fr": "French"}


def numbers(text):
    points = [ord(c) for c in f" {text.lower()} "]
    return [sum(f * p for f, p in zip(language_model.FACTORS, points[i : i + 3], strict=True)) % language_model.BUCKETS for i in range(len(points) - 2)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcé 漢😀Z", max_size=12), max_size=6))
def test_trigrams_stay_in_their_text(texts):
    found, begin = language_model.trigrams(texts)
    if all(len(t) == 0 for t in texts):
        assert not len(found)
    else:
        assert [x.tolist() for x in np.split(found, begin)[1:]] == [numbers(t) for t in texts]


def brute_weights(rows):
    counts = {}
    for text, label in rows:
        counts.setdefault(label, Counter()).update(numbers(text))
    total = {label: sum(c.values()) + 0.5 * language_model.BUCKETS for label, c in counts.items()}
    return {label: (lambda k, c=c, n=total[label]: round(1000 * math.log10((c[k] + 0.5) / n))) for label, c in counts.items()}


def brute_ranked(weights, text):
    own = numbers(text)
    sums = {label: sum(w(k) for k in own) for label, w in weights.items()}
    scale = min(len(own), language_model.REACH) / len(own) * math.log(10) / 1000
    parts = {label: math.exp((s - max(sums.values())) * scale) for label, s in sums.items()}
    return sorted(((label, p / sum(parts.values()), sums[label]) for label, p in parts.items()), key=lambda x: (-x[2], x[0]))


def documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", X.clean(F.col("text")).alias("text"))
    return d.replace(NAMES, subset="lang").filter("length(text) >= 8")


def test_model_equals_brute_force_and_judges_held_out_rows(spark, sf):
    rows = documents(spark, sf).collect()
    model = language_model.train(documents(spark, sf).filter("doc_id % 5 <> 1"), F.col("text"), F.col("lang"))
    weights = brute_weights([(r["text"], r["lang"]) for r in rows if r["doc_id"] % 5 != 1])
    held = [r for r in rows if r["doc_id"] % 5 == 1]
    asked = [r["text"] for r in held] + ["the order of the day", "un deux trois quatre", "x" * 9]
    for text, ranked in zip(asked, model(asked), strict=True):
        want = brute_ranked(weights, text)
        assert [name for name, _ in ranked] == [name for name, _, _ in want]
        assert np.allclose([p for _, p in ranked], [p for _, p, _ in want])
    right = sum(ranked[0][0] == r["lang"] for r, ranked in zip(held, model([r["text"] for r in held]), strict=True))
    assert right >= 0.97 * len(held)


def test_empty_training_and_too_many_languages(spark, monkeypatch):
    empty = spark.createDataFrame([("a", None), (None, "b")], "text string, label string")
    model = language_model.train(empty, F.col("text"), F.col("label"))
    assert model.languages == [] and model(["some text here"]) == [[]]
    run = language.check_column(spark.createDataFrame([(1, "a text of no language")], "_row_id long, v string"), "v", mode="model_only", model=model)
    assert run.rows.first()["lang"] is None and run.using_model
    monkeypatch.setattr(language_model, "LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than"):
        language_model.train(spark.createDataFrame([("a", "x"), ("b", "y")], "text string, label string"), F.col("text"), F.col("label"))


TEXTS = [None, "", "short", "Bonjour, le système ne marche pas", "hola buenos dias", "the printer is broken again", "  padded text here  "] * 6 + ["hola buenos dias"] * 60


def test_distinct_evaluation_gives_the_same_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "_row_id long, `a text` string").withColumn("lang", F.lit("clash"))
    make = lambda t: {"n": F.length(t), "up per": F.upper(t), "lang": F.concat(t, F.lit("!"))}
    a, b = (f(df, F.col("`a text`"), make) for f in (per_distinct, per_row))
    assert set(a.columns) == set(b.columns)
    assert sorted(a.collect(), key=str) == sorted(b.select(a.columns).collect(), key=str) and a.count() == len(TEXTS)
    assert repeated_share(df, F.col("`a text`")) > 0.8 and repeated_share(df.limit(0), F.col("`a text`")) == 0


def test_distinct_runs_equal_row_runs(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "_row_id long, v string")
    asked = []

    def model(texts):
        asked.extend(texts)
        return [[("Italian", 0.9), ("English", 0.1)] if "printer" in t else [("English", 0.9)] for t in texts]

    runs = [language.check_column(df, "v", model=model, distinct=d).rows for d in (False, True)]
    one, two = (sorted(r.collect()) for r in runs)
    assert one == two and {r["lang_method"] for r in one} == {None, "characters", "keywords", "model"}
    plain, distinct = (sorted(descriptions.normalised_rows(df, "v", distinct=d).collect()) for d in (False, True))
    assert plain == distinct
