"""The values a state column uses, and which of them look wrong."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.config import NEAR_LIMIT, NEAR_RATIO, RARE_COUNT, RARE_SHARE
from ledgerline.functions import state
from ledgerline.functions.text import fold, is_blank, quoted
from ledgerline.operators.completeness import percent
from ledgerline.plans.materialise import materialise


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def state_values(df: DataFrame, column: str) -> DataFrame:
    """``value, count, pct, classification`` of the values as written; null and blank ones are left out."""
    c = F.col(quoted(column)).cast("string")
    counted = df.groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    rows = counted.agg(F.sum("count")).scalar()
    listed = counted.filter(~is_blank(F.col("value")))
    return listed.select("value", "count", percent(F.col("count"), rows).alias("pct"), state.classify(F.col("value")).alias("classification"))


def _candidates(values: DataFrame, ratio: float) -> DataFrame:
    """``a, na, fa, b, nb, fb``: pairs whose letters allow the ratio, ``b`` the commoner one, without comparing all.

    The matching characters of two texts are at most the letters they share, each as often as both
    hold it. With a letter's n-th occurrence as an element, texts are sets, and the ratio asks for a
    common part of at least ratio / 2 of both lengths. Elements are ranked rarest first; two such sets
    share one among the first n - least + 1 of each, where least is the smallest common part that any partner
    allows, so only those are joined, and the whole sets are compared before the matcher runs.
    """
    folded = values.select("value", "count", fold(F.col("value")).alias("folded"))
    letters = F.array_sort(F.split("folded", ""))
    element = F.transform("letters", lambda c, i: F.concat(c, (i - F.array_position("letters", c)).cast("string")))
    worded = materialise(folded.withColumn("letters", letters).select("value", "count", "folded", element.alias("elements")), "vocabulary")
    frequency = worded.select(F.explode("elements").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("df"))
    flat = worded.select("value", F.explode("elements").alias("e")).join(frequency, "e")
    n = F.size("ranked")
    partner = F.ceil(n * (ratio / (2 - ratio)) - 1e-9)
    least = F.ceil((n + partner) * (ratio / 2) - 1e-9)
    ranked = flat.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("ranked"))
    first = ranked.select("value", n.alias("n"), F.explode(F.slice("ranked", F.lit(1), F.greatest(F.lit(1), n - least + 1).cast("int"))).alias("x"))
    first = first.join(worded.select("value", "count"), "value").select("value", "count", "n", F.col("x.e").alias("e"))
    a, b = first.alias("a"), first.alias("b")
    size = F.col("b.n") >= F.col("a.n") * (ratio / (2 - ratio)) - 1e-9, F.col("a.n") >= F.col("b.n") * (ratio / (2 - ratio)) - 1e-9
    met = a.join(b, (F.col("a.e") == F.col("b.e")) & (F.col("b.count") > F.col("a.count")) & size[0] & size[1])
    pairs = met.select(F.col("a.value").alias("a"), F.col("b.value").alias("b")).distinct()
    sided = lambda x: worded.select(F.col("value").alias(x), F.col("count").alias(f"n{x}"), F.col("folded").alias(f"f{x}"), F.col("elements").alias(f"e{x}"))
    whole = pairs.join(sided("a"), "a").join(sided("b"), "b")
    enough = F.size(F.array_intersect("ea", "eb")) >= (F.size("ea") + F.size("eb")) * (ratio / 2) - 1e-9
    return whole.filter(enough).select("a", "na", "fa", "b", "nb", "fb")


def near_duplicates(values: DataFrame, ratio: float = NEAR_RATIO, limit: int | None = NEAR_LIMIT) -> DataFrame:
    """``value, looks_like``: the commonest strictly commoner value that equals it folded or is similar enough.

    The number of values is counted first; a vocabulary of more than ``limit`` is taken for none:
    it is not compared, and ``check_state_values`` says so. Without a limit any number of values is
    compared, exactly, by way of the letters that pairs share.
    """
    if limit is None:
        pairs = _candidates(values, ratio)
    elif not 2 <= values.limit(limit + 1).count() <= limit:
        return values.sparkSession.createDataFrame([], "value string, looks_like string")
    else:
        a = values.select(F.col("value").alias("a"), F.col("count").alias("na"), fold(F.col("value")).alias("fa"))
        b = values.select(F.col("value").alias("b"), F.col("count").alias("nb"), fold(F.col("value")).alias("fb"))
        pairs = a.join(F.broadcast(b), F.col("nb") > F.col("na"))
    close = pairs.filter((F.col("fa") == F.col("fb")) | (similarity("fa", "fb") >= ratio))
    return close.groupBy(F.col("a").alias("value")).agg(F.min_by("b", F.struct(-F.col("nb"), F.col("b"))).alias("looks_like"))


def reason(count: Column, pct: Column, looks_like: Column) -> Column:
    """Why a value is suspect; null for a standard one. The rounded share is compared."""
    return (
        F.when(looks_like.isNotNull(), F.concat(F.lit("looks like '"), looks_like, F.lit("'")))
        .when((pct < RARE_SHARE) & (count <= RARE_COUNT), "rare value")
    )


def check_state_values(df: DataFrame, column: str, limit: int | None = NEAR_LIMIT) -> DataFrame:
    """``value, count, pct, classification, looks_like, reason, compared``, commonest first.

    ``compared`` says whether values were held against each other at all, which more
    than ``limit`` of them are not.
    """
    values = materialise(state_values(df, column), "state-values")  # one scan of the table, however often they are compared
    joined = values.join(near_duplicates(values, limit=limit), "value", "left")
    compared = F.lit(True) if limit is None else values.agg(F.count(F.lit(1)) <= limit).scalar()
    return joined.withColumns({"reason": reason(F.col("count"), F.col("pct"), F.col("looks_like")), "compared": compared}).orderBy(F.desc("count"), "value")


def suspect_rows(checked: DataFrame) -> DataFrame:
    return checked.agg(F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("count"))), F.lit(0)).cast("long").alias("suspect_rows"))


def state_table(checked: DataFrame) -> DataFrame:
    """The vocabulary for reading, suspects first."""
    reads = F.when(F.col("classification") == "terminal", "Closed").when(F.col("classification") == "active", "Open").otherwise("Unrecognised")
    ordered = checked.orderBy(F.col("reason").isNull(), F.desc("count"), "value")
    return ordered.select(
        F.col("value").alias("State Value"), F.col("count").alias("Count"), F.col("pct").alias("Share %"),
        reads.alias("Reads As"), F.coalesce("reason", F.lit("Standard")).alias("Assessment"),
    )


def unclassified(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("classification") == "unknown").orderBy(F.desc("count"), "value")
