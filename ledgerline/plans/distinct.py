"""Costly expressions once per distinct text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import quoted
from ledgerline.plans.groups import SALTS
from ledgerline.plans.spread import widened

#: Share of values that repeat others from which evaluation per distinct value pays for moving the texts.
WORTHWHILE = 0.5


def repeated_share(df: DataFrame, text: Column) -> float:
    """About how many of the values repeat another one: one pass over 64-bit hashes of them."""
    n, different = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(text))).first()
    return max(0.0, 1 - different / n) if n else 0.0


def per_distinct(df: DataFrame, text: Column, make: Callable[[Column], dict[str, Column]], salts: int = SALTS) -> DataFrame:
    """Add the columns that ``make`` computes from a text, each distinct text once.

    Texts meet by their 256-bit digest, copies in one task going before the shuffle. Results,
    which are small, are joined back by digest and salt; rows are dealt over the salts, so a text that a
    third of all rows hold is met by many tasks. Null is a value of its own. What ``make`` returns must be small
    beside the texts.
    """
    held = text.cast("string")
    number = F.monotonically_increasing_id()
    keyed = df.withColumn("_digest", F.coalesce(F.unhex(F.sha2(held, 256)), F.lit(b"")))
    distinct = widened(keyed.groupBy("_digest").agg(F.first(held).alias("_text")))
    made = make(F.col("_text"))
    judged = distinct.select("_digest", *[c.alias(name) for name, c in made.items()])
    judged = judged.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    kept = [F.col(quoted(c)) for c in df.columns if c not in made]
    dealt = keyed.select("_digest", F.pmod(number, F.lit(salts)).cast("int").alias("_salt"), *kept)
    return dealt.join(judged, ["_digest", "_salt"], "left").select(*kept, *[F.col(quoted(n)) for n in made])


def per_row(df: DataFrame, text: Column, make: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """The same columns, computed row by row."""
    return df.withColumn("_text", text.cast("string")).withColumns(make(F.col("_text"))).drop("_text")
