"""Group sizes per row without bringing a group together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Join keys that the rows of a repeated value are dealt over.
SALTS = 8


def with_group_count(df: DataFrame, key: Column, name: str, salts: int = SALTS, long: bool = False) -> DataFrame:
    """Add ``name``: how many rows share ``key``; nulls equal each other. Of ``long`` keys a digest of 256 bits is shuffled.

    Counts are partial aggregates. Only repeated values are joined back, salted, so
    a value that a third of all rows hold is met by many tasks; a window would
    bring all its rows into one.
    """
    spread = F.col("_row_id") if "_row_id" in df.columns else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    text = F.coalesce(key.cast("string"), F.lit(""))
    keyed = df.withColumns({
        "_null": key.isNull(), "_key": F.unhex(F.sha2(text, 256)) if long else text,
        "_salt": F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"),
    })
    repeated = (
        keyed.groupBy("_null", "_key").agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    joined = keyed.join(repeated, ["_null", "_key", "_salt"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(name, F.lit(1)).alias(name))


def first_rows(df: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group, numbered ``rn``; map tasks cut groups before the shuffle."""
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rn") <= most)
