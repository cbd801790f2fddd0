"""Nulls, fill and profiles: one wide aggregate, turned to one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import dates
from ledgerline.functions.text import is_missing, quoted, strip
from ledgerline.operators.roles import Roles
from ledgerline.plans.spread import estimated_bytes  # noqa: F401  (part of this surface)


def data_columns(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name != "_row_id"]


def percent(part: Column, whole: Column) -> Column:
    """Share in percent to two places; nothing of nothing is 0."""
    return F.round(F.coalesce(part * 100.0 / F.nullif(whole, F.lit(0)), F.lit(0.0)), 2)


def per_column(df: DataFrame, aggregates: dict[str, callable], fields: list[T.StructField] | None = None) -> DataFrame:
    """One row per column of ``df``: ``position, column, rows`` and the named aggregates.

    Each aggregate is a function of a schema field; all run in a single pass.
    """
    fields = fields if fields is not None else data_columns(df)
    if not fields:
        return df.sparkSession.createDataFrame([], "position int, column string, rows long")
    wide = df.agg(F.count(F.lit(1)).alias("rows"), cells(fields, aggregates))
    return wide.select("rows", F.inline("cells")).select("position", "column", "rows", *aggregates)


def cells(fields: list[T.StructField], aggregates: dict[str, callable]) -> Column:
    """An array ``cells`` with a struct of the named aggregates for each column."""
    return F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), *[make(f).alias(name) for name, make in aggregates.items()])
        for i, f in enumerate(fields)
    ]).alias("cells")


def null_cells(df: DataFrame) -> Column:
    """Nulls and their share of each column, as ``cells``, to be computed beside other aggregates."""
    return cells(data_columns(df), {"nulls": _nulls, "null_pct": lambda f: percent(_nulls(f), F.count(F.lit(1)))})


def _nulls(f: T.StructField) -> Column:
    return F.count_if(is_missing(f.name, f.dataType))


def null_profile(df: DataFrame, threshold: float = 20) -> DataFrame:
    """``position, column, rows, nulls, null_pct, above_threshold``; the rounded share is compared."""
    counted = per_column(df, {"nulls": _nulls})
    share = percent(F.col("nulls"), F.col("rows"))
    return counted.withColumn("null_pct", share).withColumn("above_threshold", F.col("null_pct") > threshold)


def high_null_columns(profile: DataFrame) -> DataFrame:
    return profile.filter("above_threshold").select("column")


def null_kpis(profile: DataFrame) -> DataFrame:
    """Fields over the threshold, empty ones, the emptiest, and the share of empty cells."""
    return profile.agg(
        F.count_if("above_threshold").alias("over_threshold"),
        F.count_if((F.col("nulls") >= F.col("rows")) & (F.col("rows") > 0)).alias("entirely_empty"),
        F.max_by("column", F.struct("null_pct", -F.col("position"))).alias("emptiest"),
        F.max("null_pct").alias("emptiest_pct"),
        percent(F.sum("nulls"), F.sum("rows")).alias("empty_cells_pct"),
    )


def column_fill(df: DataFrame) -> DataFrame:
    """``position, column, fill``: share of rows that hold something; the empty string is nothing."""

    def empty(f: T.StructField) -> Column:
        c = is_missing(f.name, f.dataType)
        if isinstance(f.dataType, T.StringType):
            c = c | (F.col(quoted(f.name)) == "")
        return F.count_if(c)

    counted = per_column(df, {"empty": empty})
    fill = 1 - F.col("empty") / F.nullif(F.col("rows"), F.lit(0))
    return counted.select("position", "column", F.coalesce(fill, F.lit(0.0)).alias("fill"))


def null_chart(profile: DataFrame, rows: int = 15) -> DataFrame:
    """The columns with nulls, fullest of them first."""
    return profile.filter("nulls > 0").orderBy(F.desc("null_pct"), "position").limit(rows)


def data_profile(df: DataFrame, created: Column | None = None) -> DataFrame:
    """``rows, columns``, the first and last of ``created`` as text."""
    first, last = (F.min(created), F.max(created)) if created is not None else (F.lit(None), F.lit(None))
    text = lambda c, form: F.date_format(c.cast("timestamp_ntz"), form)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(data_columns(df))).alias("columns"),
        text(first, "yyyy-MM-dd").alias("first_date"), text(last, "yyyy-MM-dd").alias("last_date"),
        text(first, "yyyy-MM-dd HH:mm").alias("first_created"), text(last, "yyyy-MM-dd HH:mm").alias("last_created"),
    )


def column_profile(df: DataFrame, order: str = "_row_id") -> DataFrame:
    """``position, column, rows, type, sample, padded``: first value in ``order``, and white space at ends anywhere."""

    def sample(f: T.StructField) -> Column:
        c = F.col(quoted(f.name))
        return F.substring(F.min_by(c.cast("string"), F.when(~is_missing(f.name, f.dataType), F.col(order))), 1, 50)

    def padded(f: T.StructField) -> Column:
        c = F.col(quoted(f.name))
        if not isinstance(f.dataType, T.StringType):
            return F.lit(False)
        return F.coalesce(F.bool_or(strip(c) != c), F.lit(False))

    kinds = {"type": lambda f: F.lit(f.dataType.simpleString()), "sample": sample, "padded": padded}
    return per_column(df, kinds, [f for f in data_columns(df) if f.name != order or order != "_row_id"])


def column_health(df: DataFrame, roles: Roles, threshold: float = 20, order: str = "_row_id") -> DataFrame:
    """Profile, nulls and matched role of every column, joined on its position."""
    matched: dict[str, str] = {}
    for role, columns in roles.ranked.items():
        for c in columns:
            matched.setdefault(c, role)
    names = df.sparkSession.createDataFrame(list(matched.items()), "column string, role string")
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    profile, nulls = column_profile(df, order), null_profile(df, threshold).drop("column", "rows")
    return profile.join(nulls, "position").join(names, "column", "left").select(
        F.col("column").alias("Column"), F.coalesce("role", F.lit("")).alias("Matched Requirement"), F.col("type").alias("Type"),
        F.col("sample").alias("Sample Value"), F.col("nulls").alias("Nulls"), F.col("null_pct").alias("Null %"),
        yes(F.col("above_threshold")).alias("Above Threshold"), yes(F.col("padded")).alias("Padded Whitespace"),
    )


def unused_column_table(df: DataFrame, roles: Roles) -> DataFrame:
    """Columns no role chose, with type and fill in percent to one place."""
    from ledgerline.operators.roles import unused_columns

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(c, kinds[c]) for c in unused_columns(df, roles)]
    listed = df.sparkSession.createDataFrame(rows, "column string, type string")
    filled = column_fill(df)
    return filled.join(listed, "column").select("position", "column", "type", F.round(F.col("fill") * 100, 1).alias("fill_pct"))


def has_times(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if dates.is_typed(f.dataType)]
