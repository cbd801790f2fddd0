"""Field order of text dates, and how well months are covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.config import EDGE_DAYS, GAP_DAYS
from ledgerline.functions import dates
from ledgerline.functions.text import quoted, strip
from ledgerline.operators.aggregates import month_counts  # noqa: F401  (part of this surface)


def date_order(df: DataFrame, column: str) -> DataFrame:
    """One row of evidence from the distinct texts of a column.

    ``total, iso, day_first, month_first, ambiguous, date_order, examples``. A first
    component over 12 can only be a day, a second one over 12 makes the first a month.
    """
    text = F.col("v")
    numeric, first, second = dates.numeric_date(text)
    values = df.select(F.col(quoted(column)).cast("string").alias("v")).filter("v is not null").distinct().filter(numeric)
    parts = values.select(
        strip(text).alias("v"), (F.length(first) == 4).alias("iso"), first.cast("int").alias("a"), second.cast("int").alias("b")
    )
    plain, a, b = ~F.col("iso"), F.col("a") > 12, F.col("b") > 12
    counted = parts.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("iso").alias("iso"),
        F.count_if(plain & a & ~b).alias("day_first"), F.count_if(plain & b & ~a).alias("month_first"),
        F.count_if(plain & ~a & ~b).alias("ambiguous"),
    )
    examples = parts.filter(plain & ~a & ~b).select("v").orderBy("v").limit(3).agg(F.array_sort(F.collect_list("v"))).scalar()
    order = (
        F.when(F.col("total") == 0, "not_numeric").when(F.col("iso") == F.col("total"), "iso")
        .when((F.col("day_first") > 0) & (F.col("month_first") > 0), "conflicting")
        .when(F.col("day_first") > 0, "day_first").when(F.col("month_first") > 0, "month_first").otherwise("ambiguous")
    )
    return counted.select("*", order.alias("date_order"), examples.alias("examples"))


def rows_that_would_change(df: DataFrame, column: str, day_first: bool) -> DataFrame:
    """One row: how many rows the other field order reads as another date."""
    c, kind = F.col(quoted(column)), df.schema[column].dataType
    here, other = dates.parse(c, kind, day_first), dates.parse(c, kind, not day_first)
    return df.agg(F.count_if(~here.eqNullSafe(other)).alias("rows_that_would_change"))


def check_date_formats(ctx) -> list[dict]:
    """Evidence on created and closed where text leaves the order open or mixed."""
    out = []
    for column, found in ctx.orders.items():
        if found["date_order"] in ("not_numeric", "iso"):
            continue
        changed = rows_that_would_change(ctx.df, column, ctx.day_first(column)).first()[0]
        out.append(found | {
            "column": column, "rows_that_would_change": changed,
            "needs_confirmation": found["date_order"] == "ambiguous" and changed > 0,
            "conflicting": found["date_order"] == "conflicting",
        })
    return out


def month_coverage(df: DataFrame, ts: Column) -> DataFrame:
    """Per month: ``month, rows, days_in_month, first_day, last_day, longest_gap`` and what is partial.

    Rows shrink to (month, day) counts in the first aggregation, 31 a month at most;
    gaps are found on those.
    """
    days = df.filter(ts.isNotNull()).groupBy(
        dates.month_text(ts).alias("month"), F.dayofmonth(ts).alias("day"), F.dayofmonth(F.last_day(ts)).alias("days_in_month")
    ).agg(F.count(F.lit(1)).alias("n"))
    gap = F.col("day") - F.lag("day").over(Window.partitionBy("month").orderBy("day")) - 1
    months = days.withColumn("gap", F.coalesce(gap, F.lit(0))).groupBy("month", "days_in_month").agg(
        F.sum("n").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max("gap").alias("longest_gap")
    )
    start = (F.col("first_day") - 1) >= EDGE_DAYS
    end = (F.col("days_in_month") - F.col("last_day")) >= EDGE_DAYS
    hole = F.col("longest_gap") >= GAP_DAYS
    return months.select(
        "month", "rows", "days_in_month", "first_day", "last_day", "longest_gap",
        start.alias("truncated_start"), end.alias("truncated_end"), hole.alias("interior_gap"), (start | end | hole).alias("partial"),
    ).orderBy("month")


def partial_months(coverage: DataFrame, start: str = "", end: str = "") -> DataFrame:
    found = coverage.filter("partial")
    if start:
        found = found.filter(F.col("month") >= start)
    return found.filter(F.col("month") <= end) if end else found


def complete_months(coverage: DataFrame) -> DataFrame:
    return coverage.filter("not partial").select("month")


def describe(month: dict) -> str:
    """Why a month counts as partial, in days."""
    label, first, last, days = dates.month_label(month["month"]), month["first_day"], month["last_day"], month["days_in_month"]
    if month["truncated_start"] and month["truncated_end"]:
        return f"{label} has rows only from day {first} to day {last} of {days}"
    if month["truncated_end"]:
        return f"{label} ends on day {last} of {days}"
    if month["truncated_start"]:
        return f"{label} begins on day {first}, days 1-{first - 1} are missing"
    return f"{label} has {month['longest_gap']} days in a row without any row"


def trim_partial(coverage: list[dict], start: str, end: str) -> tuple[str, str]:
    """Step a range inward by a month at each partial end; it never becomes empty."""
    partial = {m["month"] for m in coverage if m["partial"]}
    if start in partial and start < end:
        start = _shifted(start, 1)
    if end in partial and start < end:
        end = _shifted(end, -1)
    return start, end


def _shifted(month: str, by: int) -> str:
    return dates.month_start(dates.month_key(month) + by)[:7]
