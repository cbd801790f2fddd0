"""Extracts: one selection, used alike to count, to build and to write."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.config import SHEET_ROWS, SLOW_CELLS
from ledgerline.functions import dates
from ledgerline.functions.text import quoted
from ledgerline.operators.completeness import column_fill, data_columns
from ledgerline.operators.roles import Roles

#: Cells that an xlsx writer puts out in a second, for estimates.
CELLS_PER_SECOND = 59_000


def ordered_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that exist, in the order of the table."""
    asked = set(wanted)
    return [c for c in df.columns if c in asked]


@dataclass(frozen=True)
class Selection:
    """Which rows: a range or set of months of ``ts``, undated rows or not, less the excluded ones."""

    ts: Column
    start: str = ""
    end: str = ""
    months: tuple[str, ...] | None = None
    undated: bool = False
    exclude: Column | None = None

    @property
    def chosen(self) -> Column:
        mask = dates.in_months(self.ts, self.start, self.end, None if self.months is None else list(self.months))
        if self.months is None and not (self.start or self.end):
            mask = self.ts.isNotNull()
        return mask | self.ts.isNull() if self.undated else mask

    @property
    def excluded(self) -> Column:
        return F.coalesce(self.exclude, F.lit(False)) if self.exclude is not None else F.lit(False)

    @property
    def mask(self) -> Column:
        return self.chosen & ~self.excluded


@dataclass(frozen=True)
class Plan:
    """What an extract would hold."""

    rows: int
    columns: list[str]
    undated_rows: int
    undated_included: bool
    months: list[tuple[str, int]]
    excluded_rows: int

    @property
    def cells(self) -> int:
        return self.rows * len(self.columns)

    @property
    def exceeds_sheet(self) -> bool:
        return self.rows > SHEET_ROWS - 1

    @property
    def may_be_slow(self) -> bool:
        return self.cells > SLOW_CELLS

    @property
    def xlsx_seconds(self) -> float:
        return self.cells / CELLS_PER_SECOND


def plan_counts(df: DataFrame, pick: Selection) -> DataFrame:
    """One row: ``rows, excluded_rows, undated_rows``; undated rows do not depend on whether they are taken."""
    return df.agg(
        F.count_if(pick.mask).alias("rows"), F.count_if(pick.chosen & pick.excluded).alias("excluded_rows"),
        F.count_if(pick.ts.isNull()).alias("undated_rows"),
    )


def plan_months(df: DataFrame, pick: Selection) -> DataFrame:
    """``month, rows`` of the dated rows that the extract holds."""
    kept = df.filter(pick.mask & pick.ts.isNotNull())
    return kept.groupBy(dates.month_text(pick.ts).alias("month")).agg(F.count(F.lit(1)).alias("rows")).orderBy("month")


def plan_extract(df: DataFrame, pick: Selection, columns: list[str]) -> Plan:
    """Counts without rows: a plan and its extract share one mask, so they cannot disagree."""
    row = plan_counts(df, pick).first()
    months = [(r["month"], r["rows"]) for r in plan_months(df, pick).collect()]
    return Plan(row["rows"], ordered_columns(df, columns), row["undated_rows"], pick.undated, months, row["excluded_rows"])


def build_extract(df: DataFrame, pick: Selection, columns: list[str], limit: int | None = None) -> DataFrame:
    """The selected rows and columns; a limit takes the first ones in file order."""
    names = ordered_columns(df, columns)
    if not names:
        raise ValueError("No columns selected for the extract")
    rows = df.filter(pick.mask)
    if limit is not None:
        rows = (rows.orderBy("_row_id") if "_row_id" in df.columns else rows).limit(limit)
    return rows.select(*[F.col(quoted(n)) for n in names])


def columns_like(df: DataFrame, part: str) -> list[str]:
    return [f.name for f in data_columns(df) if part.lower() in f.name.lower()]


def preset(df: DataFrame, kind: str, roles: Roles | None = None) -> list[str]:
    """Column presets: ``standard`` (what roles chose, else all), ``all``, ``none``, ``non_empty``."""
    names = [f.name for f in data_columns(df)]
    if kind == "none":
        return []
    if kind == "standard" and roles:
        chosen = {c for r in roles.ranked if (c := roles.get(r))} | {c for c in (roles.created, roles.closed) if c}
        return [c for c in names if c in chosen] or names
    if kind == "non_empty":
        held = {r["column"] for r in column_fill(df).filter("fill > 0").select("column").collect()}
        return [c for c in names if c in held]
    return names


def suggest_filename(source: str | None, date_column: str, start: str, end: str, fmt: str, months: list[str] | None = None) -> str:
    """``stem_column_span.fmt`` of letters, digits and underscores."""
    stem = os.path.splitext(os.path.basename(source))[0] if source else "extract"
    if months is not None and months:
        chosen = sorted(months, key=dates.month_key)
        span = f"{chosen[0]}_to_{chosen[-1]}"
        if len(chosen) == 1:
            span = chosen[0]
        elif not dates.is_contiguous(chosen):
            span = f"{len(chosen)}_months_{span}"
    elif start and end:
        span = start if start == end else f"{start}_to_{end}"
    else:
        span = "all"
    parts = [re.sub(r"[^A-Za-z0-9]+", "_", p).strip("_") for p in (stem, date_column, span) if p]
    return "_".join(p for p in parts if p) + f".{fmt}"


def provenance(plan: Plan, date_column: str, pick: Selection, source: str | None = None, partial: list[str] = ()) -> list[tuple[str, str]]:
    """What an extract is, as pairs for a sheet or a file beside it."""
    import datetime

    span = dates.months_label(list(pick.months)) if pick.months is not None else dates.range_label(pick.start, pick.end)
    return [
        ("Source file", os.path.basename(source) if source else "not known"),
        ("Date column", date_column or "none"),
        ("Period", span),
        ("Months with rows", str(len(plan.months))),
        ("Incomplete months", "; ".join(partial) or "none"),
        ("Rows", f"{plan.rows:,}"),
        ("Rows excluded", f"{plan.excluded_rows:,}"),
        ("Rows without a date", f"{plan.undated_rows:,}"),
        ("Undated rows included", "Yes" if plan.undated_included else "No"),
        ("Columns", str(len(plan.columns))),
        ("Column names", ", ".join(plan.columns)),
        ("Extracted", datetime.datetime.now().strftime("%Y-%m-%d %H:%M")),
    ]
