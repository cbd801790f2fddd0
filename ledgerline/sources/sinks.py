"""Extracts and reports to files."""

from __future__ import annotations

import datetime
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.config import INLINE_ROWS, SHEET_ROWS
from ledgerline.functions.text import quoted, sanitise
from ledgerline.operators import aggregates, descriptions, language, logic, register, vocabulary
from ledgerline.operators.extract import Plan, Selection, provenance
from ledgerline.operators.logic import AuditContext
from ledgerline.operators.roles import CREATED, ID, PRIORITY, STATE
from ledgerline.session import remove_path
from ledgerline.sources.workbook import TooLarge, frame_sheet, frame_sheets, write_workbook

__all__ = ["TooLarge", "copy_as_tsv", "table_name", "write_csv", "write_extract", "write_report"]

#: Bytes that are copied at once when parts are joined.
JOINED_AT_ONCE = 1 << 20
BOM = "﻿"


def write_csv(frame: DataFrame, path: str) -> None:
    """One CSV file with header and byte order mark, in the order of the frame.

    Tasks write their partitions side by side; the parts are then joined byte by byte behind the
    mark and the header by Spark's file systems, and the file is moved into place when it is whole.
    """
    spark = frame.sparkSession
    clean = sanitise(frame, cell_limit=None)
    header = spark.createDataFrame([tuple(clean.columns)], [f"c{i}" for i in range(len(clean.columns))])
    folder = f"{path}.partial"
    remove_path(spark, folder)
    for part, rows in (("head", header), ("rows", clean)):
        rows.write.option("escape", '"').option("quoteAll", False).option("lineSep", "\n").option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
        ).csv(f"{folder}/{part}")
    _joined(spark, [f"{folder}/head", f"{folder}/rows"], path, f"{folder}/whole")
    remove_path(spark, folder)


def _joined(spark, folders: list[str], path: str, partial: str) -> None:
    """The part files of folders, in order, as one file behind a byte order mark; its bytes are streamed, never held."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    fs = hadoop.fs.Path(path).getFileSystem(conf)
    out = fs.create(hadoop.fs.Path(partial), True)
    try:
        out.write(bytearray(BOM.encode()))
        for folder in folders:
            parts = sorted(s.getPath().toString() for s in fs.listStatus(hadoop.fs.Path(folder)) if s.getPath().getName().startswith("part-"))
            for part in parts:
                source = fs.open(hadoop.fs.Path(part))
                try:
                    hadoop.io.IOUtils.copyBytes(source, out, JOINED_AT_ONCE, False)
                finally:
                    source.close()
    finally:
        out.close()
    fs.delete(hadoop.fs.Path(path), False)
    fs.rename(hadoop.fs.Path(partial), hadoop.fs.Path(path))


def copy_as_tsv(frame: DataFrame, dataset: str, sheet: str, extras: dict[str, str] | None = None, most: int = INLINE_ROWS) -> str:
    """A table for the clipboard: what it is and when it was made, then header and rows, cells parted by tabs.

    Tabs and line ends inside cells become blanks. Tables of more than ``most`` rows are refused.
    """
    rows = sanitise(frame).limit(most + 1).collect()
    if len(rows) > most:
        raise TooLarge(f"More than {most:,} rows are no table to copy; write CSV")
    flat = lambda v: "" if v is None else re.sub(r"[\t\r\n]+", " ", str(v))
    told = {"Dataset": dataset, "Sheet": sheet, "Rows": f"{len(rows):,}", **(extras or {}), "Generated": f"{datetime.datetime.now():%Y-%m-%d %H:%M}"}
    lines = [f"{k}\t{flat(v)}" for k, v in told.items()] + ["", "\t".join(frame.columns)]
    return "\n".join(lines + ["\t".join(map(flat, r)) for r in rows]) + "\n"


def sidecar_path(path: str) -> str:
    return f"{os.path.splitext(path)[0]}_ExtractInfo.txt"


def write_extract(
    frame: DataFrame, path: str, plan: Plan, pick: Selection, date_column: str, source: str | None = None,
    partial: list[str] = (), progress=None, cancelled=None, split: bool = False,
) -> str:
    """Write an extract as CSV with a note beside it, or as a workbook with a second sheet.

    An empty extract and one that a sheet cannot hold are refused, never cut; with ``split`` the rows beyond a
    sheet go on in further ones, called ``Extract (2)`` and so on, to be read by ``loader.read_split``. A
    failed or cancelled workbook leaves no file; a note that cannot be written is no failure.
    """
    if not plan.rows:
        raise ValueError("No rows match the selection")
    info = provenance(plan, date_column, pick, source, partial)
    if path.lower().endswith(".csv"):
        write_csv(frame, path)
        try:
            with open(sidecar_path(path), "w", encoding="utf-8") as f:
                f.writelines(f"{k}: {v}\n" for k, v in info)
        except OSError:
            pass
        return path
    if plan.exceeds_sheet and not split:
        raise TooLarge(f"{plan.rows:,} rows are more than the {SHEET_ROWS - 1:,} a sheet holds")
    clean = sanitise(frame)
    sheets = frame_sheets("Extract", clean) if split else [frame_sheet("Extract", clean)]
    write_workbook(path, [*sheets, ("Extract Info", ["Item", "Value"], iter(info))], progress, cancelled)
    return path


def table_name(label: str, used: set[str]) -> str:
    """A table name that workbooks accept and that is not in use, whatever the case."""
    base = "tbl_" + re.sub(r"\W+", "_", label).strip("_")[:200]
    name, n = base, 1
    while name.casefold() in used:
        n += 1
        name = f"{base}_{n}"
    used.add(name.casefold())
    return name


def report_tables(ctx: AuditContext, runs: list[language.LanguageRun] = ()) -> dict[str, DataFrame]:
    """The tables of a report by sheet name; each is a small aggregate."""
    from ledgerline.operators import completeness

    ctx = ctx.snapshot()
    df, out = ctx.df, {"Findings": register.findings(ctx, runs)}
    out["Summary"] = register.summary_table(ctx)
    out["Column check"] = register.column_check_table(ctx)
    out["Column health"] = completeness.column_health(df, ctx.roles, ctx.config.null_threshold)
    out["Nulls"] = register.null_table(completeness.null_profile(df, ctx.config.null_threshold))
    out["Logic checks"] = logic.rule_results(logic.logic_counts(ctx))
    if ctx.column(STATE):
        out["State values"] = vocabulary.state_table(vocabulary.check_state_values(df, ctx.column(STATE)))
    quality = register.description_table(ctx)
    if quality is not None:
        out["Description quality"] = quality
    for _, column in ctx.roles.descriptions:
        out[f"Recurring {column}"] = descriptions.recurring_table(descriptions.recurring_issues(df, column, ctx.column(ID)), column)
    created = ctx.time(CREATED)
    if created is not None:
        out["Monthly inflow"] = aggregates.monthly_inflow(df, created)
    columns = aggregates.pivot_columns(df, ctx.column(ID))
    out["Distributions"] = aggregates.distributions(df, columns).orderBy("position", "rank")
    cube, dims, _ = aggregates.pivot_cube(df, columns)
    if cube is not None:
        out["Pivot cube"] = cube
        for d in dims:
            out[f"Pivot {d}"] = aggregates.native_pivot(cube, d).drop("level")
    for role in (PRIORITY, STATE):
        if ctx.column(role):
            out[f"{role.split('/')[0]} mix"] = aggregates.dimension_mix(aggregates.value_counts(df, ctx.column(role)))
    if runs:
        out["Language summary"] = language.language_summary(df.sparkSession, list(runs))
    return out


def write_report(ctx: AuditContext, path: str, runs: list[language.LanguageRun] = (), inline: int = INLINE_ROWS) -> list[str]:
    """A workbook of the report tables; what had to be left out or cut is listed on its last sheet and returned.

    The detail goes into the workbook up to ``inline`` rows, into a CSV beside it above that.
    """
    told: list[str] = []
    ctx = ctx.snapshot()
    sheets, used = [], set()
    for name, build in report_tables(ctx, runs).items():
        title = re.sub(r"[\[\]:*?/\\]", " ", name)[:31]
        while title in used:
            title = f"{title[:28]} {len(used)}"
        used.add(title)
        try:
            sheets.append(frame_sheet(title, sanitise(build)))
        except TooLarge as e:
            told.append(f"{name}: {e}")
    detail = register.ticket_detail(ctx, runs).drop("_row_id")
    rows = ctx.counts["rows"]
    if rows <= inline:
        sheets.append(frame_sheet("Ticket detail", sanitise(detail)))
    else:
        beside = f"{os.path.splitext(path)[0]}_detail.csv"
        write_csv(detail, beside)
        told.append(f"Ticket detail: {rows:,} rows are in {os.path.basename(beside)}")
    sheets.append(("Notes", ["Note"], iter([(t,) for t in told])))
    write_workbook(path, sheets)
    return told
