"""Text reports from collected small tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ledgerline.functions import dates
from ledgerline.operators import aggregates, calendar, completeness, descriptions, language, logic, register, vocabulary
from ledgerline.operators.logic import AuditContext
from ledgerline.operators.roles import CREATED, ID, STATE


def _section(title: str, lines: list[str]) -> list[str]:
    return ["", title.upper(), "-" * len(title), *(lines or ["Nothing to report"])]


def text_report(ctx: AuditContext, source: str | None = None, runs: list[language.LanguageRun] = ()) -> str:
    """The full report: nine sections in fixed order; what could not run says so."""
    df, cfg = ctx.df, ctx.config
    out = ["DATA QUALITY REPORT", f"File: {source or 'not known'}", f"As of: {ctx.as_of:%Y-%m-%d %H:%M}"]
    out += _section("Column check", [
        f"[{'OK' if ctx.roles.ranked.get(r) else 'MISSING'}] {r}: {', '.join(ctx.roles.ranked.get(r, [])) or '-'}" for r in register.ROLE_KEYWORDS
    ])
    high = completeness.null_profile(df, cfg.null_threshold).filter("above_threshold").orderBy(F.desc("null_pct"), "position").collect()
    out += _section("Null analysis", [f"{r['column']}: {r['nulls']:,} null ({r['null_pct']}%)" for r in high]
                    or [f"No column exceeds {cfg.null_threshold:g}% null"])
    formats = calendar.check_date_formats(ctx)
    out += _section("Date formats", [
        f"{i['column']}: {i['date_order']}, {i['ambiguous']} of {i['total']} values ambiguous, {i['rows_that_would_change']:,} rows depend on it" for i in formats
    ])
    issues = logic.check_date_logic(ctx)["issues"]
    out += _section("Date logic", issues or ["No date issues found"])
    rules = logic.rule_results(logic.logic_counts(ctx)).orderBy("position").collect()
    out += _section("Cross-field logic", [
        f"[{r['result']}] {r['check']} ({r['rule']}): {'not checked' if r['rows_affected'] is None else format(r['rows_affected'], ',')}" for r in rules[3:]
    ])
    id_column = ctx.column(ID)
    if id_column:
        d = logic.duplicate_summary(df, id_column).first()
        lines = [f"{d['surplus']:,} surplus rows, {d['ids_affected']:,} ids affected, {d['rows_involved']:,} rows involved"]
    else:
        lines = ["Not checked - no id column was found"]
    out += _section("Duplicates", lines)
    out += _section("Language", [line for run in runs for line in language.format_result(run)] or ["Not checked - no language analysis has been run"])
    lines = []
    for column, counts in aggregates.text_distributions(df).items():
        lines += [f"{column}:", *(f"  {r['value']}: {r['count']:,} ({r['pct']}%)" for r in counts.collect())]
    out += _section("Distributions", lines)
    s = register.summary(ctx)
    out += _section("Summary", [f"Rows: {s['total_rows']:,}", f"Columns: {s['total_columns']}", *(s["issues"] or ["No issues found"])])
    return "\n".join(out) + "\n"


def summary_report(ctx: AuditContext, source: str | None = None, runs: list[language.LanguageRun] = ()) -> str:
    """A letter to the owner of the data: what is critical, what to look at, what passed, what to do."""
    found = register.findings(ctx, runs).collect()
    groups = {
        "Critical issues": [r for r in found if r["Result"] == "Fail" and r["Severity"] in ("Critical", "High")],
        "Warnings": [r for r in found if (r["Result"] == "Fail" and r["Severity"] in ("Medium", "Low")) or r["Result"] == "Review"],
        "Not checked": [r for r in found if r["Result"] == "Not checked"],
        "Passed": [r for r in found if r["Result"] == "Pass"],
    }
    out = [f"Subject: Data quality summary - {source or 'ticket extract'}", "", f"Prepared {datetime.date.today():%d %b %Y} over {ctx.df.count():,} rows."]
    for title, rows in groups.items():
        out += ["", f"{title} ({len(rows)})"]
        for i, r in enumerate(rows, 1):
            n = "" if r["Rows Affected"] is None else f" - {r['Rows Affected']:,} rows" if r["Rows Affected"] else ""
            out.append(f"{i}. {r['Check']}{n}: {r['Detail']}")
    created = ctx.time(CREATED)
    if created is not None:
        partial = calendar.partial_months(calendar.month_coverage(ctx.df, created)).collect()
        if partial:
            out += ["", "Incomplete months", *(f"- {calendar.describe(r.asDict())}" for r in partial)]
    actions = []
    for r in groups["Critical issues"]:
        actions.append(f"Correct or explain: {r['Check']}")
    for r in groups["Not checked"]:
        actions.append(f"Provide what is missing for: {r['Check']}")
    out += ["", "Requested actions", *(f"{i}. {a}" for i, a in enumerate(dict.fromkeys(actions), 1))] if actions else ["", "No action is needed."]
    return "\n".join(out) + "\n"


def period_text(ctx: AuditContext) -> str:
    """The months that the created dates span."""
    created = ctx.time(CREATED)
    if created is None:
        return "no created dates"
    row = ctx.df.agg(F.min(dates.month_text(created)).alias("a"), F.max(dates.month_text(created)).alias("b")).first()
    return dates.range_label(row["a"] or "", row["b"] or "")


def state_lines(ctx: AuditContext) -> list[str]:
    """Suspect state values in words."""
    if not ctx.column(STATE):
        return ["Not checked - no state column"]
    checked = vocabulary.check_state_values(ctx.df, ctx.column(STATE)).filter("reason is not null").collect()
    return [f"{r['value']} ({r['count']:,} rows): {r['reason']}" for r in checked]


def recurring_lines(ctx: AuditContext, top: int = 5) -> list[str]:
    lines = []
    for _, column in ctx.roles.descriptions:
        for r in descriptions.recurring_issues(ctx.df, column, ctx.column(ID), top, similar=False).collect():
            lines.append(f"{column}: {r['count']:,} tickets, e.g. {', '.join(r['sample_ids'])}: {r['text'][:90]}")
    return lines
