"""The findings register, the detail table and the tables beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.config import FLAG_LABELS, PASS_MARK, RESULT_ORDER, ROLE_KEYWORDS, SEVERITY_ORDER
from ledgerline.functions import dates, state
from ledgerline.functions.text import quoted
from ledgerline.operators import calendar, completeness, descriptions, language, logic, vocabulary
from ledgerline.operators.logic import AuditContext
from ledgerline.operators.roles import CLOSED, CREATED, ID, PRIORITY, STATE

# Areas, names and severities of checks below are fixed values of the report; their details are worded here.
SCHEMA = "Area string, Check string, Severity string, Rows long, Detail string, Result string"


class Register:
    """Findings as they are added: no count is not checked, zero passes, else fails."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, area: str, check: str, severity: str, count: int | None, detail: str, result: str | None = None) -> None:
        result = result or ("Not checked" if count is None else "Fail" if count else "Pass")
        self.rows.append((area, check, "-" if result == "Pass" else severity, count, detail, result))

    def frame(self, spark) -> DataFrame:
        made = spark.createDataFrame(self.rows, SCHEMA).withColumnRenamed("Rows", "Rows Affected")
        return ordered(made)


def ordered(register: DataFrame) -> DataFrame:
    """Failures first, then what was not checked, to review, passed; by severity and area within."""
    place = lambda column, order: F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return register.orderBy(place("Result", RESULT_ORDER), place("Severity", SEVERITY_ORDER), "Area", "Check")


def findings(ctx: AuditContext, runs: list[language.LanguageRun] = ()) -> DataFrame:
    """Every check as a row. Counts come from the checks' own aggregates; only those small rows reach the driver.

    The table is worked out once: nulls and rules are counted while ``AuditContext.snapshot`` writes
    it, the other checks read its columns from there. To share that with ``ticket_detail``, pass both the snapshot.
    """
    ctx = ctx.snapshot()
    out, cfg, df, counts = Register(), ctx.config, ctx.df, ctx.counts
    for role in ctx.roles.missing:
        out.add("Structure", f"Required column: {role}", "Critical", 1, "No column of the file matches this requirement")
    if not ctx.roles.missing:
        out.add("Structure", "Required columns", "Critical", 0, f"All {len(ROLE_KEYWORDS)} required columns matched")

    nulls = sorted((r for r in counts["cells"] if r["null_pct"] > cfg.null_threshold), key=lambda r: (-r["null_pct"], r["position"]))
    for r in nulls:
        out.add("Completeness", f"Nulls in {r['column']}", "High", r["nulls"], f"{r['null_pct']}% null, over the {cfg.null_threshold:g}% threshold")
    if not nulls:
        out.add("Completeness", "Null thresholds", "High", 0, f"No column exceeds {cfg.null_threshold:g}% null")

    _logic(ctx, out, counts)
    for info in calendar.check_date_formats(ctx):
        name = f"Date format of {info['column']}"
        if info["conflicting"]:
            out.add("Structure", name, "Critical", info["total"],
                    f"Field orders are mixed: {info['day_first']} values can only be DD/MM, {info['month_first']} only MM/DD")
        elif info["needs_confirmation"]:
            out.add("Structure", name, "Critical", info["ambiguous"],
                    f"{info['ambiguous']} of {info['total']} values can be read either way (e.g. {', '.join(info['examples'])}); "
                    f"the other reading changes {info['rows_that_would_change']:,} rows", "Review")

    id_column = ctx.column(ID)
    if id_column:
        surplus = logic.duplicate_summary(df, id_column).first()["surplus"]
        out.add("Uniqueness", "Duplicate tickets", "High", surplus, f"Surplus rows sharing a {id_column} value")
    else:
        out.add("Uniqueness", "Duplicate tickets", "High", None, "No id column was found")

    if not ctx.roles.descriptions:
        out.add("Text quality", "Description quality", "Medium", None, "No description column was found")
    for _, column in ctx.roles.descriptions:
        _described(ctx, out, column)

    if not runs:
        out.add("Language", "Non-English content", "Medium", None, "No language analysis has been run")
    for run in runs:
        check = f"Non-English in {run.column}"
        told = language.outcome(run).first() if run.rows is not None else None
        if told is None:
            out.add("Language", check, "Medium", None, run.error or run.warning)
        elif not told["total_analyzed"]:
            out.add("Language", check, "Medium", None, "No text long enough to analyse")
        else:
            names = ", ".join(sorted(r["lang"] for r in told["languages"])) or "none"
            out.add("Language", check, "Medium", told["non_english_count"], f"{told['percentage']}% of analysed rows ({names}), via {run.label}")
    return out.frame(df.sparkSession)


def _logic(ctx: AuditContext, out: Register, counts) -> None:
    """Rows of the logic rules; a group of rules whose roles are missing is one row that says so."""
    created, closed, status, priority = (ctx.column(r) for r in (CREATED, CLOSED, STATE, PRIORITY))
    if created and closed:
        out.add("Logic", "Date sequence", "Critical", counts["closed_before_created"], f"{closed} earlier than {created}")
        out.add("Logic", "Future dates", "Medium", counts["future_created"], f"{created} in the future")
        out.add("Logic", "Future dates", "Medium", counts["future_closed"], f"{closed} in the future")
    else:
        for check, severity in (("Date sequence", "Critical"), ("Future dates", "Medium")):
            out.add("Logic", check, severity, None, "Not checked - no date columns found")
    missing = "Not checked - no state column" if not status else None
    if status and closed:
        out.add("Logic", "State / resolution", "High", counts["closed_no_date"], f"Closed in {status} but no {closed}")
        out.add("Logic", "State / resolution", "High", counts["open_with_date"], f"Open in {status} but {closed} is set")
    else:
        out.add("Logic", "State / resolution", "High", None, missing or "Not checked - no closed date column")
    if status and priority:
        out.add("Logic", "Open ticket priority", "Medium", counts["open_missing_priority"], f"Open in {status} with no {priority}")
    else:
        out.add("Logic", "Open ticket priority", "Medium", None, missing or "Not checked - no priority column")
    if status:
        n = counts["unclassified_count"]
        out.add("Logic", "State classification", "Low", n, f"{status} value read as neither open nor closed", "Review" if n else None)
        suspects = vocabulary.suspect_rows(vocabulary.check_state_values(ctx.df, status)).first()[0]
        out.add("Logic", "State vocabulary", "Medium", suspects, "Non-standard or rare state values")


def _described(ctx: AuditContext, out: Register, column: str) -> None:
    low, high = ctx.config.desc_min_length, ctx.config.desc_max_length
    q = descriptions.quality_summary(descriptions.measured(ctx.df, column, low, high), low, high).first()
    out.add("Text quality", f"Empty {column}", "High", q["empty"], f"{q['empty_pct']}% of rows have no {column}")
    out.add("Text quality", f"{column} under {low} chars", "Medium", q["too_short"], f"{q['too_short_pct']}% too brief to analyse")
    out.add("Text quality", f"{column} over {high} chars", "Low", q["too_long"], f"{q['too_long_pct']}% too long to review")
    below = q["critical"] + q["poor"] + q["fair"]
    out.add("Text quality", f"{column} quality score", "Medium", below, f"Field scores {q['overall_score']}/100; {below:,} rows below Good",
            "Pass" if q["overall_score"] >= PASS_MARK else "Review")
    rep = descriptions.repetition_summary(ctx.df, column).first()
    if rep["exact_group_count"]:
        out.add("Text quality", f"Recurring issues in {column}", "Low", rep["exact_repeated_rows"],
                f"{rep['exact_group_count']} issues repeat across {rep['exact_repeated_pct']}% of rows", "Review")


def by_result(register: DataFrame, result: str | None = None) -> DataFrame:
    """The register, or one outcome of it."""
    return register if result in (None, "All") else register.filter(F.col("Result") == result)


def kpis(ctx: AuditContext, register: DataFrame) -> DataFrame:
    """One row: rows, failed and unchecked findings, surplus duplicate rows, missing roles."""
    duplicate = (F.col("Area") == "Uniqueness") & (F.col("Result") == "Fail")
    rows = ctx.df.agg(F.count(F.lit(1))).scalar()
    return register.agg(
        F.count_if(F.col("Result") == "Fail").alias("checks_failed"), F.count_if(F.col("Result") == "Not checked").alias("not_checked"),
        F.coalesce(F.sum(F.when(duplicate, F.col("Rows Affected"))), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("Check").startswith("Required column:")).alias("missing_roles"),
    ).withColumn("rows", rows)


def summary(ctx: AuditContext) -> dict:
    """Missing roles, high-null columns, duplicates and date issues, with a sentence for each."""
    high = [r["column"] for r in completeness.null_profile(ctx.df, ctx.config.null_threshold).filter("above_threshold").orderBy("position").collect()]
    id_column = ctx.column(ID)
    surplus = logic.duplicate_summary(ctx.df, id_column).first()["surplus"] if id_column else 0
    found, missing = logic.check_date_logic(ctx)["issues"], ctx.roles.missing
    issues = [f"{len(missing)} missing required columns"] if missing else []
    issues += [f"{len(high)} columns exceed {ctx.config.null_threshold:g}% null threshold"] if high else []
    issues += [f"{surplus} duplicate records found"] if surplus else []
    issues += found
    return {
        "total_rows": ctx.df.count(), "total_columns": len(completeness.data_columns(ctx.df)), "missing_columns": missing,
        "high_null_columns": high, "duplicate_count": surplus, "date_issues": found, "issues": issues, "has_issues": bool(issues),
    }


def summary_table(ctx: AuditContext) -> DataFrame:
    s = summary(ctx)
    rows = [
        ("Total Rows", str(s["total_rows"])), ("Total Columns", str(s["total_columns"])),
        ("Missing Required Columns", str(len(s["missing_columns"]))), ("High Null Columns", str(len(s["high_null_columns"]))),
        ("Duplicate Count", str(s["duplicate_count"])), ("Date Issues", str(len(s["date_issues"]))),
        ("Overall Status", "Issues Found" if s["has_issues"] else "OK"),
    ]
    return ctx.df.sparkSession.createDataFrame(rows, "Metric string, Value string")


def column_check_table(ctx: AuditContext) -> DataFrame:
    rows = [(r, "Found" if ctx.roles.ranked.get(r) else "Missing", ", ".join(ctx.roles.ranked.get(r, []))) for r in ROLE_KEYWORDS]
    return ctx.df.sparkSession.createDataFrame(rows, "`Required Column` string, Status string, `Matched Columns` string")


def null_table(profile: DataFrame) -> DataFrame:
    return profile.orderBy(F.desc("null_pct"), "position").select(
        F.col("column").alias("Column"), F.col("nulls").alias("Null Count"), F.col("null_pct").alias("Null %"),
        F.when(F.col("above_threshold"), "Yes").otherwise("No").alias("Above Threshold"),
    )


def description_table(ctx: AuditContext) -> DataFrame | None:
    low, high = ctx.config.desc_min_length, ctx.config.desc_max_length
    out = None
    for role, column in ctx.roles.descriptions:
        q = descriptions.quality_summary(descriptions.measured(ctx.df, column, low, high), low, high)
        row = q.select(
            F.lit(role).alias("Field"), F.lit(column).alias("Column"), F.col("total").alias("Total Rows"), F.col("empty").alias("Empty"),
            F.col("empty_pct").alias("Empty %"), F.col("too_short").alias(f"Under {low} chars"), F.col("too_short_pct").alias("Too Short %"),
            F.col("too_long").alias(f"Over {high} chars"), F.col("too_long_pct").alias("Too Long %"), F.col("min_length").alias("Min Length"),
            F.col("avg_length").alias("Avg Length"), F.col("median_length").alias("Median Length"), F.col("max_length").alias("Max Length"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def ticket_detail(ctx: AuditContext, runs: list[language.LanguageRun] = ()) -> DataFrame:
    """Every row with all its columns and what the checks say of it, in words."""
    df, roles = ctx.df, ctx.roles
    flags, _ = logic.row_flags(ctx)
    created, closed, status = ctx.time(CREATED), ctx.time(CLOSED), ctx.value(STATE)
    added = {}
    if created is not None and closed is not None:
        added["Resolution Days"] = dates.resolution_days(created, closed)
    if status is not None:
        added["State Reads As"] = state.reads_as(status)
    for flag, label in FLAG_LABELS.items():
        added[label] = F.when(flags[flag], "Yes").otherwise("No") if flag in flags else F.lit("Not checked")
    if flags:
        total = F.lit(0)
        for c in flags.values():
            total = total + c.cast("int")
        said = F.concat_ws(", ", *[F.when(flags[f], label) for f, label in FLAG_LABELS.items() if f in flags])
        added["QA Flag Count"], added["QA Findings"] = total, F.when(said == "", "None").otherwise(said)
    else:
        added["QA Flag Count"], added["QA Findings"] = F.lit(0), F.lit("Not checked")
    out = df.withColumns(added)
    if ctx.column(ID):
        marked = logic.with_id_occurrences(out, ctx.column(ID))
        out = marked.withColumn("Duplicate ID", F.when(F.col("is_duplicate"), "Yes").otherwise("No")).withColumnRenamed("id_occurrences", "ID Occurrences").drop("is_duplicate")
    for _, column in roles.descriptions:
        out = descriptions.row_scores(out, column, ctx.config.desc_min_length, ctx.config.desc_max_length)
    for run in runs:
        if run.error:
            continue
        if run.rows is None:
            out = out.withColumn(f"{run.column} Language", F.lit("Not checked"))
        else:
            said = run.rows.select("_row_id", language.row_language(run).alias(f"{run.column} Language"))
            out = out.join(said, "_row_id", "left")
    return out


def view_rows(df: DataFrame, rows: int = 1000) -> DataFrame:
    """The first rows in file order."""
    return df.orderBy("_row_id").limit(rows).select(*[F.col(quoted(f.name)) for f in completeness.data_columns(df)])
