"""Audit operators on small frames with answers counted by hand."""

import datetime
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerline.config import ABSENT, STOP_WORDS, AuditConfig, ConfigStore
from ledgerline.functions import dates, state
from ledgerline.functions import text as X
from ledgerline.operators import (
    aggregates, calendar, completeness, descriptions, extract, language, logic, register, report, roles, vocabulary,
)
from ledgerline.operators.logic import AuditContext
from ledgerline.operators.roles import bind_roles, name_score
from ledgerline.plans.components import connected_components
from ledgerline.plans.groups import with_group_count

NAMES = ["number", "assignment_group", "cmdb_ci", "priority", "state", "opened_at", "resolved_at", "short_description", "description"]
DAY = datetime.datetime
AS_OF = DAY(2025, 1, 1)


def tickets(spark, rows, **types):
    """Rows of dicts over the nine ticket columns, numbered in order."""
    schema = ", ".join(f"{n} {types.get(n, 'timestamp_ntz' if n in ('opened_at', 'resolved_at') else 'string')}" for n in NAMES)
    base = {
        "assignment_group": "Desk", "cmdb_ci": "Mail", "priority": "P2", "state": "Closed", "opened_at": DAY(2024, 3, 5), "resolved_at": DAY(2024, 3, 8),
        "short_description": "Printer on floor two is out of toner again", "description": "The printer near the kitchen shows an empty toner light since this morning",
    }
    full = [{"number": f"INC{i + 1:04d}"} | base | r for i, r in enumerate(rows)]
    return spark.createDataFrame([(*(r[n] for n in NAMES), i) for i, r in enumerate(full)], f"{schema}, _row_id long")


def context(spark, rows, config=None, **types):
    return AuditContext.open(tickets(spark, rows, **types), config, AS_OF)


def values(spark, items, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"_row_id long, v {kind}")


def column(df, name="v"):
    return [r[name] for r in df.orderBy("_row_id").collect()]


# State, text, dates


def test_state_classes(spark):
    closed = ["Closed", "CLOSED", "Closed Complete", "Resolved", "Cancelled", "Completed", "Resolved Pending Closure"]
    active = ["New", "In Progress", "On Hold", "Awaiting User Info", "Reopened"]
    other = ["Stage 7", "", None, "nan", "<NA>"]
    got = column(values(spark, closed + active + other).withColumn("v", state.classify(F.col("v"))))
    assert got == ["terminal"] * 7 + ["active"] * 5 + ["unknown"] * 5


def test_cancelled_states(spark):
    ctx = context(spark, [{"state": s} for s in ["Cancelled", "CANCELED", "Cancel", "Request cancelled", "cancelled ", "Closed/Cancelled", "Closed", None]])
    assert logic.cancelled_states(ctx)["rows"] == 6
    ctx = context(spark, [{"state": s} for s in ["Withdrawn", "Rejected", "Abandoned", "Void", "Cancelled"]])
    assert logic.cancelled_states(ctx)["values"] == ["Cancelled"]


def test_blank_and_fold(spark):
    df = values(spark, [None, "", "   ", "\t\u00a0\n", "x", " Ä b\u2003"])
    assert column(df.withColumn("v", X.is_blank(F.col("v")))) == [True, True, True, True, False, False]
    assert column(df.withColumn("v", X.fold(F.col("v")))) == ["", "", "", "", "x", "ä b"]


def test_cleaning(spark):
    texts = {
        "Fixed INC0012345 and chg99 today": "Fixed and today",
        "mail me@example.com or https://a.b/c?d": "mail or",
        r"see C:\temp\log.txt and /var/log/app.log now": "see and now",
        "[URGENT_1] sap on 2024-01-02 with 17 users": "on with users",
        "Größe 5 für INC5é": "Größe für INC5é",
        "code AB12X 99ZZ9 text": "code text",
    }
    for form in (X.clean, X.clean_flat):
        assert column(values(spark, list(texts)).withColumn("v", form(F.col("v")))) == list(texts.values())


def test_normalising_joins_numbered_texts(spark):
    got = column(values(spark, ["Backup fails every 5 minutes!", "backup fails every 30 minutes", None, "ÄÖ"]).withColumn("v", X.normalise(F.col("v"))))
    assert got == ["backup fails every minutes", "backup fails every minutes", "", ""]


def test_text_dates(spark):
    items = ["05/03/2024", "13/04/2024", "04/13/2024", "2024-03-05", "2024-03-05T10:00:00+05:30", "5.3.24 7:08", "31/02/2024", "soon", None]
    day = column(values(spark, items).withColumn("v", dates.parse(F.col("v"), spark.createDataFrame([], "v string").schema["v"].dataType, True)))
    assert day == [DAY(2024, 3, 5), DAY(2024, 4, 13), DAY(2024, 4, 13), DAY(2024, 3, 5), DAY(2024, 3, 5, 10), DAY(2024, 3, 5, 7, 8), None, None, None]
    month = column(values(spark, items[:1]).withColumn("v", dates.parse(F.col("v"), spark.createDataFrame([], "v string").schema["v"].dataType, False)))
    assert month == [DAY(2024, 5, 3)]


@pytest.mark.parametrize(("items", "order"), [
    (["13/01/2024", "03/04/2024"], "day_first"), (["01/13/2024", "04/03/2024"], "month_first"), (["05/03/2024", "02/04/2024", "10/05/2024"], "ambiguous"),
    (["13/01/2024", "01/13/2024"], "conflicting"), (["2024-01-02", "2023/11/30"], "iso"), (["soon", None], "not_numeric"),
])
def test_date_order(spark, items, order):
    assert calendar.date_order(values(spark, items), "v").first()["date_order"] == order


def test_month_labels():
    assert dates.month_label("2025-02") == "Feb-25"
    assert dates.range_label("2025-02", "2026-07") == "Feb-25 to Jul-26" and dates.range_label("", "") == "all dates"
    assert dates.months_label(["2026-05", "2026-02", "2026-07"]) == "Feb-26, May-26 and Jul-26"
    assert dates.months_label(["2026-01", "2026-02"]) == "Jan-26 to Feb-26" and dates.months_label([]) == "no months"
    assert dates.months_label([f"2026-{m:02d}" for m in (1, 3, 5, 7, 9)]) == "5 selected months between Jan-26 and Sep-26"
    assert not dates.is_contiguous([]) and dates.is_contiguous(["2025-12", "2026-01"])


# Roles


def test_scores_of_names():
    assert [name_score("Priority", n) for n in ("priority", "my_priority", "Priority Code", "x_priority_y", "prior")] == [100, 80, 70, 50, 0]


def test_roles_of_a_ticket_file(spark):
    r = bind_roles(tickets(spark, [{}]))
    assert not r.missing and r.created == "opened_at" and r.closed == "resolved_at"
    assert [c for _, c in r.descriptions] == ["short_description", "description"]


def test_ties_keep_file_order_and_overrides_win(spark):
    df = spark.createDataFrame([("INC1", "1", "2", "x")], "number string, urgency string, impact string, notes string")
    assert bind_roles(df).get("Priority") == "urgency"
    r = bind_roles(df, {"Priority": "impact", "Created": "nowhere", "Colour": "notes", "Description": ABSENT})
    assert r.get("Priority") == "impact" and len(r.ignored) == 2 and r.get("Description") is None
    assert roles.column_choices(r)["Priority"]["alternatives"] == [("urgency", 130)]
    table = {x["role"]: x for x in roles.check_columns(df, r).collect()}
    assert table["Priority"]["overridden"] and not table["Closed"]["found"]
    assert roles.unused_columns(df, r) == ["urgency", "notes"]


def test_ids_found_by_value_and_dates_by_name(spark):
    df = spark.createDataFrame([("RITM001", "2024-01-02", "bob"), ("RITM002", "2024-01-03", "eve")], "key string, whencreated string, createdbyuser string")
    r = bind_roles(df)
    assert r.get("Ticket Identification") == "key" and r.created == "whencreated"
    assert bind_roles(df, {"Created": ABSENT}).created is None


# Logic


MESSY = (
    [{"state": "Closed", "resolved_at": None}] * 2 + [{"state": "Closed"}] * 38
    + [{"state": "New", "resolved_at": None}] * 15 + [{"state": "New", "resolved_at": None, "priority": None}, {"state": "New", "resolved_at": None}, {"state": "New"}]
    + [{"state": "Closd", "priority": None}, {"state": "Stage 9", "priority": " ", "resolved_at": None}]
)


def test_logic_counts(spark):
    row = logic.logic_counts(context(spark, MESSY)).first()
    assert (row["closed_no_date"], row["open_with_date"], row["open_missing_priority"]) == (2, 1, 1)
    assert (row["open_count"], row["closed_count"], row["unclassified_count"]) == (18, 40, 2)
    assert row["open_count"] + row["closed_count"] + row["unclassified_count"] == row["rows"] == 60
    assert row["rows_flagged"] == 4 and row["issues_total"] == 4


def test_date_rules(spark):
    rows = [{"opened_at": DAY(2024, 5, 1), "resolved_at": DAY(2024, 4, 1)}, {"opened_at": DAY(2099, 1, 1), "resolved_at": DAY(2099, 1, 2)}, {"opened_at": None}]
    row = logic.logic_counts(context(spark, rows)).first()
    assert (row["closed_before_created"], row["future_created"], row["future_closed"]) == (1, 1, 1)
    assert len(logic.check_date_logic(context(spark, rows))["issues"]) == 3


def test_rules_without_columns_are_not_checked(spark):
    ctx = AuditContext.open(tickets(spark, [{}]).drop("state", "resolved_at"), as_of=AS_OF)
    flags, skipped = logic.row_flags(ctx)
    assert list(flags) == ["future_created"] and len(skipped) == 5
    got = {r["rule"]: r["result"] for r in logic.rule_results(logic.logic_counts(ctx)).collect()}
    assert got["future_created"] == "Pass" and got["closed_no_date"] == "Not checked" and got["unclassified_count"] == "Not checked"
    assert logic.check_date_logic(ctx)["has_date_columns"] is False
    found = {r["Check"]: r["Result"] for r in register.findings(ctx).collect()}
    assert found["Date sequence"] == found["State / resolution"] == "Not checked" and "State vocabulary" not in found


def test_text_date_order_changes_resolution(spark):
    rows = [{"opened_at": "05/03/2024", "resolved_at": "08/03/2024"}, {"opened_at": "02/04/2024", "resolved_at": "09/04/2024"}]
    text = {"opened_at": "string", "resolved_at": "string"}
    days = lambda ctx: [r["Resolution Days"] for r in register.ticket_detail(ctx).orderBy("_row_id").collect()]
    ctx = context(spark, rows, **text)
    assert days(ctx) == [92.0, 213.0]
    assert [i["rows_that_would_change"] for i in calendar.check_date_formats(ctx)] == [2, 2]
    assert days(context(spark, rows, AuditConfig(date_dayfirst=True), **text)) == [3.0, 7.0]
    assert {r["Result"] for r in register.findings(ctx).filter("Check like 'Date format%'").collect()} == {"Review"}


def test_evidence_equals_count(spark):
    ctx = context(spark, MESSY)
    row = logic.logic_counts(ctx).first()
    for rule in logic.row_flags(ctx)[0]:
        assert logic.evidence(ctx, rule, ["state"], None).count() == row[rule]


def test_duplicates(spark):
    df = tickets(spark, [{"number": n} for n in ["INC1", "INC1", "INC2", "INC3", "INC3", "INC3", None, None]])
    assert logic.duplicate_summary(df, "number").first()[:] == (3, 2, 5)
    rows = logic.with_id_occurrences(df, "number").orderBy("_row_id").collect()
    assert [r["id_occurrences"] for r in rows] == [2, 2, 1, 3, 3, 3, 0, 0]
    assert [r["is_duplicate"] for r in rows] == [True, True, False, True, True, True, True, True]
    assert logic.duplicate_rows(df, "number").count() == 7
    assert [r["id"] for r in logic.duplicate_ids(df, "number").collect()] == ["INC3", "INC1"]


# Vocabulary


def vocabulary_of(spark, counted):
    df = spark.createDataFrame([(v,) for v, n in counted for _ in range(n)], "s string")
    return {r["value"]: r["reason"] for r in vocabulary.check_state_values(df, "s").collect()}


def test_suspect_states(spark):
    assert vocabulary_of(spark, [("Closed", 59), ("Closd", 1)])["Closd"] == "looks like 'Closed'"
    assert vocabulary_of(spark, [("Closed", 998), ("Xyz", 2)])["Xyz"] == "rare value"
    assert set(vocabulary_of(spark, [("P1", 25), ("P2", 25), ("P3", 10)]).values()) == {None}
    assert set(vocabulary_of(spark, [("Closed", 10), ("New", 9), ("Qqq", 1)]).values()) == {None}
    assert vocabulary_of(spark, [("Closed", 30), ("closed ", 3), (None, 2), (" ", 2)]) == {"Closed": None, "closed ": "looks like 'Closed'"}


def test_near_duplicates_match_brute_force(spark, sf):
    from ledgerline.plans import catalogue

    got = {r["value"]: r["looks_like"] for r in catalogue.queries()["near_duplicates"](spark, "/root/testdata/sf0.01").collect()}
    counts = {r["value"]: r["count"] for r in catalogue.queries()["state_vocabulary"](spark, "/root/testdata/sf0.01").collect()}
    for value, n in counts.items():
        better = sorted((v for v in counts if counts[v] > n), key=lambda v: (-counts[v], v))
        want = next((v for v in better if SequenceMatcher(None, value.lower(), v.lower()).ratio() >= 0.85), None)
        assert got[value] == want


def test_vocabularies_of_any_size_match_brute_force(spark):
    rng, letters = random.Random(4), "aabcdeeé -1"
    words = list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randint(1, 14))).strip() or "x" for _ in range(500)))
    words += [w + "x" for w in words[::5]] + [w.upper() + " " for w in words[::9] if w.upper() != w] + [w[1:] + w[:1] for w in words[::7] if len(w) > 3]
    counts = {w: rng.randint(1, 40) for w in dict.fromkeys(words) if w.strip()}
    values_ = spark.createDataFrame(list(counts.items()), "value string, count long")
    got = {r["value"]: r["looks_like"] for r in vocabulary.near_duplicates(values_, limit=None).collect()}
    ranked, want = sorted(counts, key=lambda v: (-counts[v], v)), {}
    for value, n in counts.items():
        for v in ranked:
            if counts[v] <= n:
                break
            m = SequenceMatcher(None, value.strip().lower(), v.strip().lower())
            if m.real_quick_ratio() >= 0.85 and m.quick_ratio() >= 0.85 and m.ratio() >= 0.85:
                want[value] = v
                break
    assert got == want and len(want) > 50
    assert vocabulary.near_duplicates(values_.limit(0), limit=None).count() == 0


def test_large_vocabularies_are_left_alone(spark):
    values_ = spark.range(300).select(F.concat(F.lit("value number "), F.col("id")).alias("value"), F.col("id").alias("count"))
    assert vocabulary.near_duplicates(values_).count() == 0


# Months


def coverage(spark, days):
    df = spark.createDataFrame([(d,) for d in days], "ts timestamp_ntz")
    return {r["month"]: r.asDict() for r in calendar.month_coverage(df, F.col("ts")).collect()}


def span(first, last):
    return [first + datetime.timedelta(days=i) for i in range((last - first).days + 1)]


def test_month_coverage(spark):
    got = coverage(spark, [*span(DAY(2026, 6, 1), DAY(2026, 8, 12)), None])
    assert [m["partial"] for m in got.values()] == [False, False, True]
    assert got["2026-08"]["last_day"] == 12 and "day 12 of 31" in calendar.describe(got["2026-08"])
    weekdays = coverage(spark, [d for d in span(DAY(2025, 1, 1), DAY(2025, 3, 31)) if d.weekday() < 5])
    assert not any(m["partial"] for m in weekdays.values())
    feb = coverage(spark, [d for d in span(DAY(2025, 2, 1), DAY(2025, 2, 28)) if not 8 <= d.day <= 19])["2025-02"]
    assert feb["longest_gap"] == 12 and feb["partial"] and feb["interior_gap"]
    april = coverage(spark, [d for d in span(DAY(2025, 4, 1), DAY(2025, 4, 30)) if not 10 <= d.day <= 15])["2025-04"]
    assert april["longest_gap"] == 6 and not april["partial"]
    assert calendar.trim_partial(list(got.values()), "2026-06", "2026-08") == ("2026-06", "2026-07")


def test_extract_plan_equals_build(spark):
    stamps = [DAY(2026, 1, 1) + datetime.timedelta(hours=12 * i) for i in range(240)] + [None] * 6
    df = spark.createDataFrame([(i, d, "Cancelled" if i % 2 else "Closed") for i, d in enumerate(stamps)], "_row_id long, d timestamp_ntz, state string")
    cancelled = state.is_cancelled(F.col("state"))
    for pick in [
        extract.Selection(F.col("d")), extract.Selection(F.col("d"), "2026-02", "2026-03"), extract.Selection(F.col("d"), "2026-03", "2026-02", undated=True),
        extract.Selection(F.col("d"), months=("2026-01", "2026-04"), exclude=cancelled), extract.Selection(F.col("d"), months=()), extract.Selection(F.col("d"), undated=True, exclude=cancelled),
    ]:
        plan = extract.plan_extract(df, pick, ["state", "d"])
        built = extract.build_extract(df, pick, ["state", "d", "nothing"])
        assert plan.rows == built.count() and plan.undated_rows == 6 and built.columns == ["d", "state"]
        assert sum(n for _, n in plan.months) == built.filter("d is not null").count()
    with pytest.raises(ValueError):
        extract.build_extract(df, extract.Selection(F.col("d")), ["nothing"])
    assert [r["_row_id"] for r in extract.build_extract(df.repartition(5), extract.Selection(F.col("d")), ["_row_id"], 3).collect()] == [0, 1, 2]


def test_month_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    out = extract.build_extract(df, extract.Selection(F.col("o_orderdate"), "1996-01", "1996-02"), ["o_orderkey"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderdate" in plan.replace("\n", "")


def test_presets_and_names(spark):
    df = tickets(spark, [{"cmdb_ci": None}]).withColumn("extra", F.lit(""))
    r = bind_roles(df)
    assert extract.preset(df, "none") == [] and "extra" not in extract.preset(df, "standard", r) and len(extract.preset(df, "all")) == 10
    assert extract.preset(df, "non_empty") == [n for n in NAMES if n != "cmdb_ci"] and extract.columns_like(df, "DESC") == NAMES[-2:]
    assert extract.suggest_filename("/a/Ticket dump.xlsx", "opened_at", "2026-01", "2026-03", "csv") == "Ticket_dump_opened_at_2026_01_to_2026_03.csv"
    assert extract.suggest_filename(None, "d", "", "", "xlsx", ["2026-01", "2026-04"]) == "extract_d_2_months_2026_01_to_2026_04.xlsx"


# Completeness and aggregation


def test_null_threshold_is_strict(spark):
    df = spark.createDataFrame([(None, "a", float("nan")), (None, None, 1.0), (None, "", 2.0), ("x", " ", 3.0), ("y", "b", 4.0)], "p string, s string, d double")
    got = {r["column"]: (r["nulls"], r["null_pct"], r["above_threshold"]) for r in completeness.null_profile(df).collect()}
    assert got == {"p": (3, 60.0, True), "s": (1, 20.0, False), "d": (1, 20.0, False)}
    kpi = completeness.null_kpis(completeness.null_profile(df)).first()
    assert (kpi["over_threshold"], kpi["emptiest"], kpi["empty_cells_pct"]) == (1, "p", 33.33)
    fill = {r["column"]: r["fill"] for r in completeness.column_fill(df).collect()}
    assert fill == {"p": 0.4, "s": 0.6, "d": 0.8}
    none = completeness.null_profile(df.limit(0)).collect()
    assert [r["null_pct"] for r in none] == [0.0] * 3 and completeness.column_fill(df.limit(0)).first()["fill"] == 0.0


def test_column_health_has_odd_names(spark):
    df = spark.createDataFrame([(0, " x", 1), (1, "y", None)], "_row_id long, `a.b c` string, number int")
    got = {r["Column"]: r for r in completeness.column_health(df, bind_roles(df)).collect()}
    assert got["a.b c"]["Padded Whitespace"] == "Yes" and got["a.b c"]["Sample Value"] == " x"
    assert got["number"]["Matched Requirement"] == "Ticket Identification" and got["number"]["Nulls"] == 1
    assert {r["column"]: r["fill_pct"] for r in completeness.unused_column_table(df, bind_roles(df)).collect()} == {"a.b c": 100.0}


def test_distributions_keep_totals(spark):
    df = spark.createDataFrame([(f"g{i % 40}", i) for i in range(120)], "assignment_group string, n int")
    rows = aggregates.distributions(df, ["assignment_group", "n"]).orderBy("position", "rank").collect()
    groups = [r for r in rows if r["column"] == "assignment_group"]
    assert len(groups) == 21 and sum(r["count"] for r in groups) == 120 and groups[-1]["value"] == "(and 20 more values)"
    assert rows[-1]["value"] == "(not summarised - 120 distinct values)"
    assert aggregates.pivot_columns(df.withColumn("State", F.lit(1)), "n") == ["assignment_group", "State"]


def test_cube_sums_to_rows(spark):
    df = tickets(spark, [{"priority": f"P{i % 3}" if i % 5 else None, "state": f"s{i % 4}", "number": f"INC{i}"} for i in range(80)])
    cube, dims, notes = aggregates.pivot_cube(df, aggregates.pivot_columns(df, "number"))
    assert sum(r["Ticket count"] for r in cube.collect()) == 80 and len(dims) == 4 and any("times" in n for n in notes)
    pivot = {r["priority"]: r["Ticket count"] for r in aggregates.native_pivot(cube, "priority").collect()}
    assert pivot["(blank)"] == 16 and pivot["Grand Total"] == 80
    small, kept, notes = aggregates.pivot_cube(df, aggregates.pivot_columns(df, "number"), most_rows=5)
    assert len(kept) < 4 and any("dropped" in n for n in notes) and small.count() <= 5


def test_inflow(spark):
    df = tickets(spark, [{"opened_at": d} for d in [DAY(2024, 1, 3), DAY(2024, 1, 9), DAY(2024, 3, 1), DAY(2024, 3, 2), None]])
    assert [tuple(r) for r in aggregates.monthly_inflow(df, F.col("opened_at")).collect()] == [("2024-01", 2, 50.0), ("2024-03", 2, 50.0)]
    assert aggregates.inflow_kpis(df, F.col("opened_at")).first()[:] == (4, 2, "2024-01", 2, 2, 1)


# Descriptions


@pytest.mark.parametrize(("length", "group", "score", "tier"), [
    (0, 0, 0, "Critical"), (6000, 1, 40, "Fair"), (100, 15, 45, "Fair"), (100, 5, 58, "Fair"), (1100, 1, 100, "Excellent"), (100, 1, 67, "Good"), (1, 1, 5, "Poor"), (19, 20, 37, "Poor"), (6000, 50, 40, "Fair"),
])
def test_quality_scores(spark, length, group, score, tier):
    n, g = F.lit(length), F.lit(group)
    got = spark.range(1).select(X.quality_score(n, g, 20, 5000).alias("s"), X.quality_tier(n, X.quality_score(n, g, 20, 5000), 20, 5000, g).alias("t")).first()
    assert (got["s"], got["t"]) == (score, tier)


TEXTS = ["VPN drops every 5 minutes for the sales floor", "VPN drops every 30 minutes for the sales floor", "VPN drops every 7 minutes for the sales floor", "fix it", "help", "", "A normal description of a problem with mail", "x" * 6000]


def test_description_summary_and_repeats(spark):
    df = tickets(spark, [{"description": t} for t in TEXTS])
    q = descriptions.quality_summary(descriptions.measured(df, "description")).first()
    assert (q["empty"], q["too_short"], q["too_long"], q["total"]) == (1, 2, 1, 8)
    assert q["critical"] + q["poor"] + q["fair"] + q["good"] + q["excellent"] == 8
    top = descriptions.recurring_issues(df, "description", "number").first()
    assert (top["kind"], top["count"], top["sample_ids"]) == ("exact", 3, ["INC0001", "INC0002", "INC0003"])
    assert descriptions.quality_samples(descriptions.measured(df, "description"))["too_short"] == ["fix it", "help"]
    nobody = descriptions.recurring_issues(df.limit(0), "description", None)
    assert nobody.count() == 0


def test_reworded_issues_cluster(spark):
    a = "Outlook crashes whenever opening large calendar attachments after update"
    b = "After update Outlook crashes opening large calendar attachments constantly"
    df = tickets(spark, [{"description": t} for t in [a, b, "Monitor flickers green near conference room projector"]])
    groups = descriptions.similar_groups(descriptions.exact_groups(descriptions.normalised_rows(df, "description"))).collect()
    assert [(r["count"], r["texts"]) for r in groups] == [(2, 2)]
    table = descriptions.recurring_table(descriptions.recurring_issues(df, "description", "number"), "description").collect()
    assert [(r["Type"], r["Tickets"]) for r in table] == [("Reworded", 2)]


def test_similarity_matches_brute_force(spark):
    import random

    rng = random.Random(3)
    vocab = [f"{c}word" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(i, " ".join(rng.sample(vocab, rng.randint(2, 9)))) for i in range(250)]
    groups = spark.createDataFrame([(k, 1 + i % 3, i) for i, k in rows], "key string, count long, first_row long")
    got = {(r["a"], r["b"]): r["similarity"] for r in descriptions.token_pairs(groups).collect()}
    sets = {i: {w for w in k.split() if len(w) >= 4 and w not in STOP_WORDS} for i, k in rows}
    sets = {i: s for i, s in sets.items() if len(s) >= 3}
    weight = {i: 1 + i % 3 for i, _ in rows}
    df = {w: sum(weight[i] for i, s in sets.items() if w in s) for w in vocab}
    cap = max(50, int(sum(weight[i] for i in sets) * 0.05))
    want = {
        (a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets
        if a < b and any(df[w] <= cap for w in sets[a] & sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6
    }
    assert got == pytest.approx(want)


def test_components_match_union_find(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in parent if x not in loops}


def test_group_counts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else "hot" if i % 3 else f"k{i}") for i in range(500)], "_row_id long, k string")
    want = {r["_row_id"]: r["n"] for r in with_group_count(df, F.col("k"), "n").collect()}
    assert want == {r["_row_id"]: r["n"] for r in with_group_count(df.repartition(9), F.col("k"), "n", salts=3).collect()}
    assert want[0] == 72 and want[3] == 1


# Language


def test_language_tiers(spark):
    texts = ["Bonjour, merci de verifier le systeme", "Hola buenos dias, gracias por favor", "Пожалуйста помогите мне", "Please reset my password today", "Größe stimmt nicht mehr", "tiny", None]
    run = language.check_column(values(spark, texts), "v", mode="rules_only")
    rows = {r["_row_id"]: r for r in run.rows.collect()}
    assert [rows[i]["lang"] for i in range(7)] == ["French", "Spanish", "Russian", None, "German", None, None]
    assert [rows[i]["lang_method"] for i in range(3)] == ["keywords", "keywords", "characters"]
    assert column(run.rows.withColumn("v", language.row_language(run))) == ["French", "Spanish", "Russian", "English", "German", "Too short to check", "Too short to check"]
    counts = language.language_counts(run).first()
    assert (counts["total_original"], counts["total_analyzed"], counts["non_english_count"], counts["percentage"]) == (6, 5, 4, 80.0)
    assert language.format_result(run)[0].startswith("v: 4 of 5 judged rows are not in English (80.0%)")
    assert language.language_mix([run]).count() == 4


def test_model_tier_and_unavailable_model(spark):
    df = values(spark, ["Dit is een lange zin", "barely english text", "plain english text"])
    model = lambda ts: [[("Dutch", 0.9)] if "zin" in t else [("English", 0.5), ("Danish", 0.4)] if "barely" in t else [("English", 0.99)] for t in ts]
    run = language.check_column(df, "v", model=model)
    assert column(run.rows, "lang") == ["Dutch", "Danish", None] and run.using_model
    off = language.check_column(df, "v", mode="model_only")
    assert off.rows is None and off.warning and language.check_column(df, "w").error
    register_row = register.findings(context(spark, [{}]), [off]).filter("Area = 'Language'").first()
    assert register_row["Result"] == "Not checked" and register_row["Rows Affected"] is None
    assert {r["Status"] for r in language.language_summary(spark, [off, run]).collect()} == {"Not checked", "Checked"}


# Register, detail, reports


def test_register_order_and_detail(spark):
    ctx = context(spark, MESSY)
    rows = register.findings(ctx).collect()
    outcomes = [r["Result"] for r in rows]
    assert outcomes == sorted(outcomes, key=["Fail", "Not checked", "Review", "Pass"].index)
    assert {r["Check"]: r["Rows Affected"] for r in rows}["State vocabulary"] == 1
    assert all((r["Severity"] == "-") == (r["Result"] == "Pass") for r in rows)
    detail = register.ticket_detail(ctx)
    counts = logic.logic_counts(ctx).first()
    assert detail.filter("`Closed No Date` = 'Yes'").count() == counts["closed_no_date"]
    assert detail.agg(F.sum("QA Flag Count")).first()[0] == counts["issues_total"]
    assert detail.filter("`QA Findings` <> 'None'").count() == counts["rows_flagged"]
    k = register.kpis(ctx, register.findings(ctx)).first()
    assert k["rows"] == 60 and k["checks_failed"] == outcomes.count("Fail")


def test_reports_read(spark):
    ctx = context(spark, MESSY)
    full = report.text_report(ctx, "dump.xlsx")
    titles = ["COLUMN CHECK", "NULL ANALYSIS", "DATE FORMATS", "DATE LOGIC", "CROSS-FIELD LOGIC", "DUPLICATES", "LANGUAGE", "DISTRIBUTIONS", "SUMMARY"]
    assert [full.index(t) for t in titles] == sorted(full.index(t) for t in titles)
    letter = report.summary_report(ctx, "dump.xlsx")
    assert "Critical issues" in letter and "Requested actions" in letter and "Non-English content" in letter
    assert report.state_lines(ctx) == ["Closd (1 rows): looks like 'Closed'"]
    assert report.period_text(ctx) == "Mar-24"


def test_results_do_not_depend_on_partitions(spark):
    a, b = tickets(spark, MESSY), tickets(spark, MESSY).repartition(7)
    for make in (lambda d: register.findings(AuditContext.open(d, as_of=AS_OF)), lambda d: completeness.column_profile(d), lambda d: descriptions.recurring_issues(d, "description", "number")):
        assert sorted(map(str, make(a).collect())) == sorted(map(str, make(b).collect()))


def test_config_store(tmp_path):
    path = tmp_path / "config.json"
    store = ConfigStore(path)
    assert store.get("null_threshold") == 20 and store.config() == AuditConfig()
    store.set("null_threshold", 30)
    store.update({"own": 1, "date_dayfirst": True})
    again = ConfigStore(path)
    assert again.config().null_threshold == 30 and again.config().date_dayfirst is True and again.get("own") == 1
    path.write_text("{broken")
    assert ConfigStore(path).get("null_threshold") == 20


def test_similar_sets_keep_every_pair_and_no_meetings(spark, monkeypatch):
    """All pairs of brute force over several blocks a class, and nothing on disk that grows with the pairs that only meet."""
    import random

    from ledgerline.plans import set_join

    monkeypatch.setattr(set_join, "BLOCK_WORDS", 400)
    rng, sets = random.Random(3), []
    for k in range(150):
        own = rng.sample([f"word{i}" for i in range(400)], rng.randint(3, 40))
        sets += [(2 * k, own), (2 * k + 1, rng.sample(own, max(3, len(own) - rng.randint(0, 6))) + [f"word{rng.randint(0, 80)}x" for _ in range(rng.randint(0, 3))])]
    sets = [(k, list(dict.fromkeys(w))) for k, w in sets]
    df = spark.createDataFrame([(k, k % 3 + 1, " ".join(w)) for k, w in sets], "first_row long, count long, key string")
    weight = {}
    for k, w in sets:
        for x in w:
            weight[x] = weight.get(x, 0) + k % 3 + 1
    cap, held = max(50, int(sum(k % 3 + 1 for k, _ in sets) * 0.05)), [(k, set(w)) for k, w in sets]
    want = {
        (a, b): len(x & y) / len(x | y) for i, (a, x) in enumerate(held) for b, y in held[i + 1 :]
        if len(x & y) / len(x | y) >= 0.6 and any(weight[w] <= cap for w in x & y)
    }
    found = descriptions.token_pairs(df)
    assert {(r["a"], r["b"]): r["similarity"] for r in found.collect()} == want and len(want) > 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "HashAggregate" not in plan  # pairs are not shuffled to be counted


def test_reworded_issues_cluster_by_words_of_any_frequency(spark, monkeypatch):
    """texts that share only words of more than max(50, 5 %) of the rows are linked too, and near copies need few links."""
    import random

    from ledgerline.plans import set_join

    for name, value in (("BLOCK_WORDS", 900), ("BLOCK_SETS", 60), ("EXPANDED", 500)):
        monkeypatch.setattr(set_join, name, value)
    rng, often = random.Random(9), [f"often{i}" for i in range(14)]
    sets = [rng.sample(often, rng.randint(5, 9)) + [f"rare{k}x{i}" for i in range(rng.randint(0, 6))] for k in range(160)]
    sets += [[f"copy{i}" for i in range(30)] + [f"own{k}x"] for k in range(90)]
    df = spark.createDataFrame([(k, 1 + k % 2, " ".join(w)) for k, w in enumerate(sets)], "first_row long, count long, key string")
    held, root = [set(w) for w in sets], list(range(len(sets)))
    for a, x in enumerate(held):
        for b in range(a):
            if len(x & held[b]) / len(x | held[b]) >= 0.6:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    want = {r: (sum(1 + k % 2 for k, q in enumerate(root) if q == r), r, root.count(r)) for r in set(root) if root.count(r) > 1}
    got = {r["component"]: (r["count"], r["first_row"], r["texts"]) for r in descriptions.similar_groups(df).collect()}
    assert got == want and len(want) > 1
    assert all(r["similarity"] == len(held[r["a"]] & held[r["b"]]) / len(held[r["a"]] | held[r["b"]]) for r in descriptions.token_links(df).collect())
