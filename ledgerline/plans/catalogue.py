"""Registered audit queries over the driver's tables, and the SQL each is held against.

Orders stand in for tickets: created is the order date, closed the last ship date,
states read O as open, F as fulfilled, and leave P unclassified. Values that the
tables never lack are blanked on both sides, so that null handling shows.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.config import CLEAN_PATTERNS, LANGUAGE_WORDS, SCRIPT_CLASSES, STOP_WORDS, AuditConfig
from ledgerline.functions import dates, state
from ledgerline.functions import text as X
from ledgerline.operators import (
    aggregates, calendar, completeness, descriptions, extract, language, language_model, logic, register, roles, vocabulary,
)

AS_OF = datetime.datetime(2000, 1, 1)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL it is held against."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _registered() -> None:
    from ledgerline.plans import catalogue_files, catalogue_tables  # noqa: F401  (they register their queries here)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _registered()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _registered()
    return dict(_SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tickets(spark: SparkSession, sf: str) -> DataFrame:
    shipped = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("number")).agg(F.max("l_shipdate").cast("timestamp_ntz").alias("resolved_at"))
    word = F.when(F.col("o_orderstatus") == "O", "Open").when(F.col("o_orderstatus") == "F", "Fulfilled").otherwise("Stage P")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("number"), F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"),
        word.alias("state"), F.col("o_orderdate").cast("timestamp_ntz").alias("opened_at"), F.col("o_orderkey").alias("_row_id"),
    )
    return orders.join(shipped, "number", "left")


TICKETS = """
tickets AS (
  SELECT o_orderkey AS number, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority,
         CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Fulfilled' ELSE 'Stage P' END AS state,
         o_orderdate AS opened_at, s.resolved_at, o_orderkey AS _row_id
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS resolved_at FROM lineitem GROUP BY 1) s ON s.l_orderkey = o_orderkey
)"""

FLAGS = f"""WITH {TICKETS},
flags AS (
  SELECT *, coalesce(resolved_at < opened_at, false) AS closed_before_created,
    coalesce(opened_at > TIMESTAMP '2000-01-01', false) AS future_created,
    coalesce(resolved_at > TIMESTAMP '2000-01-01', false) AS future_closed,
    (state = 'Fulfilled' AND resolved_at IS NULL) AS closed_no_date,
    (state = 'Open' AND resolved_at IS NOT NULL) AS open_with_date,
    (state = 'Open' AND (priority IS NULL OR trim(priority) = '')) AS open_missing_priority
  FROM tickets
)"""


def ticket_context(spark: SparkSession, sf: str) -> logic.AuditContext:
    ranked = {
        roles.ID: ["number"], roles.PRIORITY: ["priority"], roles.STATE: ["state"],
        roles.CREATED: ["opened_at"], roles.CLOSED: ["resolved_at"],
    }
    bound = roles.Roles(ranked, {r: [(c[0], 100)] for r, c in ranked.items()}, created="opened_at", closed="resolved_at")
    return logic.AuditContext(tickets(spark, sf), bound, AuditConfig(), AS_OF)


def pct(part: str, whole: str) -> str:
    return f"round(coalesce({part} * 100.0 / nullif({whole}, 0), 0.0), 2)"


# Logic


@query(f"""{FLAGS}, counts AS (
  SELECT count(*) FILTER (WHERE closed_before_created) AS c0, count(*) FILTER (WHERE future_created) AS c1,
         count(*) FILTER (WHERE future_closed) AS c2, count(*) FILTER (WHERE closed_no_date) AS c3,
         count(*) FILTER (WHERE open_with_date) AS c4, count(*) FILTER (WHERE open_missing_priority) AS c5,
         count(*) FILTER (WHERE state = 'Stage P') AS c6 FROM flags),
listed AS (
  SELECT 0 AS position, 'closed_before_created' AS rule, 'Date sequence' AS "check", 'Critical' AS severity, c0 AS rows_affected FROM counts
  UNION ALL SELECT 1, 'future_created', 'Future dates', 'Medium', c1 FROM counts
  UNION ALL SELECT 2, 'future_closed', 'Future dates', 'Medium', c2 FROM counts
  UNION ALL SELECT 3, 'closed_no_date', 'State / resolution', 'High', c3 FROM counts
  UNION ALL SELECT 4, 'open_with_date', 'State / resolution', 'High', c4 FROM counts
  UNION ALL SELECT 5, 'open_missing_priority', 'Open ticket priority', 'Medium', c5 FROM counts
  UNION ALL SELECT 6, 'unclassified_count', 'State classification', 'Low', c6 FROM counts)
SELECT *, CASE WHEN rows_affected = 0 THEN 'Pass' WHEN "check" = 'State classification' THEN 'Review' ELSE 'Fail' END AS result FROM listed""")
def logic_rule_counts(spark, sf):
    return logic.rule_results(logic.logic_counts(ticket_context(spark, sf)))


@query(f"""{FLAGS} SELECT count(*) AS rows,
  count(*) FILTER (WHERE closed_before_created OR future_created OR future_closed OR closed_no_date OR open_with_date OR open_missing_priority) AS rows_flagged,
  CAST(sum(closed_before_created::INT + future_created::INT + future_closed::INT + closed_no_date::INT + open_with_date::INT + open_missing_priority::INT) AS BIGINT) AS issues_total,
  count(*) FILTER (WHERE state = 'Open') AS open_count, count(*) FILTER (WHERE state = 'Fulfilled') AS closed_count,
  count(*) FILTER (WHERE state = 'Stage P') AS unclassified_count FROM flags""")
def rows_flagged(spark, sf):
    names = ("rows", "rows_flagged", "issues_total", "open_count", "closed_count", "unclassified_count")
    return logic.logic_counts(ticket_context(spark, sf)).select(*names)


@query(f"""{FLAGS} SELECT number, state, resolved_at FROM flags WHERE open_with_date ORDER BY _row_id LIMIT 200""")
def rule_evidence(spark, sf):
    return logic.evidence(ticket_context(spark, sf), "open_with_date", ["state", "resolved_at"])


@query(f"""WITH {TICKETS} SELECT number, round(date_diff('microsecond', opened_at, resolved_at) / 86400000000.0, 2) AS resolution_days FROM tickets""")
def resolution_days(spark, sf):
    return tickets(spark, sf).select("number", dates.resolution_days(F.col("opened_at"), F.col("resolved_at")).alias("resolution_days"))


@query(f"""{FLAGS}, counted AS (SELECT *, concat_ws(', ', CASE WHEN closed_before_created THEN 'Closed Before Created' END,
  CASE WHEN future_created THEN 'Future Created Date' END, CASE WHEN future_closed THEN 'Future Closed Date' END,
  CASE WHEN closed_no_date THEN 'Closed No Date' END, CASE WHEN open_with_date THEN 'Open With Date' END,
  CASE WHEN open_missing_priority THEN 'Open Missing Priority' END) AS said FROM flags)
SELECT number, priority, state, opened_at, resolved_at, _row_id,
  round(date_diff('microsecond', opened_at, resolved_at) / 86400000000.0, 2) AS "Resolution Days",
  CASE state WHEN 'Fulfilled' THEN 'Closed' WHEN 'Open' THEN 'Open' ELSE 'Unrecognised' END AS "State Reads As",
  CASE WHEN closed_before_created THEN 'Yes' ELSE 'No' END AS "Closed Before Created", CASE WHEN future_created THEN 'Yes' ELSE 'No' END AS "Future Created Date",
  CASE WHEN future_closed THEN 'Yes' ELSE 'No' END AS "Future Closed Date", CASE WHEN closed_no_date THEN 'Yes' ELSE 'No' END AS "Closed No Date",
  CASE WHEN open_with_date THEN 'Yes' ELSE 'No' END AS "Open With Date", CASE WHEN open_missing_priority THEN 'Yes' ELSE 'No' END AS "Open Missing Priority",
  CAST(closed_before_created::INT + future_created::INT + future_closed::INT + closed_no_date::INT + open_with_date::INT + open_missing_priority::INT AS INT) AS "QA Flag Count",
  CASE WHEN said = '' THEN 'None' ELSE said END AS "QA Findings", 'No' AS "Duplicate ID", CAST(1 AS BIGINT) AS "ID Occurrences" FROM counted""")
def ticket_detail(spark, sf):
    return register.ticket_detail(ticket_context(spark, sf))


@query(f"""{FLAGS}, n AS (
  SELECT count(*) FILTER (WHERE closed_before_created) AS c0, count(*) FILTER (WHERE future_created) AS c1,
         count(*) FILTER (WHERE future_closed) AS c2, count(*) FILTER (WHERE closed_no_date) AS c3,
         count(*) FILTER (WHERE open_with_date) AS c4, count(*) FILTER (WHERE open_missing_priority) AS c5,
         count(*) FILTER (WHERE state = 'Stage P') AS c6, count(*) FILTER (WHERE priority IS NULL) AS np, count(*) AS rows,
         count(*) FILTER (WHERE resolved_at IS NULL) AS nr FROM flags),
raw AS (
  SELECT 'Structure' AS a, 'Required column: ' || r AS c, 'Critical' AS s, CAST(1 AS BIGINT) AS k, NULL AS v FROM (VALUES ('Assignment Group'), ('Configuration Item'), ('Short Description'), ('Description')) t(r)
  UNION ALL SELECT 'Completeness', 'Nulls in priority', 'High', np, NULL FROM n WHERE round(np * 100.0 / rows, 2) > 19
  UNION ALL SELECT 'Completeness', 'Nulls in resolved_at', 'High', nr, NULL FROM n WHERE round(nr * 100.0 / rows, 2) > 19
  UNION ALL SELECT 'Completeness', 'Null thresholds', 'High', 0, NULL FROM n WHERE round(np * 100.0 / rows, 2) <= 19 AND round(nr * 100.0 / rows, 2) <= 19
  UNION ALL SELECT 'Logic', 'Date sequence', 'Critical', c0, NULL FROM n UNION ALL SELECT 'Logic', 'Future dates', 'Medium', c1, NULL FROM n
  UNION ALL SELECT 'Logic', 'Future dates', 'Medium', c2, NULL FROM n UNION ALL SELECT 'Logic', 'State / resolution', 'High', c3, NULL FROM n
  UNION ALL SELECT 'Logic', 'State / resolution', 'High', c4, NULL FROM n UNION ALL SELECT 'Logic', 'Open ticket priority', 'Medium', c5, NULL FROM n
  UNION ALL SELECT 'Logic', 'State classification', 'Low', c6, 'Review' FROM n UNION ALL SELECT 'Logic', 'State vocabulary', 'Medium', 0, NULL
  UNION ALL SELECT 'Uniqueness', 'Duplicate tickets', 'High', 0, NULL
  UNION ALL SELECT 'Text quality', 'Description quality', 'Medium', NULL, NULL UNION ALL SELECT 'Language', 'Non-English content', 'Medium', NULL, NULL),
judged AS (SELECT a, c, s, k, CASE WHEN k = 0 THEN 'Pass' WHEN v IS NOT NULL THEN v WHEN k IS NULL THEN 'Not checked' ELSE 'Fail' END AS r FROM raw)
SELECT a AS "Area", c AS "Check", CASE WHEN r = 'Pass' THEN '-' ELSE s END AS "Severity", k AS "Rows Affected", r AS "Result" FROM judged""")
def findings_register(spark, sf):
    ctx = ticket_context(spark, sf)
    ctx.config = AuditConfig(null_threshold=19)
    return register.findings(ctx).drop("Detail")


@query(_SQL["findings_register"].replace('SELECT a AS "Area", c AS "Check"', ', reg AS (SELECT a AS "Area", c AS "Check"') + """)
SELECT "Area", count(*) FILTER (WHERE "Result" = 'Fail') AS "Fail", count(*) FILTER (WHERE "Result" = 'Not checked') AS "Not checked",
  count(*) FILTER (WHERE "Result" = 'Review') AS "Review", count(*) FILTER (WHERE "Result" = 'Pass') AS "Pass" FROM reg GROUP BY 1""")
def area_result_crosstab(spark, sf):
    return aggregates.area_by_result(findings_register(spark, sf))


@query(_SQL["area_result_crosstab"].split("SELECT \"Area\", count(*)")[0] + """SELECT "Area", count(*) AS failing FROM reg WHERE "Result" = 'Fail' GROUP BY 1""")
def failing_by_area(spark, sf):
    return aggregates.failing_by_area(findings_register(spark, sf))


# Completeness

_NULLED = "SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority, o_totalprice, o_orderdate FROM orders"
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"]
_NULL_ROWS = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls FROM src" for i, c in enumerate(_ORDER_COLUMNS)
)
_PROFILE = f"WITH src AS ({_NULLED}), n AS ({_NULL_ROWS}), p AS (SELECT *, {pct('nulls', 'rows')} AS null_pct FROM n)"


def _nulled(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"), "o_totalprice", "o_orderdate",
    )


@query(f"{_PROFILE} SELECT *, null_pct > 20 AS above_threshold FROM p")
def null_profile(spark, sf):
    return completeness.null_profile(_nulled(spark, sf))


@query(f"{_PROFILE} SELECT \"column\" FROM p WHERE null_pct > 20")
def high_null_columns(spark, sf):
    return completeness.high_null_columns(completeness.null_profile(_nulled(spark, sf)))


@query(f"""{_PROFILE} SELECT count(*) FILTER (WHERE null_pct > 20) AS over_threshold, count(*) FILTER (WHERE nulls >= rows) AS entirely_empty,
  (SELECT "column" FROM p ORDER BY null_pct DESC, position LIMIT 1) AS emptiest, max(null_pct) AS emptiest_pct,
  {pct('CAST(sum(nulls) AS BIGINT)', 'CAST(sum(rows) AS BIGINT)')} AS empty_cells_pct FROM p""")
def null_kpis(spark, sf):
    return completeness.null_kpis(completeness.null_profile(_nulled(spark, sf)))


@query(f"{_PROFILE} SELECT *, null_pct > 20 AS above_threshold FROM p WHERE nulls > 0 ORDER BY null_pct DESC, position LIMIT 15")
def null_chart(spark, sf):
    return completeness.null_chart(completeness.null_profile(_nulled(spark, sf)))


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("WITH src AS (SELECT c_custkey, c_name, nullif(c_nationkey, 3) AS c_nationkey, c_acctbal, replace(c_mktsegment, 'BUILDING', '') AS c_mktsegment FROM customer) "
       + " UNION ALL ".join(
           f"SELECT {i} AS position, '{c}' AS \"column\", 1 - count(*) FILTER (WHERE {c} IS NULL{f' OR {c} = {chr(39) * 2}' if c in ('c_name', 'c_mktsegment') else ''}) / count(*) AS fill FROM src"
           for i, c in enumerate(_CUSTOMER)))
def column_fill(spark, sf):
    c = table(spark, sf, "customer")
    return completeness.column_fill(c.select(
        "c_custkey", "c_name", F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"), "c_acctbal",
        F.regexp_replace("c_mktsegment", "BUILDING", "").alias("c_mktsegment"),
    ))


@query(f"""WITH {TICKETS} SELECT count(*) AS rows, 5 AS columns, strftime(min(opened_at), '%Y-%m-%d') AS first_date, strftime(max(opened_at), '%Y-%m-%d') AS last_date,
  strftime(min(opened_at), '%Y-%m-%d %H:%M') AS first_created, strftime(max(opened_at), '%Y-%m-%d %H:%M') AS last_created FROM tickets""")
def data_profile(spark, sf):
    return completeness.data_profile(tickets(spark, sf), F.col("opened_at"))


@query("""WITH src AS (SELECT doc_id, nullif(lang, 'fr') AS lang, source, regexp_matches(text, '^\\s|\\s$') AS pad FROM documents), n AS (SELECT count(*) AS rows FROM src)
SELECT 0 AS position, 'doc_id' AS "column", rows, 'bigint' AS type, (SELECT CAST(doc_id AS VARCHAR) FROM src ORDER BY doc_id LIMIT 1) AS sample, false AS padded FROM n
UNION ALL SELECT 1, 'lang', rows, 'string', (SELECT lang FROM src WHERE lang IS NOT NULL ORDER BY doc_id LIMIT 1), false FROM n
UNION ALL SELECT 2, 'source', rows, 'string', (SELECT source FROM src ORDER BY doc_id LIMIT 1), false FROM n
UNION ALL SELECT 3, 'text', rows, 'string', (SELECT text[1:50] FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 1), (SELECT bool_or(pad) FROM src) FROM n
UNION ALL SELECT 4, 'n_chars', rows, 'bigint', (SELECT CAST(n_chars AS VARCHAR) FROM documents WHERE n_chars IS NOT NULL ORDER BY doc_id LIMIT 1), false FROM n""")
def column_profile(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.nullif("lang", F.lit("fr")).alias("lang"), "source", "text", "n_chars")
    return completeness.column_profile(d.withColumn("_row_id", F.col("doc_id")))


# Aggregation


@query(f"SELECT CAST(v AS VARCHAR) AS value, count(*) AS count, {pct('count(*)', '(SELECT count(*) FROM orders)')} AS pct FROM (SELECT nullif(o_orderpriority, '4-NOT SPECIFIED') AS v FROM orders) WHERE v IS NOT NULL GROUP BY 1")
def value_counts(spark, sf):
    return aggregates.value_counts(_nulled(spark, sf), "o_orderpriority")


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(" UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM part GROUP BY 3" for i, c in enumerate(_PART)))
def all_value_counts(spark, sf):
    return aggregates.all_value_counts(table(spark, sf, "part"), _PART)


_PART_ALL = ["p_brand", "p_name", "p_partkey", "p_retailprice", "p_size", "p_type"]


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 3" for i, c in enumerate(_PART_ALL)) + f"""),
d AS (SELECT position, "column", count(*) AS k, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY 1, 2),
r AS (SELECT c.*, d.k, d.total, row_number() OVER (PARTITION BY c.position ORDER BY n DESC, value) AS rn FROM c JOIN d USING (position)),
f AS (SELECT position, "column", least(rn, 21) AS rank, CAST(sum(n) AS BIGINT) AS count, count(*) AS m, min(value) AS value, any_value(total) AS total FROM r WHERE k <= 50 GROUP BY 1, 2, 3)
SELECT position, "column", CAST(rank AS INT) AS rank, CASE WHEN rank > 20 THEN '(and ' || format('{{:,}}', m) || ' more values)' ELSE value END AS value, count, {pct('count', 'total')} AS pct FROM f
UNION ALL SELECT position, "column", 1, '(not summarised - ' || format('{{:,}}', k) || ' distinct values)', total, {pct('total', 'total')} FROM d WHERE k > 50""")
def distributions_topn(spark, sf):
    return aggregates.distributions(table(spark, sf, "part"), _PART_ALL)


@query("""WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rn FROM c),
f AS (SELECT least(rn, 7) AS rank, min(value) AS value, CAST(sum(n) AS BIGINT) AS count, count(*) AS k FROM r GROUP BY 1)
SELECT CAST(rank AS INT) AS rank, CASE WHEN rank > 6 THEN 'Other (' || k || ' values)' ELSE value END AS value, count FROM f""")
def dimension_mix_other(spark, sf):
    return aggregates.dimension_mix(aggregates.value_counts(table(spark, sf, "part"), "p_brand"))


@query(f"SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count, {pct('count(*)', '(SELECT count(o_orderdate) FROM orders)')} AS pct FROM orders GROUP BY 1")
def monthly_inflow(spark, sf):
    return aggregates.monthly_inflow(table(spark, sf, "orders"), F.col("o_orderdate"))


@query(f"""WITH {TICKETS}, m AS (SELECT strftime(resolved_at, '%Y-%m') AS month, count(*) AS n FROM tickets WHERE resolved_at IS NOT NULL GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS months, (SELECT month FROM m ORDER BY n DESC, month LIMIT 1) AS peak_month, max(n) AS peak_count,
  CAST(round(avg(n)) AS BIGINT) AS mean, (SELECT count(*) FROM tickets WHERE resolved_at IS NULL) AS undated FROM m""")
def inflow_kpis(spark, sf):
    return aggregates.inflow_kpis(tickets(spark, sf), F.col("resolved_at"))


@query("SELECT l_returnflag, l_linestatus, coalesce(CAST(l_linenumber AS VARCHAR), '(blank)') AS l_linenumber, count(*) AS \"Ticket count\" FROM lineitem GROUP BY 1, 2, 3")
def pivot_cube(spark, sf):
    cube, _, _ = aggregates.pivot_cube(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey", "l_shipdate"])
    return cube


@query("""WITH c AS (SELECT coalesce(o_orderpriority, '(blank)') AS o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'Grand Total' ELSE o_orderpriority END AS o_orderpriority, CAST(sum(n) AS BIGINT) AS "Ticket count", CAST(grouping(o_orderpriority) AS BIGINT) AS level
FROM c GROUP BY ROLLUP (o_orderpriority)""")
def pivot_rollup(spark, sf):
    cube = aggregates.cube(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])
    return aggregates.native_pivot(cube, "o_orderpriority")


# Vocabulary


@query(f"""WITH src AS (SELECT CASE WHEN event_id % 997 = 0 THEN 'clck' WHEN event_id % 4001 = 0 THEN 'zz odd' WHEN event_id % 31 = 0 THEN NULL ELSE event_type END AS v FROM events),
c AS (SELECT v AS value, count(*) AS count, {pct('count(*)', '(SELECT count(*) FROM src)')} AS pct FROM src WHERE v IS NOT NULL AND trim(v) <> '' GROUP BY 1)
SELECT value, count, pct, CASE WHEN regexp_matches(lower(value), 'closed|resolved|completed|cancelled|canceled|done|solved|close|complete|cancel|fulfilled') THEN 'terminal'
  WHEN regexp_matches(lower(value), 'open|new|active|pending|assigned|awaiting|hold|wip|acknowledged|investigating|reopened|progress') THEN 'active' ELSE 'unknown' END AS classification FROM c""")
def state_vocabulary(spark, sf):
    return vocabulary.state_values(_misspelt(spark, sf), "event_type")


def _misspelt(spark, sf):
    i = F.col("event_id")
    v = F.when(i % 997 == 0, "clck").when(i % 4001 == 0, "zz odd").when(i % 31 == 0, F.lit(None)).otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", v.alias("event_type"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'terminal' ELSE 'unknown' END AS kind, lower(trim('  ' || o_orderpriority || ' ')) AS folded, o_orderstatus = 'P' AS blank FROM orders""")
def state_classification(spark, sf):
    o = table(spark, sf, "orders")
    word = F.when(F.col("o_orderstatus") == "O", " Re-OPENED ").when(F.col("o_orderstatus") == "F", "Resolved, pending").otherwise(" \t ")
    padded = F.concat(F.lit(" \t"), F.col("o_orderpriority"), F.lit("\n"))
    return o.select("o_orderkey", state.classify(word).alias("kind"), X.fold(padded).alias("folded"), X.is_blank(word).alias("blank"))


# Identity


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1)
SELECT CAST(sum(n - 1) AS BIGINT) AS surplus, count(*) AS ids_affected, CAST(sum(n) AS BIGINT) AS rows_involved FROM c""")
def duplicate_surplus(spark, sf):
    return logic.duplicate_summary(table(spark, sf, "lineitem"), "l_orderkey")


@query("SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return logic.duplicate_ids(table(spark, sf, "lineitem"), "l_orderkey")


_KEYED = "SELECT l_orderkey AS k, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_orderkey END AS id FROM lineitem"


def _keyed(spark, sf):
    k = F.col("l_orderkey")
    return table(spark, sf, "lineitem").select(k.alias("k"), "l_linenumber", F.when(k % 7 != 0, k).alias("id"))


@query(f"WITH s AS ({_KEYED}) SELECT k, l_linenumber, id, CASE WHEN id IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY id) END AS id_occurrences, count(*) OVER (PARTITION BY id) > 1 AS is_duplicate FROM s")
def id_occurrences(spark, sf):
    return logic.with_id_occurrences(_keyed(spark, sf), "id")


@query(f"WITH s AS ({_KEYED}) SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY id) > 1")
def duplicate_rows(spark, sf):
    return logic.duplicate_rows(_keyed(spark, sf), "id")


# Dates

_COVERAGE = """WITH d AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, day(o_orderdate) AS day, day(last_day(o_orderdate)) AS days_in_month, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT *, coalesce(day - lag(day) OVER (PARTITION BY month ORDER BY day) - 1, 0) AS gap FROM d),
m AS (SELECT month, CAST(sum(n) AS BIGINT) AS rows, CAST(days_in_month AS INT) AS days_in_month, CAST(min(day) AS INT) AS first_day, CAST(max(day) AS INT) AS last_day, CAST(max(gap) AS INT) AS longest_gap FROM g GROUP BY month, days_in_month),
v AS (SELECT *, first_day - 1 >= 3 AS truncated_start, days_in_month - last_day >= 3 AS truncated_end, longest_gap >= 7 AS interior_gap FROM m),
cov AS (SELECT *, truncated_start OR truncated_end OR interior_gap AS partial FROM v)"""


@query(f"{_COVERAGE} SELECT * FROM cov")
def month_coverage(spark, sf):
    return calendar.month_coverage(table(spark, sf, "orders"), F.col("o_orderdate"))


@query(f"{_COVERAGE} SELECT * FROM cov WHERE partial AND month >= '1995-06' AND month <= '2001-08'")
def partial_months(spark, sf):
    return calendar.partial_months(month_coverage(spark, sf), "1995-06", "2001-08")


@query(f"{_COVERAGE} SELECT month FROM cov WHERE NOT partial")
def complete_months(spark, sf):
    return calendar.complete_months(month_coverage(spark, sf))


def _texted(spark, sf):
    o = table(spark, sf, "orders")
    form = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return o.select("o_orderkey", form.alias("opened"))


_TEXTED = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS opened FROM orders"


@query(f"""WITH s AS (SELECT DISTINCT opened AS v FROM ({_TEXTED})),
p AS (SELECT v, length(regexp_extract(v, '^(\\d{{1,4}})', 1)) = 4 AS iso, CAST(regexp_extract(v, '^\\s*(\\d{{1,4}})[/\\-.](\\d{{1,2}})', 1) AS INT) AS a, CAST(regexp_extract(v, '^\\s*(\\d{{1,4}})[/\\-.](\\d{{1,2}})', 2) AS INT) AS b FROM s)
SELECT count(*) AS total, count(*) FILTER (WHERE iso) AS iso, count(*) FILTER (WHERE NOT iso AND a > 12 AND b <= 12) AS day_first,
  count(*) FILTER (WHERE NOT iso AND b > 12 AND a <= 12) AS month_first, count(*) FILTER (WHERE NOT iso AND a <= 12 AND b <= 12) AS ambiguous, 'day_first' AS date_order,
  (SELECT list(v ORDER BY v) FROM (SELECT v FROM p WHERE NOT iso AND a <= 12 AND b <= 12 ORDER BY v LIMIT 3)) AS examples FROM p""")
def date_order_detection(spark, sf):
    return calendar.date_order(_texted(spark, sf), "opened")


@query(f"""WITH s AS ({_TEXTED}), r AS (SELECT opened, try_strptime(opened, '%d/%m/%Y') AS d, try_strptime(opened, '%m/%d/%Y') AS m FROM s WHERE opened LIKE '%/%')
SELECT count(*) FILTER (WHERE coalesce(d, m) IS DISTINCT FROM coalesce(m, d)) AS rows_that_would_change FROM r""")
def date_reading_cost(spark, sf):
    return calendar.rows_that_would_change(_texted(spark, sf), "opened", True)


# Extracts


@query(f"""WITH {TICKETS} SELECT number, state, resolved_at FROM tickets WHERE (resolved_at >= TIMESTAMP '1996-03-01' AND resolved_at < TIMESTAMP '1997-08-01') OR resolved_at IS NULL""")
def extract_range(spark, sf):
    pick = extract.Selection(F.col("resolved_at"), "1997-07", "1996-03", undated=True)
    return extract.build_extract(tickets(spark, sf), pick, ["resolved_at", "state", "number", "unknown"])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1996-01', '1996-02', '1998-12')")
def extract_months(spark, sf):
    pick = extract.Selection(F.col("o_orderdate"), months=("1996-02", "1996-01", "1998-12"))
    return extract.build_extract(table(spark, sf, "orders"), pick, ["o_orderkey", "o_orderdate"])


@query(f"""WITH {TICKETS}, s AS (SELECT *, coalesce(resolved_at >= TIMESTAMP '1996-01-01' AND resolved_at < TIMESTAMP '1999-01-01', false) OR resolved_at IS NULL AS chosen, coalesce(priority = '1-URGENT', false) AS gone FROM tickets)
SELECT count(*) FILTER (WHERE chosen AND NOT gone) AS rows, count(*) FILTER (WHERE chosen AND gone) AS excluded_rows, count(*) FILTER (WHERE resolved_at IS NULL) AS undated_rows FROM s""")
def extract_plan(spark, sf):
    pick = extract.Selection(F.col("resolved_at"), "1996-01", "1998-12", undated=True, exclude=F.col("priority") == "1-URGENT")
    return extract.plan_counts(tickets(spark, sf), pick)


@query(f"""WITH {TICKETS} SELECT strftime(resolved_at, '%Y-%m') AS month, count(*) AS rows FROM tickets WHERE resolved_at >= TIMESTAMP '1996-01-01' AND resolved_at < TIMESTAMP '1999-01-01'
  AND NOT coalesce(priority = '1-URGENT', false) GROUP BY 1""")
def extract_plan_months(spark, sf):
    pick = extract.Selection(F.col("resolved_at"), "1996-01", "1998-12", undated=True, exclude=F.col("priority") == "1-URGENT")
    return extract.plan_months(tickets(spark, sf), pick)


_STATES = "CASE event_type WHEN 'click' THEN 'Cancelled' WHEN 'view' THEN ' CANCELED by user' ELSE event_type END"


@query(f"SELECT event_id, {_STATES} AS state FROM events WHERE NOT contains(lower({_STATES}), 'cancel')")
def exclude_cancelled(spark, sf):
    t = F.col("event_type")
    e = table(spark, sf, "events").select("event_id", F.when(t == "click", "Cancelled").when(t == "view", " CANCELED by user").otherwise(t).alias("state"))
    return e.filter(~state.is_cancelled(F.col("state")))


# Descriptions

_LENGTHS = r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM documents),
l AS (SELECT doc_id, length(s) AS n, CASE WHEN s = '' THEN 0 ELSE count(*) OVER (PARTITION BY s) END AS g FROM t),
r AS (SELECT *, CAST(CASE WHEN n = 0 THEN 0 WHEN n > 5000 THEN 40 WHEN n < 20 THEN floor(greatest(5.0, least(39.0, n / 20.0 * 39))) WHEN g >= 10 THEN 45 WHEN g >= 3 THEN 58
  ELSE 65 + floor(greatest(0.0, least(35.0, (n - 20) / 1000.0 * 35))) END AS INT) AS score FROM l),
q AS (SELECT *, CASE WHEN n = 0 THEN 'Critical' WHEN n > 5000 THEN 'Fair' WHEN n < 20 THEN 'Poor' WHEN g >= 3 THEN 'Fair' WHEN score >= 90 THEN 'Excellent' ELSE 'Good' END AS tier FROM r)"""


def _measured(spark, sf):
    return descriptions.measured(table(spark, sf, "documents").withColumn("_row_id", F.col("doc_id")), "text")


@query(f"{_LENGTHS} SELECT doc_id, CAST(n AS INT) AS length, CAST(g AS BIGINT) AS group_size, score, tier FROM q")
def description_scores(spark, sf):
    return _measured(spark, sf).select("doc_id", "length", "group_size", "score", "tier")


@query(f"""{_LENGTHS} SELECT count(*) AS total, count(*) FILTER (WHERE n = 0) AS empty, count(*) FILTER (WHERE n > 0 AND n < 20) AS too_short, count(*) FILTER (WHERE n > 5000) AS too_long,
  {pct('count(*) FILTER (WHERE n = 0)', 'count(*)')} AS empty_pct, {pct('count(*) FILTER (WHERE n > 0 AND n < 20)', 'count(*)')} AS too_short_pct, {pct('count(*) FILTER (WHERE n > 5000)', 'count(*)')} AS too_long_pct,
  CAST(min(n) FILTER (WHERE n > 0) AS INT) AS min_length, CAST(max(n) FILTER (WHERE n > 0) AS INT) AS max_length, round(avg(n) FILTER (WHERE n > 0), 1) AS avg_length,
  CAST(floor(median(n) FILTER (WHERE n > 0)) AS INT) AS median_length,
  count(*) FILTER (WHERE tier = 'Critical') AS critical, count(*) FILTER (WHERE tier = 'Poor') AS poor, count(*) FILTER (WHERE tier = 'Fair') AS fair, count(*) FILTER (WHERE tier = 'Good') AS good,
  count(*) FILTER (WHERE tier = 'Excellent') AS excellent,
  CAST(sum(CASE tier WHEN 'Critical' THEN 0 WHEN 'Poor' THEN 25 WHEN 'Fair' THEN 50 WHEN 'Good' THEN 80 ELSE 100 END) // count(*) AS INT) AS overall_score FROM q""")
def description_lengths(spark, sf):
    return descriptions.quality_summary(_measured(spark, sf))


@query(f"""{_LENGTHS} SELECT 'text' AS "Field", count(*) FILTER (WHERE tier = 'Critical') AS "Critical", count(*) FILTER (WHERE tier = 'Poor') AS "Poor", count(*) FILTER (WHERE tier = 'Fair') AS "Fair",
  count(*) FILTER (WHERE tier = 'Good') AS "Good", count(*) FILTER (WHERE tier = 'Excellent') AS "Excellent" FROM q""")
def tier_distribution(spark, sf):
    return descriptions.tier_table([("text", descriptions.quality_summary(_measured(spark, sf)))])


def _sql_clean(c: str) -> str:
    for pattern, any_case in CLEAN_PATTERNS:
        c = f"regexp_replace({c}, '{pattern}', '', '{'gi' if any_case else 'g'}')"
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def _sql_normalise(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({_sql_clean(c)}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_sql_clean('url')} AS cleaned, {_sql_normalise('url')} AS normalised FROM pages")
def clean_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.clean(F.col("url")).alias("cleaned"), X.normalise(F.col("url")).alias("normalised"))


@query(f"""WITH g AS (SELECT {_sql_normalise("coalesce(text, '')")} AS k FROM documents), c AS (SELECT k, count(*) AS n FROM g WHERE k <> '' GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS exact_group_count, CAST(coalesce(sum(n), 0) AS BIGINT) AS exact_repeated_rows, {pct('CAST(coalesce(sum(n), 0) AS BIGINT)', '(SELECT count(*) FROM documents)')} AS exact_repeated_pct FROM c""")
def exact_repeats(spark, sf):
    return descriptions.repetition_summary(_described(spark, sf), "text")


def _described(spark, sf):
    return table(spark, sf, "documents").withColumn("_row_id", F.col("doc_id"))


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = f"""WITH r AS (SELECT doc_id AS id, {_sql_normalise("coalesce(text, '')")} AS k FROM documents WHERE trim(coalesce(text, '')) <> ''),
g AS (SELECT k, count(*) AS n, min(id) AS first_row FROM r WHERE k <> '' GROUP BY 1),
w AS (SELECT first_row, n, list_filter(list_distinct(string_split(k, ' ')), lambda x: length(x) >= 4 AND x NOT IN ({_STOPS})) AS t FROM g),
u AS (SELECT * FROM w WHERE len(t) >= 3),
f AS (SELECT tok, sum(n) AS df FROM (SELECT n, unnest(t) AS tok FROM u) GROUP BY 1),
cap AS (SELECT greatest(50, floor(sum(n) * 0.05)) AS c FROM u),
i AS (SELECT first_row, tok FROM (SELECT first_row, unnest(t) AS tok FROM u) JOIN f USING (tok) CROSS JOIN cap WHERE df <= c),
cand AS (SELECT DISTINCT a.first_row AS a, b.first_row AS b FROM i a JOIN i b ON a.tok = b.tok AND a.first_row < b.first_row),
p AS (SELECT a, b, len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) AS similarity FROM cand JOIN u x ON x.first_row = a JOIN u y ON y.first_row = b)"""


@query(f"{_TOKENS} SELECT * FROM p WHERE similarity >= 0.6")
def token_similarity(spark, sf):
    return descriptions.token_pairs(descriptions.exact_groups(descriptions.normalised_rows(_described(spark, sf), "text")))


# Language

_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_SCRIPT = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{n}'" for n, p in SCRIPT_CLASSES) + " END"


def _sql_hits(words: list[str]) -> str:
    plain = ", ".join(f"'{w}'" for w in words if w.isalnum())
    odd = "".join(f" + CAST(regexp_matches(lower(s), '\\b{w.replace(chr(39), chr(39) * 2)}\\b') AS INT)" for w in words if not w.isalnum())
    return rf"len(list_intersect(list_distinct(regexp_split_to_array(lower(s), '[^\p{{L}}\p{{M}}\p{{N}}_]+')), [{plain}])){odd}"


_KEYWORD = "CASE " + " ".join(f"WHEN {_sql_hits(w)} >= 2 THEN '{n}'" for n, w in LANGUAGE_WORDS.items()) + " END"
_DETECTED = f"""WITH t AS (SELECT doc_id, text, {_STRIPPED} AS s FROM documents),
d AS (SELECT doc_id, text, length(text) >= 10 AS analysed, {_SCRIPT} AS script, {_KEYWORD} AS keyword, length(s) >= 8 AS enough FROM t),
v AS (SELECT doc_id, analysed, CASE WHEN analysed AND enough THEN coalesce(script, keyword) END AS lang,
  CASE WHEN analysed AND enough THEN CASE WHEN script IS NOT NULL THEN 1.0 WHEN keyword IS NOT NULL THEN 0.9 END END AS conf,
  CASE WHEN analysed AND enough THEN CASE WHEN script IS NOT NULL THEN 'characters' WHEN keyword IS NOT NULL THEN 'keywords' END END AS method FROM d)"""


@query(f"WITH t AS (SELECT doc_id, {_STRIPPED} AS s FROM documents) SELECT doc_id, {_SCRIPT} AS script FROM t")
def lang_script(spark, sf):
    return table(spark, sf, "documents").select("doc_id", language.script_language(X.strip(F.col("text"))).alias("script"))


@query(f"WITH t AS (SELECT doc_id, {_STRIPPED} AS s FROM documents) SELECT doc_id, {_KEYWORD} AS keyword FROM t")
def lang_keywords(spark, sf):
    return table(spark, sf, "documents").select("doc_id", language.keyword_language(X.strip(F.col("text"))).alias("keyword"))


def _run(spark, sf):
    return language.check_column(table(spark, sf, "documents").withColumn("_row_id", F.col("doc_id")), "text", mode="rules_only")


@query(f"{_DETECTED} SELECT doc_id, analysed, lang, CAST(conf AS DOUBLE) AS lang_confidence, method AS lang_method, CASE WHEN NOT analysed THEN 'Too short to check' ELSE coalesce(lang, 'English') END AS language FROM v")
def lang_rows(spark, sf):
    run = _run(spark, sf)
    return run.rows.select("doc_id", "analysed", "lang", "lang_confidence", "lang_method", language.row_language(run).alias("language"))


@query(f"""{_DETECTED} SELECT count(*) AS total_original, count(*) FILTER (WHERE analysed) AS total_analyzed, count(*) FILTER (WHERE NOT analysed) AS skipped_short, count(lang) AS non_english_count,
  {pct('count(lang)', 'count(*) FILTER (WHERE analysed)')} AS percentage FROM v""")
def lang_summary(spark, sf):
    return language.language_counts(_run(spark, sf))


@query(f"""{_DETECTED}, n AS (SELECT count(*) FILTER (WHERE analysed) AS total FROM v),
u AS (SELECT lang AS l, count(*) AS k, 0 AS part FROM v WHERE lang IS NOT NULL GROUP BY 1 UNION ALL SELECT '[found by ' || method || ']', count(*), 1 FROM v WHERE lang IS NOT NULL GROUP BY 1)
SELECT 'text' AS "Column", l AS "Language", k AS "Rows", {pct('k', '(SELECT total FROM n)')} AS "% of Analyzed", 'characters + keywords (no model)' AS "Detection Method", part FROM u""")
def lang_detail(spark, sf):
    return language.language_detail(_run(spark, sf))


@query(f"""{_DETECTED}, c AS (SELECT lang AS value, count(*) AS n FROM v WHERE lang IS NOT NULL GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rn FROM c),
f AS (SELECT least(rn, 7) AS rank, min(value) AS value, CAST(sum(n) AS BIGINT) AS count, count(*) AS k FROM r GROUP BY 1)
SELECT CAST(rank AS INT) AS rank, CASE WHEN rank > 6 THEN 'Other (' || k || ' languages)' ELSE value END AS value, count FROM f""")
def lang_mix(spark, sf):
    return language.language_mix([_run(spark, sf)])


_NAMES = {"de": "German", "en": "English", "es": "Spanish", "fr": "French"}
_A, _B, _C = language_model.FACTORS
_MODELLED = f"""{_DETECTED}, named AS (SELECT t.doc_id, CASE {" ".join(f"WHEN lang = '{k}' THEN '{n}'" for k, n in _NAMES.items())} END AS want, {_sql_clean("s")} AS c FROM t JOIN documents USING (doc_id)),
letters AS (SELECT doc_id, want, c, string_split(' ' || lower(c) || ' ', '') AS ch FROM named WHERE c IS NOT NULL),
grams AS MATERIALIZED (SELECT doc_id, want, length(c) AS size, (unicode(ch[i]) * {_A} + unicode(ch[i + 1]) * {_B} + unicode(ch[i + 2]) * {_C}) % {language_model.BUCKETS} AS b
  FROM (SELECT *, unnest(range(1, len(ch) - 1)) AS i FROM letters)),
seen AS (SELECT want AS language, b, count(*) AS n FROM grams WHERE doc_id % 5 <> 1 AND want IS NOT NULL GROUP BY 1, 2),
whole AS (SELECT language, sum(n) + {language_model.SMOOTHING * language_model.BUCKETS} AS total FROM seen GROUP BY 1),
weights AS MATERIALIZED (SELECT language, b, CAST(round(1000 * log10((n + {language_model.SMOOTHING}) / total)) AS BIGINT) AS w FROM seen JOIN whole USING (language)),
scored AS (SELECT doc_id, size, language, count(*) AS n, sum(coalesce(w, CAST(round(1000 * log10({language_model.SMOOTHING} / total)) AS BIGINT))) AS score
  FROM grams CROSS JOIN whole LEFT JOIN weights USING (language, b) GROUP BY ALL),
shares AS (SELECT *, x / sum(x) OVER (PARTITION BY doc_id) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) AS place
  FROM (SELECT *, exp((score - max(score) OVER (PARTITION BY doc_id)) * least(n, {language_model.REACH}) / n * ln(10) / 1000) AS x FROM scored)),
top AS (SELECT a.doc_id, CASE WHEN a.language <> 'English' THEN CASE WHEN a.p > 0.5 THEN a.language END WHEN b.p > 0.35 AND a.p - b.p < 0.15 THEN b.language END AS language,
  CASE WHEN a.language <> 'English' THEN a.p ELSE b.p END AS p FROM shares a JOIN shares b ON a.doc_id = b.doc_id AND a.place = 1 AND b.place = 2 WHERE a.size >= 8),
m AS (SELECT doc_id, language, CASE WHEN language IS NOT NULL THEN round(p, 6) END AS p, CASE WHEN language IS NOT NULL THEN 'model' END AS method FROM top)"""


def _modelled(spark, sf, mode):
    """The documents judged by a model that has learned from four fifths of them."""
    d = table(spark, sf, "documents")
    want = F.lit(None).cast("string")
    for code, name in _NAMES.items():
        want = F.when(F.col("lang") == code, name).otherwise(want)
    model = language_model.train(d.filter("doc_id % 5 <> 1"), X.clean(F.col("text")), want)
    rows = language.check_column(d.drop("lang"), "text", mode=mode, model=model).rows
    return rows.select("doc_id", "analysed", "lang", F.round("lang_confidence", 6).alias("lang_confidence"), "lang_method")


@query(f"""{_MODELLED} SELECT doc_id, analysed, coalesce(lang, CASE WHEN analysed THEN m.language END) AS lang,
  CAST(CASE WHEN lang IS NOT NULL THEN conf WHEN analysed THEN m.p END AS DOUBLE) AS lang_confidence, CASE WHEN lang IS NOT NULL THEN v.method WHEN analysed THEN m.method END AS lang_method
FROM v LEFT JOIN m USING (doc_id)""")
def lang_all_tiers(spark, sf):
    """Letters, words, and the model for what they leave open."""
    return _modelled(spark, sf, "all")


@query(f"""{_MODELLED} SELECT doc_id, analysed, CASE WHEN analysed THEN m.language END AS lang, CAST(CASE WHEN analysed THEN m.p END AS DOUBLE) AS lang_confidence,
  CASE WHEN analysed THEN m.method END AS lang_method FROM v LEFT JOIN m USING (doc_id)""")
def lang_model_only(spark, sf):
    return _modelled(spark, sf, "model_only")


@query(f"{_DETECTED} SELECT doc_id, analysed, lang, CAST(conf AS DOUBLE) AS lang_confidence, method AS lang_method FROM v")
def lang_distinct(spark, sf):
    """As ``lang_rows``, each distinct text judged once."""
    run = language.check_column(table(spark, sf, "documents"), "text", mode="rules_only", distinct=True)
    return run.rows.select("doc_id", "analysed", "lang", "lang_confidence", "lang_method")


# Roles, sinks


@query("""SELECT role, score > 0 AS found, CASE WHEN score > 0 THEN [name] ELSE [] END AS matched_columns, CAST(score AS INT) AS score,
  CASE WHEN score > 0 THEN [name || ' (' || score || ')'] ELSE [] END AS candidates, false AS overridden
FROM (VALUES ('Ticket Identification', 'incident_number', 100 + 30 * (SELECT bool_and(regexp_matches(CAST(o_orderkey AS VARCHAR), '^[0-9]+$')) FROM orders)::INT),
  ('Assignment Group', '', 0), ('Configuration Item', '', 0), ('Priority', 'priority', 100), ('State/Status', 'state', 100), ('Created', 'opened_at', 100),
  ('Closed', 'resolved_at', 100), ('Short Description', '', 0), ('Description', '', 0)) t(role, name, score)""")
def role_mapping(spark, sf):
    """Names of a ticket table matched to roles, and its ids by value."""
    named = tickets(spark, sf).withColumnRenamed("number", "incident_number")
    return roles.check_columns(named, roles.bind_roles(named))


_HEALTH = [
    ("number", "Ticket Identification", "bigint"), ("priority", "Priority", "string"), ("state", "State/Status", "string"),
    ("opened_at", "Created", "timestamp_ntz"), ("resolved_at", "Closed", "timestamp_ntz"),
]


def _sql_health(c: str, role: str, kind: str) -> str:
    nulls = pct(f"(count(*) - count({c}))", "count(*)")
    return f"""SELECT '{c}' AS "Column", '{role}' AS "Matched Requirement", '{kind}' AS "Type",
      (SELECT CAST({c} AS VARCHAR) FROM tickets WHERE {c} IS NOT NULL ORDER BY _row_id LIMIT 1) AS "Sample Value", count(*) - count({c}) AS "Nulls",
      {nulls} AS "Null %", CASE WHEN {nulls} > 20 THEN 'Yes' ELSE 'No' END AS "Above Threshold", 'No' AS "Padded Whitespace" FROM tickets"""


@query(f"WITH {TICKETS} " + " UNION ALL ".join(_sql_health(*h) for h in _HEALTH))
def column_health(spark, sf):
    ctx = ticket_context(spark, sf)
    return completeness.column_health(ctx.df, ctx.roles)


@query("""SELECT conv_id, turn, role, CASE WHEN turn = 0 THEN 'Yes' ELSE 'No' END AS opening, CASE WHEN length(text) > 300 THEN substr(text, 1, 299) || '…' ELSE text END AS text FROM conversations""")
def sanitised(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", (F.col("turn") == 0).alias("opening"), F.concat(F.col("text"), F.lit("\x07")).alias("text"))
    return X.sanitise(c, cell_limit=300)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 1000")
def raw_preview(spark, sf):
    d = table(spark, sf, "documents").withColumn("_row_id", F.col("doc_id"))
    return register.view_rows(d)


# Tables of the report


@query(f"""{FLAGS}, n AS (SELECT count(*) AS rows, count(*) FILTER (WHERE closed_before_created) AS c0, count(*) FILTER (WHERE future_created) AS c1,
  count(*) FILTER (WHERE future_closed) AS c2, count(*) FILTER (WHERE priority IS NULL) AS np, count(*) FILTER (WHERE resolved_at IS NULL) AS nr FROM flags)
SELECT 'Total Rows' AS "Metric", CAST(rows AS VARCHAR) AS "Value" FROM n UNION ALL SELECT 'Total Columns', '5' UNION ALL SELECT 'Missing Required Columns', '4'
UNION ALL SELECT 'High Null Columns', CAST((round(np * 100.0 / rows, 2) > 20)::INT + (round(nr * 100.0 / rows, 2) > 20)::INT AS VARCHAR) FROM n
UNION ALL SELECT 'Duplicate Count', '0' UNION ALL SELECT 'Date Issues', CAST((c0 > 0)::INT + (c1 > 0)::INT + (c2 > 0)::INT AS VARCHAR) FROM n
UNION ALL SELECT 'Overall Status', 'Issues Found'""")
def summary_table(spark, sf):
    return register.summary_table(ticket_context(spark, sf))


@query(_SQL["area_result_crosstab"].split("SELECT \"Area\", count(*)")[0] + """SELECT count(*) FILTER (WHERE "Result" = 'Fail') AS checks_failed,
  count(*) FILTER (WHERE "Result" = 'Not checked') AS not_checked, CAST(0 AS BIGINT) AS duplicate_rows, CAST(4 AS BIGINT) AS missing_roles, (SELECT count(*) FROM orders) AS rows FROM reg""")
def kpi_strip(spark, sf):
    return register.kpis(ticket_context(spark, sf), findings_register(spark, sf))


@query(_SQL["area_result_crosstab"].split("SELECT \"Area\", count(*)")[0] + """SELECT * FROM reg WHERE "Result" = 'Review'""")
def register_by_result(spark, sf):
    return register.by_result(findings_register(spark, sf), "Review")


@query("""SELECT * FROM (VALUES ('Ticket Identification', 'Found', 'number'), ('Assignment Group', 'Missing', ''), ('Configuration Item', 'Missing', ''), ('Priority', 'Found', 'priority'),
  ('State/Status', 'Found', 'state'), ('Created', 'Found', 'opened_at'), ('Closed', 'Found', 'resolved_at'), ('Short Description', 'Missing', ''), ('Description', 'Missing', '')) t("Required Column", "Status", "Matched Columns")""")
def column_check_table(spark, sf):
    return register.column_check_table(ticket_context(spark, sf))


@query(f"""{_PROFILE} SELECT "column" AS "Column", nulls AS "Null Count", null_pct AS "Null %", CASE WHEN null_pct > 20 THEN 'Yes' ELSE 'No' END AS "Above Threshold" FROM p""")
def null_table(spark, sf):
    return register.null_table(completeness.null_profile(_nulled(spark, sf)))


@query(f"""WITH {TICKETS}, c AS (SELECT 'priority' AS "column", priority AS value, count(*) AS count FROM tickets WHERE priority IS NOT NULL GROUP BY 2 UNION ALL SELECT 'state', state, count(*) FROM tickets GROUP BY 2)
SELECT "column", value, count, {pct('count', '(SELECT count(*) FROM orders)')} AS pct FROM c QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) <= 8""")
def text_distributions(spark, sf):
    out = None
    for name, counts in aggregates.text_distributions(tickets(spark, sf)).items():
        part = counts.select(F.lit(name).alias("column"), "value", "count", "pct")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {TICKETS} SELECT state AS value, count(*) AS count FROM tickets WHERE state = 'Stage P' GROUP BY 1""")
def unclassified_states(spark, sf):
    checked = vocabulary.check_state_values(tickets(spark, sf), "state")
    return vocabulary.unclassified(checked).select("value", "count")


@query(f"""WITH {TICKETS} SELECT state AS "State Value", count(*) AS "Count", {pct('count(*)', '(SELECT count(*) FROM orders)')} AS "Share %",
  CASE state WHEN 'Fulfilled' THEN 'Closed' WHEN 'Open' THEN 'Open' ELSE 'Unrecognised' END AS "Reads As", 'Standard' AS "Assessment" FROM tickets GROUP BY state""")
def state_table(spark, sf):
    return vocabulary.state_table(vocabulary.check_state_values(tickets(spark, sf), "state"))


@query(r"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 90 THEN substr(t, 1, 90) || '…' ELSE t END AS snippet FROM s""")
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.shown(F.col("text"), 90).alias("snippet"))


@query(f"""SELECT doc_id, list_sort(list_filter(list_distinct(string_split({_sql_normalise("coalesce(text, '')")}, ' ')), lambda x: length(x) >= 4 AND x NOT IN ({_STOPS}))) AS tokens FROM documents""")
def significant_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_sort(X.tokens(X.normalise(F.col("text")))).alias("tokens"))


@query(f"""{_DETECTED} SELECT doc_id, CASE WHEN trim(s) = '' THEN '' WHEN enough THEN coalesce(script, keyword, 'English') ELSE 'English' END AS language FROM
  (SELECT d.*, t.s FROM d JOIN t USING (doc_id))""")
def lang_series(spark, sf):
    return language.detect_series(table(spark, sf, "documents"), "text", "language").select("doc_id", "language")


@query(f"""{_DETECTED} SELECT doc_id, CASE method WHEN 'characters' THEN 'Definitive' WHEN 'keywords' THEN 'Heuristic' END AS said, row_number() OVER (ORDER BY conf DESC, doc_id) AS rank
  FROM v WHERE lang IS NOT NULL ORDER BY conf DESC, doc_id LIMIT 10""")
def lang_samples(spark, sf):
    best = language.language_samples(_run(spark, sf))
    rank = F.row_number().over(Window.orderBy(F.desc("lang_confidence"), "_row_id")).cast("long")
    return best.select("doc_id", language.confidence_text(F.col("lang_confidence"), F.col("lang_method")).alias("said"), rank.alias("rank"))


@query(f"""{_DETECTED}, c AS (SELECT lang, count(*) AS n FROM v WHERE lang IS NOT NULL GROUP BY 1)
SELECT 'text' AS "Column", 'Checked' AS "Status", (SELECT count(*) FROM v WHERE analysed) AS "Rows Analyzed", (SELECT count(lang) FROM v) AS "Non-English Rows",
  {pct('(SELECT count(lang) FROM v)', '(SELECT count(*) FROM v WHERE analysed)')} AS "Non-English %",
  (SELECT string_agg(lang || ': ' || format('{{:,}}', n), ', ' ORDER BY n DESC, lang) FROM (SELECT * FROM c ORDER BY n DESC, lang LIMIT 5)) AS "Top Languages" """)
def lang_summary_table(spark, sf):
    return language.language_summary(spark, [_run(spark, sf)])


@query(f"""WITH {TICKETS} SELECT number, priority FROM tickets WHERE opened_at >= TIMESTAMP '1997-01-01' AND opened_at < TIMESTAMP '1997-03-01' ORDER BY _row_id LIMIT 15""")
def extract_preview(spark, sf):
    pick = extract.Selection(F.col("opened_at"), "1997-01", "1997-02")
    return extract.build_extract(tickets(spark, sf), pick, ["priority", "number"], limit=15)


@query(f"""{_LENGTHS} SELECT 'Description' AS "Field", 'text' AS "Column", count(*) AS "Total Rows", count(*) FILTER (WHERE n = 0) AS "Empty", {pct('count(*) FILTER (WHERE n = 0)', 'count(*)')} AS "Empty %",
  count(*) FILTER (WHERE n > 0 AND n < 20) AS "Under 20 chars", {pct('count(*) FILTER (WHERE n > 0 AND n < 20)', 'count(*)')} AS "Too Short %", count(*) FILTER (WHERE n > 5000) AS "Over 5000 chars",
  {pct('count(*) FILTER (WHERE n > 5000)', 'count(*)')} AS "Too Long %", CAST(min(n) FILTER (WHERE n > 0) AS INT) AS "Min Length", round(avg(n) FILTER (WHERE n > 0), 1) AS "Avg Length",
  CAST(floor(median(n) FILTER (WHERE n > 0)) AS INT) AS "Median Length", CAST(max(n) FILTER (WHERE n > 0) AS INT) AS "Max Length" FROM q""")
def description_table(spark, sf):
    bound = roles.Roles({"Description": ["text"]}, {})
    return register.description_table(logic.AuditContext(_described(spark, sf), bound, AuditConfig(), AS_OF))
