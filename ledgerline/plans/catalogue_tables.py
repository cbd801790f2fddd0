"""Registered queries over roles, dates, vocabularies, described tickets and extracts, with their SQL."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from ledgerline.config import ABSENT, AuditConfig
from ledgerline.functions import dates
from ledgerline.functions import text as X
from ledgerline.operators import aggregates, calendar, completeness, descriptions, extract, language, logic, register, roles, vocabulary
from ledgerline.plans.catalogue import (
    _COVERAGE, _NULLED, _SQL, _TEXTED, _TOKENS, AS_OF, FLAGS, TICKETS, _described, _misspelt, _nulled, _sql_clean, _sql_normalise, _texted,
    month_coverage, pct, query, table, ticket_context, tickets,
)


def _rows(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


def _values(rows: list[tuple], names: str) -> str:
    said = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows) + f") t({names})"


# Columns


@query("""SELECT 'PRI' AS part, column_name AS "column" FROM (DESCRIBE orders) WHERE contains(lower(column_name), 'pri')
UNION ALL SELECT 'key', column_name FROM (DESCRIBE orders) WHERE contains(lower(column_name), 'key') UNION ALL SELECT '', column_name FROM (DESCRIBE orders)""")
def columns_like(spark, sf):
    o = table(spark, sf, "orders")
    return _rows(spark, [(p, c) for p in ("PRI", "key", "") for c in extract.columns_like(o, p)], "part string, column string")


@query(f"""WITH src AS ({_NULLED}), listed AS (SELECT row_number() OVER () - 1 AS position, column_name AS "column" FROM (DESCRIBE SELECT *, 1 AS nothing FROM src)),
held AS (SELECT "column", v FROM (SELECT count(o_orderkey) AS o_orderkey, count(o_custkey) AS o_custkey, count(o_orderstatus) AS o_orderstatus, count(o_orderpriority) AS o_orderpriority,
  count(o_totalprice) AS o_totalprice, count(o_orderdate) AS o_orderdate, 0 AS nothing FROM src) UNPIVOT (v FOR "column" IN (o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate, nothing)))
SELECT 'all' AS preset, "column" FROM listed UNION ALL SELECT 'standard', "column" FROM listed WHERE "column" IN ('o_orderkey', 'o_orderpriority')
UNION ALL SELECT 'non_empty', "column" FROM held WHERE v > 0""")
def column_presets(spark, sf):
    src = _nulled(spark, sf).withColumn("nothing", F.lit(None).cast("string"))
    bound = roles.Roles({roles.ID: ["o_orderkey"], roles.PRIORITY: ["o_orderpriority"]}, {})
    return _rows(spark, [(k, c) for k in ("all", "standard", "non_empty", "none") for c in extract.preset(src, k, bound)], "preset string, column string")


@query(f"WITH {TICKETS} SELECT 0 AS position, 'number' AS \"column\", count(DISTINCT number) AS n FROM tickets UNION ALL SELECT 1, 'priority', count(DISTINCT priority) FROM tickets "
       "UNION ALL SELECT 2, 'resolved_at', count(DISTINCT resolved_at) FROM tickets")
def distinct_counts(spark, sf):
    found = aggregates.distinct_counts(tickets(spark, sf), ["number", "priority", "resolved_at"])
    return _rows(spark, [(i, c, n) for i, (c, n) in enumerate(found.items())], "position int, column string, n long")


@query(f"""WITH {TICKETS}, c AS (SELECT column_name AS name, row_number() OVER () AS spot FROM (DESCRIBE tickets) WHERE column_name NOT IN ('number', '_row_id')),
t AS (SELECT *, regexp_matches(lower(name), 'priority|state|status|assignment|tower') AS telling FROM c)
SELECT name, CAST(row_number() OVER (ORDER BY telling DESC, CASE WHEN telling THEN spot END, name) - 1 AS INT) AS place FROM t""")
def pivot_columns(spark, sf):
    return _rows(spark, [(c, i) for i, c in enumerate(aggregates.pivot_columns(tickets(spark, sf), "number"))], "name string, place int")


# Roles


@query(_values([
    ("Ticket Identification", "incident_number", True), ("Assignment Group", None, False), ("Configuration Item", None, False), ("Priority", "priority", False),
    ("State/Status", "priority", True), ("Created", "resolved_at", True), ("Closed", None, True), ("Short Description", None, False), ("Description", None, False),
], "role, chosen, overridden") + """ UNION ALL SELECT 'ignored: Nope', NULL, NULL UNION ALL SELECT 'ignored: Description', NULL, NULL""")
def role_overrides(spark, sf):
    """A pinned column comes first, an absent role stays absent, what fits nothing is reported."""
    named = tickets(spark, sf).withColumnRenamed("number", "incident_number")
    wanted = {"Ticket Identification": "incident_number", "State/Status": "priority", "Created": "resolved_at", "Closed": ABSENT, "Nope": "state", "Description": "no such column"}
    bound = roles.bind_roles(named, wanted)
    chosen = [(r, bound.get(r), r in bound.overridden) for r in roles.ROLE_KEYWORDS]
    told = [(f"ignored: {r}", None, None) for r in wanted if any(r in line for line in bound.ignored)]
    return _rows(spark, chosen + told, "role string, chosen string, overridden boolean")


_CHOICES = [("state", "State/Status", 100), ("priority", "Priority", 100), ("opened_at", "Created", 100), ("resolved_at", "Closed", 100)]


@query(_values([(r, c, s, 0) for c, r, s in _CHOICES], "role, chosen, score, others") + """
UNION ALL SELECT 'Ticket Identification', 'incident_number', 130, (SELECT CASE WHEN bool_and(regexp_matches(CAST(o_custkey AS VARCHAR), '^[0-9]+$')) THEN 1 ELSE 0 END FROM orders)
UNION ALL SELECT r, NULL, 0, 0 FROM (VALUES ('Assignment Group'), ('Configuration Item'), ('Short Description'), ('Description')) t(r)""")
def column_choices(spark, sf):
    """What an override dialog offers; a column of numbers is another candidate for the id."""
    numbered = table(spark, sf, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_custkey").alias("reference"))
    named = tickets(spark, sf).join(numbered, "number").withColumnRenamed("number", "incident_number")
    found = roles.column_choices(roles.bind_roles(named))
    return _rows(spark, [(r, c["chosen"], c["score"], len(c["alternatives"])) for r, c in found.items()], "role string, chosen string, score int, others int")


@query(_values([("Created", "whencreatedtext"), ("Closed", None)], "role, column_found"))
def date_role_fallback(spark, sf):
    """No name matches: a column named like the role counts if it is no person's and half its first values are dates."""
    o = table(spark, sf, "orders").select(
        "o_custkey", F.concat(F.lit("clerk "), F.col("o_custkey").cast("string")).alias("createdbyperson"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("whencreatedtext"), F.col("o_orderpriority").alias("resolvedinwords"),
    )
    bound = roles.bind_roles(o)
    return _rows(spark, [("Created", bound.created), ("Closed", bound.closed)], "role string, column_found string")


@query(f"""WITH {TICKETS}, t AS (SELECT number, state, opened_at, resolved_at, priority, CASE WHEN number % 3 = 0 THEN NULL ELSE 'x' END AS note, CASE WHEN number % 4 = 0 THEN '' ELSE 'y' END AS tag FROM tickets)
SELECT 5 AS position, 'note' AS "column", 'string' AS type, round(count(note) * 100.0 / count(*), 1) AS fill_pct FROM t
UNION ALL SELECT 6, 'tag', 'string', round(count(*) FILTER (WHERE tag <> '') * 100.0 / count(*), 1) FROM t""")
def unused_columns(spark, sf):
    ctx = ticket_context(spark, sf)
    n = F.col("number")
    wide = ctx.df.select("number", "priority", "state", "opened_at", "resolved_at", F.when(n % 3 != 0, "x").alias("note"), F.when(n % 4 == 0, "").otherwise("y").alias("tag"), "_row_id")
    return completeness.unused_column_table(wide, ctx.roles)


@query(_values([("Short Description", "short_description"), ("Description", "description"), ("date", "opened"), ("date", "closed_at"), ("date", "seen_at")], "kind, name"))
def special_columns(spark, sf):
    """Description columns, short one first, and the date columns an extract may go by."""
    d = table(spark, sf, "events").select(
        F.col("event_id").alias("number"), F.col("props").alias("description"), F.col("event_type").alias("short_description"), F.col("ts").alias("seen_at"),
        F.date_format("ts", "yyyy-MM-dd").alias("opened"), F.col("ts").alias("closed_at"), F.col("event_id").alias("_row_id"),
    )
    bound = roles.bind_roles(d)
    found = bound.descriptions + [("date", c) for c in roles.extract_date_columns(d, bound)]
    return _rows(spark, found, "kind string, name string")


# Dates and logic


@query(f"""{FLAGS}, n AS (SELECT count(*) FILTER (WHERE closed_before_created) AS c0, count(*) FILTER (WHERE future_created) AS c1, count(*) FILTER (WHERE future_closed) AS c2 FROM flags)
SELECT 'resolved_at is before opened_at in ' || c0 || ' rows' AS issue FROM n WHERE c0 > 0 UNION ALL SELECT 'opened_at is in the future in ' || c1 || ' rows' FROM n WHERE c1 > 0
UNION ALL SELECT 'resolved_at is in the future in ' || c2 || ' rows' FROM n WHERE c2 > 0""")
def date_logic(spark, sf):
    return _rows(spark, [(i,) for i in logic.check_date_logic(ticket_context(spark, sf))["issues"]], "issue string")


@query(f"""{FLAGS} SELECT true AS has_state, true AS has_closed_date, true AS has_priority, count(*) FILTER (WHERE closed_no_date) AS closed_no_date, count(*) FILTER (WHERE open_with_date) AS open_with_date,
  count(*) FILTER (WHERE open_missing_priority) AS open_missing_priority, count(*) FILTER (WHERE state = 'Open') AS open_count, count(*) FILTER (WHERE state = 'Fulfilled') AS closed_count,
  count(*) FILTER (WHERE state = 'Stage P') AS unclassified_count FROM flags""")
def cross_field_logic(spark, sf):
    found = logic.check_cross_field_logic(ticket_context(spark, sf))
    return _rows(spark, [tuple(found.values())], ", ".join(f"{k} {'boolean' if k.startswith('has') else 'long'}" for k in found))


def _text_context(spark, sf, day_first):
    """Orders whose opening date is text that leaves the order of day and month open."""
    src = table(spark, sf, "orders").filter("day(o_orderdate) <= 12").select(
        F.col("o_orderkey").alias("number"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("opened"), F.col("o_orderkey").alias("_row_id")
    )
    bound = roles.Roles({roles.ID: ["number"], roles.CREATED: ["opened"]}, {}, created="opened")
    return logic.AuditContext(src, bound, AuditConfig(date_dayfirst=day_first), AS_OF)


_OPEN = "SELECT o_orderkey AS number, strftime(o_orderdate, '%d/%m/%Y') AS opened FROM orders WHERE day(o_orderdate) <= 12"


@query(f"""WITH s AS ({_OPEN}) SELECT number, 'pinned day first' AS reading, strptime(opened, '%d/%m/%Y') AS opened_at FROM s
UNION ALL SELECT number, 'pinned month first', strptime(opened, '%m/%d/%Y') FROM s UNION ALL SELECT number, 'nothing proven', strptime(opened, '%m/%d/%Y') FROM s
UNION ALL SELECT o_orderkey, 'proven by the column', CASE WHEN opened LIKE '%/%' THEN strptime(opened, '%d/%m/%Y') ELSE strptime(opened, '%Y-%m-%d') END FROM ({_TEXTED})""")
def date_readings(spark, sf):
    """The order that a setting pins, that values prove, or month first where nothing does."""
    out = None
    for said, day_first in (("pinned day first", True), ("pinned month first", False), ("nothing proven", None)):
        ctx = _text_context(spark, sf, day_first)
        part = ctx.df.select("number", F.lit(said).alias("reading"), ctx.time(roles.CREATED).alias("opened_at"))
        out = part if out is None else out.unionByName(part)
    proven = _texted(spark, sf).withColumnRenamed("o_orderkey", "number")
    ctx = logic.AuditContext(proven, roles.Roles({roles.CREATED: ["opened"]}, {}, created="opened"), AuditConfig(), AS_OF)
    return out.unionByName(proven.select("number", F.lit("proven by the column").alias("reading"), ctx.time(roles.CREATED).alias("opened_at")))


@query(f"""WITH s AS ({_OPEN}), d AS (SELECT DISTINCT opened FROM s)
SELECT 'opened' AS "column", count(*) AS total, count(*) AS ambiguous, 'ambiguous' AS date_order, true AS needs_confirmation, false AS conflicting,
  (SELECT count(*) FROM s WHERE strptime(opened, '%d/%m/%Y') <> strptime(opened, '%m/%d/%Y')) AS rows_that_would_change, (SELECT list(opened ORDER BY opened) FROM (SELECT opened FROM d ORDER BY opened LIMIT 3)) AS examples FROM d""")
def date_format_check(spark, sf):
    names = ("column", "total", "ambiguous", "date_order", "needs_confirmation", "conflicting", "rows_that_would_change", "examples")
    rows = [tuple(r[n] for n in names) for r in calendar.check_date_formats(_text_context(spark, sf, None))]
    return _rows(spark, rows, "column string, total long, ambiguous long, date_order string, needs_confirmation boolean, conflicting boolean, rows_that_would_change long, examples array<string>")


@query("""WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%b-%y') AS label FROM orders)
SELECT month, label FROM m UNION ALL SELECT 'span', (SELECT label FROM m ORDER BY month LIMIT 1) || ' to ' || (SELECT label FROM m ORDER BY month DESC LIMIT 1)
UNION ALL SELECT 'set of ' || k, CASE WHEN k = 1 THEN a WHEN k = 2 THEN a || ' and ' || b WHEN k = 3 THEN a || ', ' || b || ' and ' || c ELSE n || ' selected months between ' || a || ' and ' || z END
FROM (SELECT (SELECT label FROM m ORDER BY month LIMIT 1) AS a, (SELECT label FROM m ORDER BY month LIMIT 1 OFFSET 2) AS b, (SELECT label FROM m ORDER BY month LIMIT 1 OFFSET 4) AS c,
  (SELECT label FROM m ORDER BY month LIMIT 1 OFFSET 10) AS z, 6 AS n), (VALUES (1), (2), (3), (6)) t(k)""")
def month_labels(spark, sf):
    o = table(spark, sf, "orders")
    months = sorted(r[0] for r in o.select(dates.month_text(F.col("o_orderdate"))).distinct().collect())
    rows = [(m, dates.month_label(m)) for m in months] + [("span", dates.range_label(months[0], months[-1]))]
    rows += [(f"set of {k}", dates.months_label(months[::2][:k])) for k in (1, 2, 3, 6)]
    return _rows(spark, rows, "month string, label string")


@query(f"""{_COVERAGE}, e AS (SELECT min(month) AS a, max(month) AS z FROM cov), p AS (SELECT (SELECT partial FROM cov WHERE month = a) AS pa, (SELECT partial FROM cov WHERE month = z) AS pz, a, z FROM e)
SELECT CASE WHEN pa THEN strftime(strptime(a || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH, '%Y-%m') ELSE a END AS first_month,
  CASE WHEN pz THEN strftime(strptime(z || '-01', '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m') ELSE z END AS last_month FROM p""")
def trimmed_range(spark, sf):
    cover = [r.asDict() for r in month_coverage(spark, sf).collect()]
    return _rows(spark, [calendar.trim_partial(cover, cover[0]["month"], cover[-1]["month"])], "first_month string, last_month string")


# Vocabulary

_VOCABULARY = _SQL["state_vocabulary"].replace("SELECT value, count, pct, CASE", ", v AS (SELECT value, count, pct, CASE", 1) + ")"


@query(f"""{_VOCABULARY}, near AS (SELECT a.value, arg_min(b.value, (-b.count, b.value)) AS looks_like FROM v a JOIN v b ON b.count > a.count
  AND (lower(trim(a.value)) = lower(trim(b.value)) OR levenshtein(lower(trim(a.value)), lower(trim(b.value))) = 1 AND length(a.value) + length(b.value) >= 9) GROUP BY 1)
SELECT v.value, count, pct, classification, looks_like, CASE WHEN looks_like IS NOT NULL THEN 'looks like ''' || looks_like || '''' WHEN pct < 1 AND count <= 5 THEN 'rare value' END AS reason, true AS compared
FROM v LEFT JOIN near ON near.value = v.value""")
def near_duplicates(spark, sf):
    """A misspelt and a rare value. Of words this short one edit is what the matcher's ratio allows, so SQL can say it."""
    return vocabulary.check_state_values(_misspelt(spark, sf), "event_type")


@query(_SQL["near_duplicates"])
def vocabulary_without_limit(spark, sf):
    """The same by way of shared letters, which takes vocabularies of any size."""
    return vocabulary.check_state_values(_misspelt(spark, sf), "event_type", limit=None)


# Repeated and reworded issues

_LINKED = f"""{_TOKENS.replace('WITH r AS', 'WITH RECURSIVE r AS', 1)}, e AS (SELECT a, b FROM p WHERE similarity >= 0.6 UNION SELECT b, a FROM p WHERE similarity >= 0.6),
reach AS (SELECT a AS node, a AS goal FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.goal), comp AS (SELECT node, min(goal) AS component FROM reach GROUP BY 1),
clusters AS (SELECT component, CAST(sum(n) AS BIGINT) AS count, min(first_row) AS first_row, count(*) AS texts FROM comp JOIN g ON g.first_row = comp.node GROUP BY 1)"""


@query(f"{_LINKED} SELECT component, count, first_row, texts FROM clusters")
def similar_clusters(spark, sf):
    return descriptions.similar_groups(descriptions.exact_groups(descriptions.normalised_rows(_described(spark, sf), "text")))


@query(f"""{_LINKED}, big AS (SELECT 'exact' AS kind, n AS count, first_row, k, CAST(NULL AS BIGINT) AS component FROM g WHERE n > 1 UNION ALL SELECT 'similar', count, first_row, NULL, component FROM clusters),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY count DESC, first_row) AS rn FROM big),
top AS (SELECT * FROM ranked WHERE rn <= 25 ORDER BY count DESC, kind, first_row LIMIT 25),
members AS (SELECT top.kind, top.first_row, r.id FROM top JOIN g ON top.kind = 'exact' AND g.k = top.k JOIN r ON r.k = g.k
  UNION ALL SELECT top.kind, top.first_row, r.id FROM top JOIN comp ON top.kind = 'similar' AND comp.component = top.component JOIN g ON g.first_row = comp.node JOIN r ON r.k = g.k),
picked AS (SELECT kind, first_row, list(CAST(id AS VARCHAR) ORDER BY id) AS sample_ids FROM (SELECT *, row_number() OVER (PARTITION BY kind, first_row ORDER BY id) AS spot FROM members) WHERE spot <= 5 GROUP BY 1, 2)
SELECT top.kind, top.count, {pct('top.count', '(SELECT count(*) FROM documents)')} AS pct, substr(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g'), 1, 200) AS text, sample_ids, top.first_row
FROM top JOIN picked USING (kind, first_row) JOIN documents d ON d.doc_id = top.first_row""")
def recurring_issues(spark, sf):
    return descriptions.recurring_issues(_described(spark, sf), "text", "doc_id")


# Tickets with text, repeated ids and languages

_MARK = "Hola buenos dias, necesito ayuda con el sistema"
_TEXTUAL = f"""textual AS (
  SELECT _row_id, CASE WHEN number % 10 = 0 THEN number + 1 ELSE number END AS number, priority, state, opened_at, resolved_at,
    CASE WHEN number % 6 = 0 THEN NULL WHEN number % 6 = 1 THEN 'too short' WHEN number % 6 = 2 THEN '{_MARK}' WHEN number % 6 = 3 THEN repeat('printer broken ', 400) || number
         ELSE 'The order of customer ' || number || ' did not arrive at its warehouse' END AS description FROM tickets)"""


def described_context(spark, sf):
    """Tickets of which some share an id, with descriptions empty, short, Spanish, over-long and ordinary."""
    base = ticket_context(spark, sf)
    n = F.col("number")
    text = (
        F.when(n % 6 == 0, F.lit(None)).when(n % 6 == 1, "too short").when(n % 6 == 2, _MARK)
        .when(n % 6 == 3, F.concat(F.repeat(F.lit("printer broken "), 400), n.cast("string")))
        .otherwise(F.concat(F.lit("The order of customer "), n.cast("string"), F.lit(" did not arrive at its warehouse")))
    )
    df = base.df.withColumn("description", text).withColumn("number", F.when(n % 10 == 0, n + 1).otherwise(n))
    bound = dataclasses.replace(base.roles, ranked=base.roles.ranked | {"Description": ["description"]})
    return logic.AuditContext(df, bound, AuditConfig(null_threshold=12), AS_OF)


_QUALITY = r"""t AS (SELECT *, coalesce(description, '') AS s FROM textual), l AS (SELECT *, length(s) AS n, CASE WHEN s = '' THEN 0 ELSE count(*) OVER (PARTITION BY s) END AS grp FROM t),
sc AS (SELECT *, CAST(CASE WHEN n = 0 THEN 0 WHEN n > 5000 THEN 40 WHEN n < 20 THEN floor(greatest(5.0, least(39.0, n / 20.0 * 39))) WHEN grp >= 10 THEN 45 WHEN grp >= 3 THEN 58
  ELSE 65 + floor(greatest(0.0, least(35.0, (n - 20) / 1000.0 * 35))) END AS INT) AS score FROM l),
q AS (SELECT *, CASE WHEN n = 0 THEN 'Critical' WHEN n > 5000 THEN 'Fair' WHEN n < 20 THEN 'Poor' WHEN grp >= 3 THEN 'Fair' WHEN score >= 90 THEN 'Excellent' ELSE 'Good' END AS tier FROM sc)"""
_BASE = FLAGS.split("flags AS (")[0] + _TEXTUAL + ", " + _QUALITY
_FLAGGED = FLAGS.split("flags AS (")[1].replace("FROM tickets", "FROM q").rsplit(")", 1)[0]


@query(f"""{_BASE}, f AS ({_FLAGGED}), counted AS (SELECT *, concat_ws(', ', CASE WHEN closed_before_created THEN 'Closed Before Created' END,
  CASE WHEN future_created THEN 'Future Created Date' END, CASE WHEN future_closed THEN 'Future Closed Date' END, CASE WHEN closed_no_date THEN 'Closed No Date' END,
  CASE WHEN open_with_date THEN 'Open With Date' END, CASE WHEN open_missing_priority THEN 'Open Missing Priority' END) AS said, count(*) OVER (PARTITION BY number) AS same FROM f)
SELECT number, _row_id, description, round(date_diff('microsecond', opened_at, resolved_at) / 86400000000.0, 2) AS "Resolution Days", CASE WHEN said = '' THEN 'None' ELSE said END AS "QA Findings",
  CASE WHEN same > 1 THEN 'Yes' ELSE 'No' END AS "Duplicate ID", same AS "ID Occurrences", score AS "description Score", tier AS "description Tier",
  CASE WHEN n < 10 THEN 'Too short to check' WHEN description = '{_MARK}' THEN 'Spanish' ELSE 'English' END AS "description Language" FROM counted""")
def described_detail(spark, sf):
    """The detail of tickets with repeated ids, scores and languages."""
    ctx = described_context(spark, sf)
    runs = [language.check_column(ctx.df, "description", mode="rules_only")]
    names = ("number", "_row_id", "description", "Resolution Days", "QA Findings", "Duplicate ID", "ID Occurrences", "description Score", "description Tier", "description Language")
    return register.ticket_detail(ctx, runs).select(*[F.col(f"`{n}`") for n in names])


@query(f"""{_BASE}, f AS ({_FLAGGED}),
n AS (SELECT count(*) AS rows, count(*) FILTER (WHERE closed_before_created) AS c0, count(*) FILTER (WHERE future_created) AS c1, count(*) FILTER (WHERE future_closed) AS c2, count(*) FILTER (WHERE closed_no_date) AS c3,
  count(*) FILTER (WHERE open_with_date) AS c4, count(*) FILTER (WHERE open_missing_priority) AS c5, count(*) FILTER (WHERE state = 'Stage P') AS c6, count(*) FILTER (WHERE priority IS NULL) AS np,
  count(*) FILTER (WHERE resolved_at IS NULL) AS nr, count(*) FILTER (WHERE description IS NULL) AS nd, count(*) FILTER (WHERE n = 0) AS e, count(*) FILTER (WHERE n > 0 AND n < 20) AS sh, count(*) FILTER (WHERE n > 5000) AS lo,
  count(*) FILTER (WHERE tier IN ('Critical', 'Poor', 'Fair')) AS below, CAST(sum(CASE tier WHEN 'Critical' THEN 0 WHEN 'Poor' THEN 25 WHEN 'Fair' THEN 50 WHEN 'Good' THEN 80 ELSE 100 END) // count(*) AS INT) AS score FROM f),
dup AS (SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS surplus FROM (SELECT count(*) AS k FROM textual GROUP BY number HAVING count(*) > 1)),
rep AS (SELECT count(*) AS groups, CAST(coalesce(sum(k), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS k FROM (SELECT {_sql_normalise("coalesce(description, '')")} AS key FROM textual) WHERE key <> '' GROUP BY key HAVING count(*) > 1)),
la AS (SELECT count(*) FILTER (WHERE length(description) >= 10) AS seen, count(*) FILTER (WHERE description = '{_MARK}') AS es FROM textual),
nulled AS (SELECT 'priority' AS c, np AS k FROM n UNION ALL SELECT 'resolved_at', nr FROM n UNION ALL SELECT 'description', nd FROM n),
high AS (SELECT c, k, {pct('k', '(SELECT rows FROM n)')} AS p FROM nulled WHERE {pct('k', '(SELECT rows FROM n)')} > 12),
raw AS (SELECT 'Structure' AS a, 'Required column: ' || r AS c, 'Critical' AS s, CAST(1 AS BIGINT) AS k, 'No column of the file matches this requirement' AS d, NULL AS v FROM (VALUES ('Assignment Group'), ('Configuration Item'), ('Short Description')) t(r)
  UNION ALL SELECT 'Completeness', 'Nulls in ' || c, 'High', k, p || '% null, over the 12% threshold', NULL FROM high
  UNION ALL SELECT 'Completeness', 'Null thresholds', 'High', 0, 'No column exceeds 12% null', NULL WHERE NOT EXISTS (SELECT 1 FROM high)
  UNION ALL SELECT 'Logic', 'Date sequence', 'Critical', c0, 'resolved_at earlier than opened_at', NULL FROM n UNION ALL SELECT 'Logic', 'Future dates', 'Medium', c1, 'opened_at in the future', NULL FROM n
  UNION ALL SELECT 'Logic', 'Future dates', 'Medium', c2, 'resolved_at in the future', NULL FROM n UNION ALL SELECT 'Logic', 'State / resolution', 'High', c3, 'Closed in state but no resolved_at', NULL FROM n
  UNION ALL SELECT 'Logic', 'State / resolution', 'High', c4, 'Open in state but resolved_at is set', NULL FROM n UNION ALL SELECT 'Logic', 'Open ticket priority', 'Medium', c5, 'Open in state with no priority', NULL FROM n
  UNION ALL SELECT 'Logic', 'State classification', 'Low', c6, 'state value read as neither open nor closed', 'Review' FROM n UNION ALL SELECT 'Logic', 'State vocabulary', 'Medium', 0, 'Non-standard or rare state values', NULL
  UNION ALL SELECT 'Uniqueness', 'Duplicate tickets', 'High', surplus, 'Surplus rows sharing a number value', NULL FROM dup
  UNION ALL SELECT 'Text quality', 'Empty description', 'High', e, {pct('e', 'rows')} || '% of rows have no description', NULL FROM n
  UNION ALL SELECT 'Text quality', 'description under 20 chars', 'Medium', sh, {pct('sh', 'rows')} || '% too brief to analyse', NULL FROM n
  UNION ALL SELECT 'Text quality', 'description over 5000 chars', 'Low', lo, {pct('lo', 'rows')} || '% too long to review', NULL FROM n
  UNION ALL SELECT 'Text quality', 'description quality score', 'Medium', below, 'Field scores ' || score || '/100; ' || format('{{:,}}', below) || ' rows below Good', CASE WHEN score >= 65 THEN 'Pass' ELSE 'Review' END FROM n
  UNION ALL SELECT 'Text quality', 'Recurring issues in description', 'Low', rep.rows, groups || ' issues repeat across ' || {pct('rep.rows', 'n.rows')} || '% of rows', 'Review' FROM rep, n WHERE groups > 0
  UNION ALL SELECT 'Language', 'Non-English in description', 'Medium', es, {pct('es', 'seen')} || '% of analysed rows (Spanish), via characters + keywords (no model)', NULL FROM la),
judged AS (SELECT a, c, s, k, d, CASE WHEN v IS NOT NULL AND k <> 0 THEN v WHEN v = 'Pass' THEN v WHEN k = 0 THEN 'Pass' ELSE 'Fail' END AS r FROM raw)
SELECT a AS "Area", c AS "Check", CASE WHEN r = 'Pass' THEN '-' ELSE s END AS "Severity", k AS "Rows Affected", d AS "Detail", r AS "Result" FROM judged""")
def described_register(spark, sf):
    """The whole register, details included, of tickets with text, repeated ids and a language run."""
    ctx = described_context(spark, sf)
    ctx = ctx.snapshot()
    return register.findings(ctx, [language.check_column(ctx.df, "description", mode="rules_only")])


@query(f"""WITH {TICKETS}, {_TEXTUAL}, d AS (SELECT _row_id, CASE WHEN coalesce(trim(description), '') = '' THEN '' WHEN description = '{_MARK}' THEN 'Spanish' ELSE 'English' END AS l FROM textual)
SELECT _row_id, l AS "description_Language", 'English' AS "state_Language" FROM d""")
def language_columns(spark, sf):
    ctx = described_context(spark, sf)
    return language.with_language_columns(ctx.df, ["description", "state", "no such column"]).select("_row_id", "description_Language", "state_Language")


@query(f"""WITH {TICKETS}, {_TEXTUAL} SELECT 'description' AS checked, count(*) FILTER (WHERE length(description) >= 15) AS total_analyzed, count(*) FILTER (WHERE description = '{_MARK}') AS non_english_count FROM textual
UNION ALL SELECT 'state', 0, 0 UNION ALL SELECT 'no such column', NULL, NULL""")
def language_of_columns(spark, sf):
    """Several columns at once look at cells of 15 characters or more; one that is not there is an error, not a pass."""
    ctx, out = described_context(spark, sf), None
    for run in language.check_columns(ctx.df, ["description", "state", "no such column"], mode="rules_only"):
        found = language.language_counts(run) if run.rows is not None else spark.range(1).select(*[F.lit(None).cast("long").alias(n) for n in ("total_analyzed", "non_english_count")])
        part = found.select(F.lit(run.column).alias("checked"), "total_analyzed", "non_english_count")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT page_id, text AS cleaned, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS normalised FROM (SELECT page_id, """ + _sql_clean("html") + " AS text FROM pages)")
def clean_pages(spark, sf):
    """Whole markup of every page through all cleaning patterns."""
    return table(spark, sf, "pages").select("page_id", X.clean(F.col("html")).alias("cleaned"), X.normalise(F.col("html")).alias("normalised"))


# Extracts


@query(f"""WITH {TICKETS}, s AS (SELECT count(*) AS rows FROM tickets) SELECT rows, 3 AS columns, rows * 3 AS cells, rows > 1048575 AS exceeds_sheet, rows * 3 > 1000000 AS may_be_slow FROM s
UNION ALL SELECT 1048575, 1, 1048575, false, true UNION ALL SELECT 1048576, 1, 1048576, true, true UNION ALL SELECT 1000000, 1, 1000000, false, false""")
def extract_sizes(spark, sf):
    """Size verdicts of an extract of all tickets, and at the limits themselves."""
    pick = extract.Selection(F.col("opened_at"), undated=True)
    plans = [extract.plan_extract(tickets(spark, sf), pick, ["number", "state", "priority"])]
    plans += [extract.Plan(n, ["a"], 0, False, [], 0) for n in (1_048_575, 1_048_576, 1_000_000)]
    return _rows(spark, [(p.rows, len(p.columns), p.cells, p.exceeds_sheet, p.may_be_slow) for p in plans], "rows long, columns int, cells long, exceeds_sheet boolean, may_be_slow boolean")


@query("""WITH m AS (SELECT strftime(min(o_orderdate), '%Y-%m') AS a, strftime(max(o_orderdate), '%Y-%m') AS z FROM orders), u AS (SELECT replace(a, '-', '_') AS a, replace(z, '-', '_') AS z FROM m)
SELECT 'range' AS kind, 'tickets_2024_opened_at_' || a || '_to_' || z || '.csv' AS name FROM u UNION ALL SELECT 'one month', 'tickets_2024_opened_at_' || a || '.xlsx' FROM u
UNION ALL SELECT 'all', 'extract_opened_at_all.csv' UNION ALL SELECT 'months', 'tickets_2024_opened_at_2_months_' || a || '_to_' || z || '.csv' FROM u""")
def file_names(spark, sf):
    low, high = table(spark, sf, "orders").agg(F.min(dates.month_text(F.col("o_orderdate"))), F.max(dates.month_text(F.col("o_orderdate")))).first()
    name = lambda *a, **k: extract.suggest_filename("/data/tickets 2024!.xlsx", "opened_at", *a, **k)
    rows = [
        ("range", name(low, high, "csv")), ("one month", name(low, low, "xlsx")), ("all", extract.suggest_filename(None, "opened_at", "", "", "csv")),
        ("months", name("", "", "csv", months=[high, low])),
    ]
    return _rows(spark, rows, "kind string, name string")
