"""Registered queries that go through files: what is written is read back and held against SQL over the tables.

Files lie below the session's shared folder. Workbooks need a path that the driver can open.
"""

from __future__ import annotations

import json
import os
import re
from urllib.parse import urlparse

from pyspark.sql import functions as F

from ledgerline.config import AuditConfig, ConfigStore
from ledgerline.operators import extract, language, report
from ledgerline.plans.catalogue import _SQL, FLAGS, TICKETS, query, table, ticket_context, tickets
from ledgerline.plans.catalogue_tables import _rows, _values
from ledgerline.session import scratch_path
from ledgerline.sources import loader, sinks, workbook


def _local(spark, label: str) -> str:
    """A folder that the driver can write to and executors can read: the shared one, where that is a mounted path."""
    path = urlparse(scratch_path(spark, label))
    if path.scheme not in ("", "file"):
        raise RuntimeError("these files are written by the driver: the shared folder has to be a mounted path")
    os.makedirs(path.path)
    return path.path


@query("SELECT * FROM supplier")
def parquet_table(spark, sf):
    return loader.read_table(spark, f"{sf}/supplier.parquet").drop("_row_id")


@query("SELECT 'json' AS format, * FROM region UNION ALL SELECT 'orc', * FROM region")
def json_and_orc_tables(spark, sf):
    out = None
    for kind in ("json", "orc"):
        path = f"{scratch_path(spark, 'regions')}.{kind}"
        table(spark, sf, "region").write.format(kind).save(path)
        read = loader.read_table(spark, path)
        part = read.select(F.lit(kind).alias("format"), F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {TICKETS} SELECT number, priority, state, opened_at, resolved_at, CASE WHEN number % 5 = 0 THEN 'said \"no\", then' || chr(10) || 'left' ELSE 'café ' || number END AS note FROM tickets")
def csv_round_trip(spark, sf):
    """Quotes, commas, line ends, letters beyond ASCII, nulls, numbers and times through the CSV sink and reader."""
    n = F.col("number")
    note = F.when(n % 5 == 0, F.lit('said "no", then\nleft')).otherwise(F.concat(F.lit("café "), n.cast("string")))
    path = f"{scratch_path(spark, 'tickets')}.csv"
    sinks.write_csv(tickets(spark, sf).withColumn("note", note).drop("_row_id"), path)
    return loader.read_table(spark, path).drop("_row_id")


@query("SELECT sep, n_nationkey, n_name, n_regionkey FROM nation, (VALUES ('comma'), ('semicolon'), ('tab'), ('pipe')) t(sep)")
def delimited_tables(spark, sf):
    out = None
    for name, sep in (("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("pipe", "|")):
        path = scratch_path(spark, "nations")
        table(spark, sf, "nation").coalesce(1).write.option("header", True).option("sep", sep).csv(path)
        read = loader.read_table(spark, spark.read.text(path).inputFiles()[0])
        part = read.select(F.lit(name).alias("sep"), *[F.col(c).cast(t).alias(c) for c, t in (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"))])
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'café' ELSE 'plain' END AS note FROM orders")
def late_byte_table(spark, sf):
    """A delimited file in which only the last row shows that it is not UTF-8."""
    orders = table(spark, sf, "orders")
    last = orders.agg(F.max("o_orderkey")).scalar()
    note = F.when(F.col("o_orderkey") == last, "café").otherwise("plain")
    path = scratch_path(spark, "late-byte")
    rows = orders.select("o_orderkey", "o_orderstatus", note.alias("note")).orderBy("o_orderkey").coalesce(1)
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return loader.read_table(spark, spark.read.text(path).inputFiles()[0]).drop("_row_id")


#: File name, how its bytes come from the regions, and what is to be said of it.
_KINDS = [
    ("a.csv", False, "utf-8-sig", ";", "is not a spreadsheet"), ("b.dat", False, "cp1252", "tab", "is not a spreadsheet"), ("c.txt", False, "latin-1", "|", "is not a spreadsheet"),
    ("d.xlsx", True, None, None, "is empty (0 bytes)"), ("e.bin", True, None, None, "is cut short"), ("f.xls", True, None, None, "is an old or protected workbook"),
    ("g.xlsx", True, None, None, "is a web page or XML"),
]


def _kind_bytes(regions: list, whole: bytes) -> dict[str, bytes]:
    """The regions as delimited text in three encodings, and as workbooks that are empty, cut, old and no workbook at all."""
    lines = lambda sep, head: "\n".join([f"{head}{sep}r_name", *(f"{k}{sep}{name}" for k, name in regions), ""])
    listed = "".join(f"<tr><td>{k}<td>{name}" for k, name in regions)
    return {
        "a.csv": lines(";", "key").encode(), "b.dat": lines("\t", "größe").encode("cp1252"), "c.txt": lines("|", "key\x81").encode("latin-1"), "d.xlsx": b"",
        "e.bin": whole[:-100], "f.xls": b"\xd0\xcf\x11\xe0\xa1\xb1" + whole, "g.xlsx": f"<html><table>{listed}</table>".encode(),
    }


@query("SELECT k.*, CASE WHEN NOT excel THEN (SELECT count(*) FROM region) END AS rows FROM (" + _values(_KINDS, "name, excel, encoding, delimiter, diagnosis") + ") k")
def file_kinds(spark, sf):
    """Format by extension or first bytes, encoding, delimiter, rows read, and why a workbook cannot be read."""
    folder, rows, r = _local(spark, "kinds"), [], table(spark, sf, "region").select("r_regionkey", "r_name")
    workbook.write_workbook(os.path.join(folder, "whole.xlsx"), [workbook.frame_sheet("Regions", r)])
    with open(os.path.join(folder, "whole.xlsx"), "rb") as f:
        made = _kind_bytes([tuple(x) for x in r.orderBy("r_regionkey").collect()], f.read())
    for name, excel, _, _, said in _KINDS:
        path = os.path.join(folder, name)
        with open(path, "wb") as f:
            f.write(made[name])
        encoding = None if excel else loader.detect_encoding(path)
        sep = None if excel else loader.detect_delimiter(made[name].decode(encoding, "replace"))
        told, read = loader.diagnose(path), None if excel else loader.read_table(spark, path).count()
        rows.append((name, loader.is_excel(path), encoding, {"\t": "tab"}.get(sep, sep), said if said in told else told, read))
    return _rows(spark, rows, "name string, excel boolean, encoding string, delimiter string, diagnosis string, rows long")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, strptime('1998-02-01 06:30:00', '%Y-%m-%d %H:%M:%S') AS seen FROM customer")
def workbook_round_trip(spark, sf):
    """Customers through the workbook writer and the low-memory workbook reader."""
    c = table(spark, sf, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))).withColumn("seen", F.lit("1998-02-01 06:30:00").cast("timestamp_ntz"))
    path = os.path.join(_local(spark, "book"), "customers.xlsx")
    workbook.write_workbook(path, [workbook.frame_sheet("Empty", c.limit(0)), workbook.frame_sheet("Customers", c)])
    read = loader.read_table(spark, path, "Customers")
    return read.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in c.schema.fields])


@query(_values([("Empty", 0), ("Regions", 1), ("Extract Info", 2)], "sheet, place"))
def workbook_sheets(spark, sf):
    path = os.path.join(_local(spark, "book"), "regions.xlsx")
    r = table(spark, sf, "region")
    workbook.write_workbook(path, [workbook.frame_sheet("Empty", r.limit(0)), workbook.frame_sheet("Regions", r), ("Extract Info", ["Item"], iter([("x",)]))])
    return _rows(spark, [(n, i) for i, n in enumerate(loader.list_sheets(path))], "sheet string, place int")


_PICKED = "resolved_at >= TIMESTAMP '1996-01-01' AND resolved_at < TIMESTAMP '1997-01-01'"


@query(f"""WITH {TICKETS}, m AS (SELECT * FROM tickets WHERE {_PICKED})
SELECT 'csv' AS kind, number, state, resolved_at FROM m UNION ALL SELECT 'xlsx', number, state, resolved_at FROM m""")
def extract_files(spark, sf):
    """One extract written both ways and read back."""
    pick, out = extract.Selection(F.col("resolved_at"), "1996-01", "1996-12"), None
    df, folder, names = tickets(spark, sf), _local(spark, "extracts"), ["number", "state", "resolved_at"]
    plan = extract.plan_extract(df, pick, names)
    for kind in ("csv", "xlsx"):
        path = sinks.write_extract(extract.build_extract(df, pick, names), os.path.join(folder, f"extract.{kind}"), plan, pick, "resolved_at", split=True)
        read = loader.read_table(spark, path) if kind == "csv" else loader.read_split(spark, path, "Extract")
        part = read.select(F.lit(kind).alias("kind"), *names)
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {TICKETS}, m AS (SELECT * FROM tickets WHERE {_PICKED}) SELECT 'Period' AS item, 'Jan-96 to Dec-96' AS said
UNION ALL SELECT 'Rows', format('{{:,}}', count(*)) FROM m UNION ALL SELECT 'Rows without a date', (SELECT format('{{:,}}', count(*)) FROM tickets WHERE resolved_at IS NULL)
UNION ALL SELECT 'Columns', '2' UNION ALL SELECT 'Column names', 'number, state' UNION ALL SELECT 'Months with rows', (SELECT CAST(count(DISTINCT date_trunc('month', resolved_at)) AS VARCHAR) FROM m)""")
def extract_note(spark, sf):
    """What the note beside a CSV extract says."""
    pick, df = extract.Selection(F.col("resolved_at"), "1996-01", "1996-12"), tickets(spark, sf)
    plan = extract.plan_extract(df, pick, ["state", "number"])
    path = sinks.write_extract(extract.build_extract(df, pick, plan.columns), os.path.join(_local(spark, "note"), "extract.csv"), plan, pick, "resolved_at")
    with open(sinks.sidecar_path(path), encoding="utf-8") as f:
        told = dict(line.rstrip("\n").split(": ", 1) for line in f)
    return _rows(spark, [(k, told[k]) for k in ("Period", "Rows", "Rows without a date", "Columns", "Column names", "Months with rows")], "item string, said string")


@query(f"""WITH {TICKETS}, m AS (SELECT count(*) AS n FROM tickets) SELECT n AS rows, n // 10000 AS reports, true AS cancelled, false AS left_behind FROM m""")
def workbook_progress(spark, sf):
    """Progress is told every ten thousand rows; a cancelled workbook leaves no file."""
    df, folder, told = tickets(spark, sf).select("number"), _local(spark, "progress"), []
    workbook.write_workbook(os.path.join(folder, "a.xlsx"), workbook.frame_sheets("Extract", df), progress=told.append)
    rows = loader.read_split(spark, os.path.join(folder, "a.xlsx"), "Extract").count()
    stopped, many = False, ("Many", ["n"], iter((i,) for i in range(20_001)))
    try:
        workbook.write_workbook(os.path.join(folder, "b.xlsx"), [many], cancelled=lambda: True)
    except InterruptedError:
        stopped = True
    return _rows(spark, [(rows, len(told), stopped, any(f.startswith("b.xlsx") for f in os.listdir(folder)))], "rows long, reports long, cancelled boolean, left_behind boolean")


_REGISTER = _SQL["findings_register"].replace("> 19", "> 20").replace("<= 19", "<= 20")


@query(_REGISTER)
def workbook_findings(spark, sf):
    """The register as a reader of the audit workbook finds it."""
    path = os.path.join(_local(spark, "audit"), "audit.xlsx")
    sinks.write_report(ticket_context(spark, sf), path, inline=10)
    read = loader.read_table(spark, path, "Findings")
    return read.select("Area", "Check", "Severity", F.col("Rows Affected").cast("long").alias("Rows Affected"), "Result")


@query(f"""{_SQL["ticket_detail"].replace('SELECT number, priority, state, opened_at, resolved_at, _row_id,', 'SELECT number, "Duplicate ID", "QA Findings", "QA Flag Count", "State Reads As" FROM (SELECT number,')})""")
def detail_csv(spark, sf):
    """The detail that is too long for the workbook, from the CSV beside it."""
    folder = _local(spark, "audit")
    sinks.write_report(ticket_context(spark, sf), os.path.join(folder, "audit.xlsx"), inline=10)
    read = loader.read_table(spark, os.path.join(folder, "audit_detail.csv"))
    return read.select("number", "Duplicate ID", "QA Findings", F.col("QA Flag Count").cast("int").alias("QA Flag Count"), "State Reads As")


@query(f"""{FLAGS}, n AS (SELECT count(*) FILTER (WHERE closed_no_date) AS c3, count(*) FILTER (WHERE open_with_date) AS c4, count(*) FILTER (WHERE open_missing_priority) AS c5, count(*) FILTER (WHERE state = 'Stage P') AS c6 FROM flags),
l AS (SELECT 'State / resolution (closed_no_date)' AS t, c3 AS k, 'Fail' AS r FROM n UNION ALL SELECT 'State / resolution (open_with_date)', c4, 'Fail' FROM n
  UNION ALL SELECT 'Open ticket priority (open_missing_priority)', c5, 'Fail' FROM n UNION ALL SELECT 'State classification (unclassified_count)', c6, 'Review' FROM n)
SELECT 'CROSS-FIELD LOGIC' AS section, '[' || CASE WHEN k = 0 THEN 'Pass' ELSE r END || '] ' || t || ': ' || format('{{:,}}', k) AS line FROM l
UNION ALL SELECT 'DUPLICATES', '0 surplus rows, 0 ids affected, 0 rows involved' UNION ALL SELECT 'LANGUAGE', 'Not checked - no language analysis has been run'
UNION ALL SELECT 'SUMMARY', 'Rows: ' || (SELECT format('{{:,}}', count(*)) FROM orders)""")
def text_report(spark, sf):
    """Sections of the full report whose lines SQL can count."""
    section, rows = "", []
    lines = report.text_report(ticket_context(spark, sf)).splitlines()
    for line, following in zip(lines, [*lines[1:], ""], strict=True):
        if following and set(following) == {"-"}:
            section = line
        elif line and set(line) != {"-"} and (section in ("CROSS-FIELD LOGIC", "DUPLICATES", "LANGUAGE") or line.startswith("Rows: ")):
            rows.append((section, line))
    return _rows(spark, rows, "section string, line string")


@query(f"""WITH reg AS ({_REGISTER}) SELECT 'Critical issues' AS title, count(*) FILTER (WHERE "Result" = 'Fail' AND "Severity" IN ('Critical', 'High')) AS n FROM reg
UNION ALL SELECT 'Warnings', count(*) FILTER (WHERE "Result" = 'Review' OR "Result" = 'Fail' AND "Severity" IN ('Medium', 'Low')) FROM reg
UNION ALL SELECT 'Not checked', count(*) FILTER (WHERE "Result" = 'Not checked') FROM reg UNION ALL SELECT 'Passed', count(*) FILTER (WHERE "Result" = 'Pass') FROM reg""")
def summary_report(spark, sf):
    """Headings of the summary letter and how many findings each announces and lists."""
    rows, title = {}, None
    for line in report.summary_report(ticket_context(spark, sf)).splitlines():
        if m := re.fullmatch(r"(Critical issues|Warnings|Not checked|Passed) \((\d+)\)", line):
            title, rows[m[1]] = m[1], [int(m[2]), 0]
        elif not line:
            title = None
        elif title and re.match(r"\d+\. ", line):
            rows[title][1] += 1
    return _rows(spark, [(t, n if n == listed else -1) for t, (n, listed) in rows.items()], "title string, n long")


@query("""SELECT 'null_threshold' AS "key", CAST((SELECT count(*) FROM nation) AS VARCHAR) AS "value" UNION ALL SELECT 'desc_min_length', '20' UNION ALL SELECT 'extract_format', 'csv'
UNION ALL SELECT r_name, CAST(r_regionkey AS VARCHAR) FROM region""")
def settings_store(spark, sf):
    """Settings over defaults, through their file; keys that are not ours, here the regions, are kept."""
    regions = {r["r_name"]: r["r_regionkey"] for r in table(spark, sf, "region").collect()}
    nations = table(spark, sf, "nation").count()
    path = os.path.join(_local(spark, "settings"), "settings.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"null_threshold": 30} | regions, f)
    ConfigStore(path).update({"null_threshold": nations, "extract_format": "csv"})
    again = ConfigStore(path)
    assert again.config() == AuditConfig(null_threshold=nations, extract_format="csv")
    return _rows(spark, [(k, str(again.get(k))) for k in ("null_threshold", "desc_min_length", "extract_format", *regions)], "key string, value string")


@query("""WITH l AS (SELECT n_nationkey, 0 AS again, n_name AS label FROM nation UNION ALL SELECT n_nationkey, 1, lower(n_name) FROM nation UNION ALL SELECT n_nationkey, 2, n_name || ' / x' FROM nation)
SELECT label, 'tbl_' || regexp_replace(label, '[^A-Za-z0-9_]+', '_', 'g') || CASE WHEN again = 1 THEN '_2' ELSE '' END AS name FROM l""")
def sheet_table_names(spark, sf):
    """Table names of sheets called like the nations, like them in small letters, and with marks in them."""
    nations, used = [r["n_name"] for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()], set()
    labels = [*nations, *(n.lower() for n in nations), *(f"{n} / x" for n in nations)]
    return _rows(spark, [(x, sinks.table_name(x, used)) for x in labels], "label string, name string")


@query("""SELECT row_number() OVER () - 1 AS line, said FROM (SELECT 'Dataset' || chr(9) || 'tpch' AS said, 0 AS k, 0 AS r UNION ALL SELECT 'Sheet' || chr(9) || 'Nations', 1, 0
UNION ALL SELECT 'Rows' || chr(9) || count(*), 2, 0 FROM nation UNION ALL SELECT 'Filter' || chr(9) || 'none at all', 3, 0 UNION ALL SELECT '', 4, 0
UNION ALL SELECT 'n_nationkey' || chr(9) || 'n_name', 5, 0 UNION ALL SELECT n_nationkey || chr(9) || n_name || ' and sons', 6, n_nationkey FROM nation ORDER BY k, r)""")
def tsv_copy(spark, sf):
    """A table as it goes to the clipboard, without the line that says when."""
    n = table(spark, sf, "nation").orderBy("n_nationkey").select("n_nationkey", F.concat("n_name", F.lit("\tand\nsons")).alias("n_name"))
    lines = sinks.copy_as_tsv(n, "tpch", "Nations", {"Filter": "none\tat all"}).splitlines()
    return _rows(spark, enumerate(x for x in lines if not x.startswith("Generated\t")), "line long, said string")


@query("""WITH t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Hola buenos dias, necesito ayuda con el sistema' WHEN 1 THEN 'the printer does not work today' ELSE 'short' END AS note FROM pages),
n AS (SELECT count(*) AS total, count(*) FILTER (WHERE length(note) >= 10) AS seen, count(*) FILTER (WHERE page_id % 3 = 0) AS es FROM t)
SELECT 'found' AS run, 'note: ' || es || ' of ' || seen || ' judged rows are not in English (' || round(es * 100.0 / seen, 1) || '%)' AS line FROM n
UNION ALL SELECT 'found', total || ' rows hold text; ' || (total - seen) || ' are too short to judge' FROM n UNION ALL SELECT 'found', 'Spanish ' || es FROM n
UNION ALL SELECT 'missing', 'nowhere: Column nowhere not found'""")
def language_lines(spark, sf):
    """What a report says of a language run, and of one that could not be made."""
    k = F.col("page_id") % 3
    note = F.when(k == 0, "Hola buenos dias, necesito ayuda con el sistema").when(k == 1, "the printer does not work today").otherwise("short")
    p = table(spark, sf, "pages").select("page_id", note.alias("note"), F.col("page_id").alias("_row_id"))
    rows = [(name, line) for name, c in (("found", "note"), ("missing", "nowhere")) for line in language.format_result(language.check_column(p, c, mode="rules_only"), samples=0)]
    return _rows(spark, rows, "run string, line string")
