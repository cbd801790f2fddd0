"""Readers, sinks, the driver contract and the streaming extension."""

import csv
import datetime
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import extract
from ledgerline.operators.logic import AuditContext
from ledgerline.plans import catalogue
from ledgerline.sources import loader, sinks, workbook
from ledgerline.streaming import inflow

DAY = datetime.datetime


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    path = tmp_path / "t.csv"
    path.write_text(f'number{sep}text\n1{sep}"a, b; c"\n2{sep}"two\nlines"\n')
    df = loader.read_table(spark, str(path))
    rows = df.orderBy("_row_id").collect()
    assert df.columns == ["number", "text", "_row_id"] and [r["text"] for r in rows] == ["a, b; c", "two\nlines"]
    assert dict(df.dtypes)["number"] == "bigint"


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252"])
def test_encodings(spark, tmp_path, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes("größe,b\nümlaut é,1\n".replace("é", "é€" if encoding == "cp1252" else "é").encode(encoding))
    df = loader.read_table(spark, str(path))
    assert df.columns[0] == "größe" and df.first()[0] == "ümlaut é" + "€" * (encoding == "cp1252")


def test_undecodable_bytes_still_load(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_bytes(b"a,b\n\x81\x8d,2\n")
    assert loader.detect_encoding(str(path)) == "latin-1" and loader.read_table(spark, str(path)).count() == 1


@pytest.mark.parametrize(("late", "said", "encoding"), [("é".encode(), "é", "utf-8-sig"), (b"\xe9\x80", "é€", "cp1252"), (b"\xe9\x81", "é\x81", "latin-1")])
def test_a_byte_far_behind_the_start_decides(spark, tmp_path, late, said, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes(b"a,b\n" + b"plain,1\n" * 150_000 + late + b",2\n")
    assert loader.survey_lines(spark, str(path)) == (encoding, False) and loader.detect_encoding(str(path)) == "utf-8-sig"
    assert [r["a"] for r in loader.read_table(spark, str(path)).filter("b = 2").collect()] == [said]


def test_a_character_cut_at_the_window_is_no_misfit(tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b"x" * (loader.WINDOW - 1) + "é".encode() + b"tail")
    assert loader.detect_encoding(str(path)) == "utf-8-sig"


def test_blank_and_repeated_headers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,,a\n1,2,3\n")
    assert loader.read_table(spark, str(path)).columns == ["a", "Unnamed: 1", "a.1", "_row_id"]
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="is empty"):
        loader.read_table(spark, str(tmp_path / "empty.csv"))


def write(path, sheets):
    workbook.write_workbook(str(path), [(n, h, iter(b)) for n, h, b in sheets])


def test_workbooks(spark, tmp_path):
    path = tmp_path / "t.xlsx"
    body = [("INC1", "007", 1.5, DAY(2024, 3, 5, 10, 30), True, None, "é <&>"), (), ("INC2", "8", 2, None, False, None, " padded ")]
    write(path, [("Incidents", ["number", "code", "x", "when", "flag", "nothing", None], body), ("Changes", ["a"], [(1,)])])
    assert loader.list_sheets(str(path)) == ["Incidents", "Changes"] and loader.list_sheets("x.csv") == []
    df = loader.read_table(spark, str(path))
    assert dict(df.dtypes) == {
        "number": "string", "code": "bigint", "x": "double", "when": "timestamp_ntz", "flag": "boolean", "nothing": "double", "Unnamed: 6": "string", "_row_id": "bigint",
    }
    rows = df.orderBy("_row_id").collect()
    assert len(rows) == 3 and rows[0]["code"] == 7 and rows[0]["when"] == DAY(2024, 3, 5, 10, 30) and rows[0]["Unnamed: 6"] == "é <&>"
    assert rows[1]["number"] is None and rows[2]["Unnamed: 6"] == " padded "
    assert loader.read_table(spark, str(path), "Changes").first()["a"] == 1
    with pytest.raises(ValueError, match="no sheet"):
        loader.read_table(spark, str(path), "Missing")


def packed(path, sheet, strings=("zero", "one", "", "thr&amp;ee"), form="utf-8"):
    """A workbook as another program writes it: prefixed names, shared strings, rows left out."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si><t>{t}</t></si>" for t in strings)}</sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<x:worksheet xmlns:x="{main}"><x:dimension ref="A1"/>{sheet}</x:worksheet>'.encode(form))


SHEET = (
    '<x:sheetData><x:row r="1"><x:c r="A1" t="s"><x:v>1</x:v></x:c><x:c r="C1" t="inlineStr"><x:is><x:t>n</x:t></x:is></x:c></x:row>'
    "<x:row r='2'><x:c r=\"A2\" t='s'> <x:v>3</x:v></x:c><x:c r='C2'><x:v>2</x:v></x:c></x:row><!-- </x:row> -->"
    '<x:row r="5"/><x:row r="6"><x:c r="A6" t="inlineStr"><x:is><x:t><![CDATA[a</x:row>b]]></x:t></x:is></x:c></x:row>'
    '<x:row><x:c t="s" s="0"><x:f>x</x:f><x:v>0</x:v></x:c><x:c/><x:c><x:v>7</x:v></x:c></x:row><x:row r="9"><x:c r="A9" t="s"><x:v>2</x:v></x:c></x:row></x:sheetData>'
)


@pytest.mark.parametrize("size", [1, 200, 1 << 20])
@pytest.mark.parametrize("form", ["utf-8", "utf-16"])
def test_sheets_are_cut_anywhere(spark, tmp_path, monkeypatch, size, form):
    """Comments, literal sections, prefixes, rows left out and empty rows, however small the pieces."""
    packed(tmp_path / "t.xlsx", SHEET, form=form)
    cut = list(workbook.pieces(open(tmp_path / "t.xlsx", "rb"), size=size))
    assert (len(cut) > 3) == (size == 1) and [p["start"] for p in cut][1:] == [p["end"] + 1 for p in cut][:-1]
    monkeypatch.setattr(workbook, "PIECE", size)
    df = loader.read_table(spark, str(tmp_path / "t.xlsx"))
    assert dict(df.dtypes) == {"one": "string", "Unnamed: 1": "double", "n": "bigint", "_row_id": "bigint"}
    told = [(r["one"], r["n"]) for r in df.orderBy("_row_id").collect()]
    assert told == [("thr&ee", 2), (None, None), (None, None), (None, None), ("a</x:row>b", None), ("zero", 7)]


def test_sheets_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}", i / 7 if i % 3 else None) for i in range(3000)]
    write(tmp_path / "t.xlsx", [("One", ["n", "t", "x"], rows)])
    monkeypatch.setattr(workbook, "PIECE", 20_000)
    df = loader.read_table(spark, str(tmp_path / "t.xlsx"))
    assert df.rdd.getNumPartitions() > 10
    assert [tuple(r)[:3] for r in df.orderBy("_row_id").collect()] == rows
    for sheet in ("<x:sheetData/>", "<x:sheetData></x:sheetData>"):
        packed(tmp_path / "e.xlsx", sheet)
        assert loader.read_table(spark, str(tmp_path / "e.xlsx")).count() == 0
    packed(tmp_path / "f.xlsx", SHEET[:-200])
    with pytest.raises(ValueError):
        loader.read_table(spark, str(tmp_path / "f.xlsx"))


def test_workbooks_in_other_stores(spark, tmp_path):
    """A path with a scheme, blanks and brackets goes through Spark's file systems; one that is not there is told as such."""
    path = f"file://{tmp_path}/plan [1] {{a}}.xlsx"
    write(path.removeprefix("file://"), [("One", ["n"], [(i,) for i in range(workbook.BATCH + 1)]), ("Two", [], [])])
    assert loader.list_sheets(path) == ["One", "Two"]
    df = loader.read_table(spark, path)
    assert df.agg(F.sum("n"), F.max("_row_id"), F.count("n")).first()[:] == (sum(range(workbook.BATCH + 1)), workbook.BATCH, workbook.BATCH + 1)
    assert loader.read_table(spark, path, "Two").count() == 0
    for missing in (f"file://{tmp_path}/no.xlsx", f"{tmp_path}/no.xlsx"):
        with pytest.raises(ValueError, match="cannot be read"):
            loader.read_table(spark, missing)


@pytest.mark.parametrize(("name", "data", "said"), [
    ("a.xlsx", b"", "0 bytes"), ("b.xlsx", b"PK\x03\x04rest", "cut short"), ("c.xlsx", b"\xd0\xcf\x11\xe0\xa1\xb1", "old or protected"),
    ("d.xlsx", b"<html><table>", "web page"), ("e.xlsx", b"\x01\x02\x03random", "not a spreadsheet"), ("f.xlsx", b"PK\x03\x04PK\x05\x06" + b"\0" * 18, "damaged"),
])
def test_damaged_workbooks(spark, tmp_path, name, data, said):
    (tmp_path / name).write_bytes(data)
    with pytest.raises(ValueError, match=said):
        loader.read_table(spark, str(tmp_path / name))


def test_unknown_extensions_go_by_first_bytes(tmp_path):
    (tmp_path / "a.bin").write_bytes(b"PK\x03\x04")
    (tmp_path / "b.bin").write_bytes(b"a,b")
    assert loader.is_excel(str(tmp_path / "a.bin")) and not loader.is_excel(str(tmp_path / "b.bin"))


def sample(spark):
    rows = [(i, f"INC{i}", DAY(2026, 1 + i % 3, 5), i % 2 == 0, "=cmd" if i == 1 else "a\x07b\nc") for i in range(30)]
    return spark.createDataFrame(rows, "_row_id long, number string, opened timestamp_ntz, ok boolean, text string")


def test_extract_round_trips(spark, tmp_path):
    df, pick = sample(spark), extract.Selection(F.col("opened"), "2026-01", "2026-02")
    names = ["number", "opened", "ok", "text"]
    plan, frame = extract.plan_extract(df, pick, names), extract.build_extract(df, pick, names)
    for ext in ("csv", "xlsx"):
        path = str(tmp_path / f"out.{ext}")
        sinks.write_extract(frame, path, plan, pick, "opened", "dump.csv")
        back = loader.read_table(spark, path)
        assert back.count() == plan.rows == 20 and back.columns[:-1] == names
        assert {r["ok"] for r in back.collect()} == {"Yes", "No"} and back.filter("text like '%\x07%'").count() == 0
    assert open(tmp_path / "out.csv", "rb").read(3) == b"\xef\xbb\xbf" and "Jan-26 to Feb-26" in open(sinks.sidecar_path(str(tmp_path / "out.csv"))).read()
    assert loader.list_sheets(str(tmp_path / "out.xlsx")) == ["Extract", "Extract Info"]
    assert sorted(os.listdir(tmp_path)) == ["out.csv", "out.xlsx", "out_ExtractInfo.txt"] or not any("partial" in n for n in os.listdir(tmp_path))


def test_csv_is_written_by_many_tasks(spark, tmp_path):
    """Parts joined in order are the file one task would have written."""
    odd = ['say "no", then', "", None, "a\nb", "=1", "é€", " x "]
    rows = [(i, odd[i % len(odd)], DAY(2024, 1, 1 + i % 28, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, '`the "id"` long, `a,b` string, t timestamp_ntz').repartitionByRange(6, "`the \"id\"`").sortWithinPartitions("`the \"id\"`")
    assert df.rdd.getNumPartitions() == 6
    sinks.write_csv(df, str(tmp_path / "many.csv"))
    sinks.write_csv(df.coalesce(1).sortWithinPartitions("`the \"id\"`"), str(tmp_path / "one.csv"))
    whole = (tmp_path / "many.csv").read_bytes()
    assert whole == (tmp_path / "one.csv").read_bytes() and sorted(os.listdir(tmp_path)) == [".many.csv.crc", ".one.csv.crc", "many.csv", "one.csv"] or not any("partial" in n for n in os.listdir(tmp_path))
    with open(tmp_path / "many.csv", encoding="utf-8-sig", newline="") as f:
        told = list(csv.reader(f))
    assert told[0] == ['the "id"', "a,b", "t"] and [int(r[0]) for r in told[1:]] == list(range(500)) and told[1][1] == odd[0]
    sinks.write_csv(df.limit(0), str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_text(encoding="utf-8-sig").count("\n") == 1


def test_extracts_are_refused_not_cut(spark, tmp_path):
    df, pick = sample(spark), extract.Selection(F.col("opened"), months=())
    with pytest.raises(ValueError):
        sinks.write_extract(df, str(tmp_path / "a.csv"), extract.plan_extract(df, pick, ["number"]), pick, "opened")
    big = extract.Plan(2_000_000, ["a"], 0, False, [], 0)
    with pytest.raises(sinks.TooLarge):
        sinks.write_extract(df, str(tmp_path / "a.xlsx"), big, pick, "opened")
    whole = extract.Selection(F.col("opened"))
    with pytest.raises(InterruptedError):
        rows = iter([(i,) for i in range(20_001)])
        workbook.write_workbook(str(tmp_path / "b.xlsx"), [("S", ["n"], rows)], cancelled=lambda: True)
    assert not os.listdir(tmp_path) and big.exceeds_sheet and big.may_be_slow and extract.plan_counts(df, whole).first()["rows"] == 30


def test_report_workbook(spark, tmp_path):
    ctx = AuditContext.open(catalogue.tickets(spark, "/root/testdata/sf0.001"), as_of=catalogue.AS_OF)
    path = str(tmp_path / "report.xlsx")
    told = sinks.write_report(ctx, path, inline=100)
    sheets = loader.list_sheets(path)
    assert {"Findings", "Monthly inflow", "Distributions", "Notes"} <= set(sheets) and any("report_detail.csv" in t for t in told)
    assert loader.read_table(spark, str(tmp_path / "report_detail.csv")).count() == ctx.df.count()
    used: set = set()
    assert [sinks.table_name(x, used) for x in ("A b", "a B", "x/y")] == ["tbl_A_b", "tbl_a_B_2", "tbl_x_y"]


def test_streamed_inflow(spark, tmp_path):
    events = spark.createDataFrame([(1, DAY(2024, 1, 1, 5)), (2, DAY(2024, 1, 1, 9)), (2, DAY(2024, 1, 1, 9)), (3, DAY(2024, 1, 2, 1)), (4, DAY(2024, 1, 9))], "event_id long, ts timestamp_ntz")
    events.select("event_id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = inflow.daily_inflow(stream, "ts", "event_id").writeStream.outputMode("complete").format("memory").queryName("days").start()
    try:
        q.processAllAvailable()
        got = {r["day"].isoformat(): r["count"] for r in spark.table("days").collect()}
    finally:
        q.stop()
    assert got == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-09": 1}


def test_queries_match_their_sql(spark):
    """Every query with SQL, at the smallest scale; the driver does the same at the next."""
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in os.listdir(sf):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")

    def plain(v):
        if isinstance(v, float):
            return float(f"{v:.9g}")
        return tuple(map(plain, v)) if isinstance(v, list) else v.replace(tzinfo=None) if isinstance(v, DAY) else v

    for name, sql in catalogue.oracle_sql().items():
        got = catalogue.queries()[name](spark, sf)
        want = db.sql(sql)
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns, name
        place = [want.columns.index(c) for c in columns]
        a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
        b = sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=str)
        assert a == b, name


def test_entry_without_the_text_subpackage(tmp_path):
    """The other queries stand when the optional parts are deleted."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
    picked = "roles or labels or delimiters or states or months"
    tests = [sys.executable, "-B", "-m", "pytest", "tests", "-q", "-p", "no:cacheprovider", "-k", picked]
    subprocess.run(tests, cwd=tmp_path / "repo", check=True, timeout=600, stdout=subprocess.DEVNULL)


def test_a_path_with_a_scheme_is_read_through_spark(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("größe;b\n1;2\n".encode("cp1252"))
    remote = f"file://{path}"
    assert loader.detect_encoding(remote) == "cp1252" and loader.read_table(spark, remote).columns[:2] == ["größe", "b"]
    with pytest.raises(OSError, match="cannot be opened"):
        loader.detect_encoding(f"file://{tmp_path}/absent.csv")


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from ledgerline.session import shared_dir

    conf = SimpleNamespace(get=lambda *a: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf)))


def test_the_package_can_be_shipped(tmp_path):
    """From a folder where the workers cannot import it, with nothing on their path."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from ledgerline.session import build_session, ship_package
spark = build_session("shipped", "local[2]")
ship_package(spark)
from ledgerline.sources import loader, workbook
workbook.write_workbook("t.xlsx", [("A", ["a"], iter([(1,), (2,)]))])
assert loader.read_table(spark, "t.xlsx").count() == 2
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=180, env=env, stderr=subprocess.DEVNULL)


def test_clipboard_tables_are_bounded(spark):
    with pytest.raises(sinks.TooLarge):
        sinks.copy_as_tsv(spark.range(5), "d", "s", most=4)


def test_plan_size(spark):
    from ledgerline.operators.completeness import estimated_bytes

    assert estimated_bytes(spark.range(1000)) > estimated_bytes(spark.range(10)) > 0


def test_a_database_table_is_read_in_ranges_of_its_key(spark, sf, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:tickets;create=true"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").cast("long").alias("id"), F.col("o_orderdate").cast("timestamp").alias("opened"), F.col("o_orderstatus").cast("string").alias("Order State")
    )
    # Some rows have no key, and one key lies far off.
    rows = orders.unionByName(orders.limit(7).withColumn("id", F.lit(None).cast("long"))).unionByName(orders.limit(1).withColumn("id", F.lit(10**12)))
    rows = rows.coalesce(1)
    rows.write.option("createTableColumnTypes", "`Order State` varchar(20)").jdbc(url, "tickets")
    number = rows.count()
    got = loader.read_jdbc(spark, url, "tickets", "id", rows_per_part=200)
    assert got.rdd.getNumPartitions() == -(-number // 200) > 1
    want = rows.withColumn("opened", F.col("opened").cast("timestamp_ntz"))
    back = got.drop("_row_id")
    assert got.count() == number and back.schema.simpleString() == want.schema.simpleString()
    assert not back.exceptAll(want).count() and not want.exceptAll(back).count()
    assert got.select("_row_id").distinct().count() == number
    by_time = loader.read_jdbc(spark, url, "tickets", "opened", rows_per_part=500)
    assert by_time.rdd.getNumPartitions() > 1 and not want.exceptAll(by_time.drop("_row_id")).count()
    plan = got.filter("id = 5").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,5)" in plan.replace("`", "") and "opened" not in plan
    rows.limit(0).select("id", "opened").write.jdbc(url, "no_rows")
    assert loader.read_jdbc(spark, url, "no_rows", "id").count() == 0


def test_a_catalog_table_is_read_by_name(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.select(F.col("o_orderkey").cast("int").alias("a.b"), F.col("o_orderdate").cast("date").alias("day"), F.lit(None).alias("empty")).createOrReplaceTempView("orders_by_name")
    got = loader.read_catalog(spark, "orders_by_name")
    assert dict(got.dtypes) == {"a.b": "bigint", "day": "timestamp_ntz", "empty": "double", "_row_id": "bigint"}
    assert got.count() == orders.count()


def test_a_table_beyond_a_sheet_goes_on_in_the_next(spark, tmp_path, monkeypatch):
    """Whole, typed over all sheets, empty rows at a sheet's end kept, progress told over all sheets."""
    path, told = str(tmp_path / "split.xlsx"), []
    df = spark.range(25, numPartitions=3).select(
        "id", F.when(F.col("id") > 20, F.concat(F.lit("t"), "id")).alias("late"), (F.col("id") * 0.5).alias("half"))
    df = df.select(*[F.when(~F.col("id").isin(9, 19), F.col(c)).alias(c) for c in df.columns])
    sheets = workbook.frame_sheets("Extract", df, most=10)
    workbook.write_workbook(path, [*sheets, ("Extract Info", ["Item"], iter([("x",)]))])
    assert loader.list_sheets(path) == ["Extract", "Extract (2)", "Extract (3)", "Extract Info"]
    read = loader.read_split(spark, path, "Extract")
    assert [tuple(r)[:3] for r in read.orderBy("_row_id").collect()] == [tuple(r) for r in df.collect()]
    assert [r[0] for r in read.select("_row_id").orderBy("_row_id").collect()] == list(range(25)) and dict(read.dtypes)["late"] == "string"
    many = [("A", ["n"], iter([(1,)] * 15_000)), ("A (2)", ["n"], iter([(1,)] * 15_000))]
    workbook.write_workbook(str(tmp_path / "p.xlsx"), many, progress=told.append)
    assert told == [10_000, 20_000, 30_000]
    with pytest.raises(ValueError):
        loader.read_split(spark, path, "Nowhere")
    assert workbook.sheet_series("x" * 40, 2) == ["x" * 31, "x" * 27 + " (2)"]
    # The registered queries write what a sheet cannot hold over several of them.
    monkeypatch.setattr(sinks, "frame_sheets", lambda name, frame: workbook.frame_sheets(name, frame, most=10))
    pick = extract.Selection(F.col("opened"))
    big, rows = extract.Plan(2_000_000, ["number"], 0, False, [], 0), sample(spark)
    sinks.write_extract(rows.select("number"), str(tmp_path / "big.xlsx"), big, pick, "opened", split=True)
    assert sorted(r["number"] for r in loader.read_split(spark, str(tmp_path / "big.xlsx"), "Extract").collect()) == sorted(r["number"] for r in rows.collect())
