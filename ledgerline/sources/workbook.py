"""Excel workbooks with the standard library: a reader over Spark's binary files, a streaming writer.

Spark brings the file to one executor task from whatever store it lies in; neither the
driver nor the worker opens a path. A sheet is one compressed stream, which that task
inflates once and cuts after row ends into pieces of some ``PIECE`` bytes, each with
its row numbers and the shared strings it refers to. Pieces are written to the
shared folder; types are inferred and rows parsed from them in as many tasks. The inflating task holds
the compressed file, the shared strings and one piece; a parsing task one piece.
"""

from __future__ import annotations

import codecs
import datetime
import io
import itertools
import os
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerline.config import SHEET_ROWS
from ledgerline.plans.materialise import materialise

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_EPOCH = datetime.datetime(1899, 12, 30)
#: Built-in number formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: Rows of a sheet that are handed on at once.
BATCH = 4096
#: Bytes of a sheet's text in a piece, and read from it at once.
PIECE, BLOCK = 4 << 20, 1 << 20


def _part(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def sheet_paths(file) -> dict[str, str]:
    """Sheet names and their parts, in workbook order; ``file`` is a path or an open binary file."""
    with zipfile.ZipFile(file) as z:
        rels = {r.get("Id"): r.get("Target") for r in _part(z, "xl/_rels/workbook.xml.rels")}
        out = {}
        for s in _part(z, "xl/workbook.xml").iter(f"{_MAIN}sheet"):
            target = rels[s.get(f"{_REL}id")].lstrip("/")
            out[s.get("name")] = target if target.startswith("xl/") else f"xl/{target}"
        return out


def _shared(z: zipfile.ZipFile) -> list[str]:
    root = _part(z, "xl/sharedStrings.xml")
    return [] if root is None else ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in root.findall(f"{_MAIN}si")]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    root = _part(z, "xl/styles.xml")
    if root is None:
        return set()
    own = {
        int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt")
        if re.search(r"[dmyhs]", re.sub(r"\"[^\"]*\"|\[[^\]]*\]|\\.", "", f.get("formatCode", "")), re.IGNORECASE)
    }
    cells = root.find(f"{_MAIN}cellXfs")
    return {i for i, xf in enumerate(cells if cells is not None else []) if int(xf.get("numFmtId", 0)) in _DATE_FORMATS | own}


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _value(cell, shared: dict[int, str], dated: set[int]):
    kind, raw = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) or None
    text = raw.text if raw is not None else None
    if text is None:
        return None
    if kind == "s":
        return shared[int(text)] or None
    if kind == "b":
        return text == "1"
    if kind in ("str", "d"):
        return text
    if kind == "e":
        return None
    number = float(text)
    if int(cell.get("s", 0)) in dated:
        return _EPOCH + datetime.timedelta(seconds=round(number * 86400, 3))
    return int(number) if number.is_integer() and "e" not in text.lower() and "." not in text else number


def _balanced(text: bytes) -> bool:
    """Whether no comment or literal section is open at the end, in which a row end would be mere text."""
    return text.count(b"<![CDATA[") == text.count(b"]]>") and text.count(b"<!--") == text.count(b"-->")


def _referred(body: bytes, prefix: bytes, shared: list[str]) -> dict[int, str]:
    """The shared strings that cells of a piece refer to; where cells are written in an unusual way, any that may be."""
    found = re.findall(rb"<%sc\b[^>]*\bt=[\"']s[\"'][^>]*>\s*<%sv[^>]*>\s*(\d+)" % (prefix, prefix), body)
    if len(found) != len(re.findall(rb"\bt\s*=\s*[\"']s[\"']", body)):
        found = re.findall(rb">\s*(\d+)\s*<", body)
    return {k: shared[k] for k in {int(x) for x in found} if k < len(shared)}


def _utf8(f, size: int) -> Iterator[bytes]:
    """The text of a sheet in blocks, as UTF-8 whatever Unicode form it has."""
    first = f.read(max(size, 2))
    form = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(first[:2])
    decoder = codecs.getincrementaldecoder(form)() if form else None
    block = first[2:] or f.read(size) if form else first
    while block:
        if text := decoder.decode(block).encode() if decoder else block:
            yield text
        block = f.read(size)


def pieces(file, sheet: str | None = None, size: int = PIECE) -> Iterator[dict]:
    """A sheet (default the first) cut after row ends: the text of some rows, the numbers of the first and last, what it refers to.

    ``start`` is the number after the last row before, so that rows missing between pieces belong to one.
    """
    found = sheet_paths(file)
    with zipfile.ZipFile(file) as z:
        shared, dated = _shared(z), sorted(_date_styles(z))
        with z.open(found[sheet] if sheet is not None else next(iter(found.values()))) as f:
            held, prefix, expected, over = bytearray(), None, 1, False
            blocks = _utf8(f, min(size, BLOCK))
            while not over:
                block = next(blocks, b"")
                held += block
                if prefix is None:
                    top = re.search(rb"<((?:[\w.-]+:)?)sheetData\b[^>]*>", held)
                    if top is None or top[0].endswith(b"/>"):
                        over = top is not None or not block
                        continue
                    prefix, root = top[1], re.search(rb"<(?:[\w.-]+:)?worksheet\b[^>]*>", held)
                    if root is None:
                        raise ValueError("a sheet without a root")
                    head, tail = bytes(root[0]), b"</%sworksheet>" % prefix
                    row_end, sheet_end = b"</%srow>" % prefix, b"</%ssheetData" % prefix
                    opening = re.compile(rb"<%srow\b([^>]*)>" % prefix)
                    del held[: top.end()]
                last = held.find(sheet_end)
                over = last >= 0 and _balanced(held[:last])
                if not over and not block:
                    raise EOFError("the sheet ends within its rows")
                if not over and len(held) < size:
                    continue
                cut = last if over else held.rfind(row_end) + len(row_end)
                if not over and (cut < len(row_end) or not _balanced(held[:cut])):
                    continue
                body, start = bytes(held[:cut]), expected
                for tag in opening.finditer(body):
                    number = re.search(rb"(?<![\w:.-])r\s*=\s*[\"'](\d+)", tag[1])
                    expected = (int(number[1]) if number else expected) + 1
                if expected > start:
                    yield {"start": start, "end": expected - 1, "body": head + body + tail, "strings": _referred(body, prefix, shared), "dated": dated}
                del held[:cut]


def piece_rows(piece: dict) -> Iterator[tuple[int, list]]:
    """Number and values of the rows of a piece that hold something."""
    expected, strings, dated = piece["start"], dict(piece["strings"]), set(piece["dated"])
    for node in ElementTree.fromstring(piece["body"]):
        if node.tag != f"{_MAIN}row":
            continue
        number = int(node.get("r", expected))
        expected = number + 1
        row: list = []
        for i, cell in enumerate(node.findall(f"{_MAIN}c")):
            at = _column(cell.get("r")) if cell.get("r") else i
            row += [None] * (at + 1 - len(row))
            row[at] = _value(cell, strings, dated)
        if any(v is not None for v in row):
            yield number, row


def header_names(row: list) -> list[str]:
    """Column names: blank ones by position, repeated ones numbered."""
    out: list[str] = []
    for i, v in enumerate(row):
        name = f"Unnamed: {i}" if v is None or str(v) == "" else str(v)
        base, n = name, 0
        while name in out:
            n += 1
            name = f"{base}.{n}"
        out.append(name)
    return out


_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")


def _kind(v) -> str:
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "long"
    if isinstance(v, float):
        return "double"
    if isinstance(v, datetime.datetime):
        return "time"
    if _NUMBER.match(v):
        return "long" if re.fullmatch(r"\s*[+-]?\d{1,18}\s*", v) else "double"
    return "string"


def _typed(seen: set[str]) -> T.DataType:
    """Type of a column from the kinds of its values: text that looks like numbers is numeric, no values are double."""
    if not seen or seen <= {"long", "double"} and seen != {"long"}:
        return T.DoubleType()
    return {"bool": T.BooleanType(), "time": T.TimestampNTZType(), "long": T.LongType()}.get(next(iter(seen)), T.StringType()) if len(seen) == 1 else T.StringType()


def _cast(v, kind: T.DataType):
    if v is None:
        return None
    if isinstance(kind, T.StringType):
        return v.isoformat(sep=" ") if isinstance(v, datetime.datetime) else str(v)
    if isinstance(kind, T.LongType):
        return int(v)
    return float(v) if isinstance(kind, T.DoubleType) else v


class Unreadable(ValueError):
    """The file is no workbook, or a damaged one."""


def _content(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(re.sub(r"([\\{}\[\]*?])", r"\\\1", path)).select("content")


def _files(batches) -> Iterator[io.BytesIO]:
    for batch in batches:
        for content in batch.column(0):
            yield io.BytesIO(content.as_buffer())


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    """Sheet names of a workbook in any store, in workbook order."""
    return _asked(spark, path, lambda file: "\n".join(sheet_paths(file))).split("\n")


def _asked(spark: SparkSession, path: str, question) -> str:
    """What a task answers about a file; only faults of the file itself make it unreadable."""

    def answer(batches):
        for file in _files(batches):
            try:
                said = [question(file), None]
            except (zipfile.BadZipFile, ElementTree.ParseError, EOFError, LookupError, TypeError, ValueError) as e:
                said = [None, f"{type(e).__name__}: {e}"]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in said], ["said", "fault"])

    row = _content(spark, path).mapInArrow(answer, "said string, fault string").first()
    if row is None or row["fault"]:
        raise Unreadable(row["fault"] if row else "no such file")
    return row["said"]


_PIECES = "sheet int, piece long, start long, end long, body binary, strings map<long,string>, dated array<long>, fault string"
_FAULTS = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, EOFError, LookupError, TypeError, ValueError)


def _inflated(sheets: list[str | None], size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of sheets, and a row of its own, numbered -1, with what is wrong with the file, if anything."""
    shape = pa.schema([("sheet", pa.int32()), ("piece", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("body", pa.binary()),
                       ("strings", pa.map_(pa.int64(), pa.string())), ("dated", pa.list_(pa.int64())), ("fault", pa.string())])
    for file in _files(batches):
        fault = None
        try:
            k = itertools.count()
            for i, sheet in enumerate(sheets):
                for piece in pieces(file, sheet, size):
                    yield pa.RecordBatch.from_pylist([piece | {"sheet": i, "piece": next(k), "strings": list(piece["strings"].items())}], shape)
        except _FAULTS as e:
            fault = f"{type(e).__name__}: {e}"
        yield pa.RecordBatch.from_pylist([{"piece": -1, "fault": fault}], shape)


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece: its sheet, the header if it is there, kinds of values by column, the numbers of the last row that holds something and of the last."""
    shape = pa.schema([("sheet", pa.int32()), ("end", pa.int64()), ("header", pa.list_(pa.string())), ("kinds", pa.list_(pa.list_(pa.string()))), ("last", pa.int64()), ("fault", pa.string())])
    for batch in batches:
        for piece in batch.to_pylist():
            header, kinds, last, fault = None, [], 0, None
            try:
                for number, row in piece_rows(piece):
                    last = max(last, number)
                    if number == 1:
                        header = [None if v is None else str(v) for v in row]
                        continue
                    kinds += [set() for _ in row[len(kinds) :]]
                    for seen, v in zip(kinds, row, strict=False):
                        if v is not None:
                            seen.add(_kind(v))
            except _FAULTS as e:
                fault = f"{type(e).__name__}: {e}"
            yield pa.RecordBatch.from_pylist([{"sheet": piece["sheet"], "end": piece["end"], "header": header, "kinds": [sorted(k) for k in kinds], "last": last, "fault": fault}], shape)


def read_sheet(spark: SparkSession, path: str, sheet: str | list[str] | None = None) -> DataFrame:
    """A sheet (default the first) as a table with ``_row_id``; a sheet that is not there raises KeyError.

    Rows missing from the file are empty rows, trailing empty ones are dropped. Several sheets are one table that
    goes on from each to the next: types hold for all of them, only the last one's trailing empty rows are dropped.
    """
    asked = sheet if isinstance(sheet, list) else [sheet]
    if asked != [None] and (missing := set(asked) - set(sheet_names(spark, path))):
        raise KeyError(min(missing))
    size = PIECE
    cut = materialise(_content(spark, path).mapInArrow(lambda it: _inflated(asked, size, it), _PIECES), "sheet-pieces")
    n, fault = cut.agg(F.count(F.lit(1)), F.max("fault")).first()
    if not n or fault:
        raise Unreadable(fault or "no such file")
    dealt = cut.filter("piece >= 0").repartition(max(1, n - 1), "piece")
    told = dealt.mapInArrow(_surveyed, "sheet int, end long, header array<string>, kinds array<array<string>>, last long, fault string").collect()
    if any(r["fault"] for r in told):
        raise Unreadable(next(r["fault"] for r in told if r["fault"]))
    header = next((r["header"] for r in sorted(told, key=lambda r: r["sheet"]) if r["header"] is not None), [])
    wide = max([len(header), *(len(r["kinds"]) for r in told)])
    final = len(asked) - 1
    last = [max([0, *(r["last" if i == final else "end"] for r in told if r["sheet"] == i)]) for i in range(len(asked))]
    before = list(itertools.accumulate((max(0, k - 1) for k in last[:-1]), initial=0))
    kinds = [set().union(*(r["kinds"][i] for r in told if i < len(r["kinds"]))) for i in range(wide)]
    named = zip(header_names(_filled(header, wide)), kinds, strict=True)
    schema = T.StructType([*(T.StructField(name, _typed(seen)) for name, seen in named), T.StructField("_row_id", T.LongType())])
    fields, shape = schema.fields[:-1], to_arrow_schema(schema)

    def parse(batches):
        for batch in batches:
            for piece in batch.to_pylist():
                found = dict(piece_rows(piece))
                numbers = range(max(2, piece["start"]), min(piece["end"], last[piece["sheet"]]) + 1)
                for low in range(0, len(numbers), BATCH):
                    own = numbers[low : low + BATCH]
                    taken = [found.get(k, ()) for k in own]
                    columns = [[_cast(row[i], f.dataType) if i < len(row) else None for row in taken] for i, f in enumerate(fields)]
                    columns.append([k - 2 + before[piece["sheet"]] for k in own])
                    yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(columns, shape, strict=True)], schema=shape)

    return dealt.mapInArrow(parse, schema)


def _filled(header: list, width: int) -> list:
    return [*header, *[None] * (width - len(header))]


# Writing


class TooLarge(ValueError):
    """More rows than a sheet holds; extracts are never cut."""


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    if isinstance(v, datetime.datetime):
        return f'<c r="{ref}" s="1"><v>{(v.replace(tzinfo=None) - _EPOCH).total_seconds() / 86400!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_STYLES = (
    f'{_HEAD}<styleSheet {_NS}><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>'
)


def _sheet(z: zipfile.ZipFile, part: str, header: list[str], body, every: int = 10_000, progress=None, cancelled=None, before: int = 0) -> int:
    """Write a sheet; ``before`` rows of earlier sheets count for the progress. Returns the number of rows."""
    n = 0
    with z.open(part, "w", force_zip64=True) as f:
        view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
        f.write(f"{_HEAD}<worksheet {_NS}>{view}<sheetData>".encode())
        for n, row in enumerate(_chained(header, body)):
            cells = "".join(_cell(f"{_letters(i)}{n + 1}", v) for i, v in enumerate(row))
            f.write(f'<row r="{n + 1}">{cells}</row>'.encode())
            if n and (before + n) % every == 0:
                if cancelled and cancelled():
                    raise InterruptedError("cancelled")
                if progress:
                    progress(before + n)
        f.write(b"</sheetData></worksheet>")
    return n


def _chained(header, body):
    yield header
    yield from body


def write_workbook(path: str, sheets: list[tuple[str, list[str], Iterator]], progress=None, cancelled=None) -> None:
    """Write (name, header, rows) sheets as rows come; the file appears only when it is whole."""
    partial = f"{path}.partial"
    try:
        with zipfile.ZipFile(partial, "w", zipfile.ZIP_DEFLATED) as z:
            kinds = "".join(
                f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                for i in range(1, len(sheets) + 1)
            )
            z.writestr("[Content_Types].xml", (
                f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                '<Default Extension="xml" ContentType="application/xml"/>'
                '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
                '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
                f"{kinds}</Types>"
            ))
            office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
            package = "http://schemas.openxmlformats.org/package/2006/relationships"
            z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            listed = "".join(f'<sheet name="{escape(name[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, (name, _, _) in enumerate(sheets, 1))
            z.writestr("xl/workbook.xml", f'{_HEAD}<workbook {_NS} xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
            links = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
            z.writestr("xl/_rels/workbook.xml.rels", (
                f'{_HEAD}<Relationships xmlns="{package}">{links}<Relationship Id="rId{len(sheets) + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>'
            ))
            z.writestr("xl/styles.xml", _STYLES)
            done = 0
            for i, (_, header, body) in enumerate(sheets, 1):
                done += _sheet(z, f"xl/worksheets/sheet{i}.xml", header, body, progress=progress, cancelled=cancelled, before=done)
        os.replace(partial, path)
    finally:
        if os.path.exists(partial):
            os.remove(partial)


def frame_sheet(name: str, frame: DataFrame) -> tuple[str, list[str], Iterator]:
    """A frame as a sheet; its rows stream through the driver a partition at a time."""
    n = frame.limit(SHEET_ROWS).count()
    if n > SHEET_ROWS - 1:
        raise TooLarge(f"The extract has more than {SHEET_ROWS - 1:,} rows, the most a sheet holds; write CSV or narrow it")
    return name, frame.columns, (tuple(r) for r in frame.toLocalIterator(prefetchPartitions=True))


def sheet_series(name: str, count: int) -> list[str]:
    """Names of the sheets that a table goes over: ``name``, ``name (2)`` and so on."""
    return [name[:31], *(f"{name[: 31 - len(mark)]}{mark}" for mark in (f" ({k})" for k in range(2, count + 1)))]


def frame_sheets(name: str, frame: DataFrame, most: int = SHEET_ROWS - 1) -> list[tuple[str, list[str], Iterator]]:
    """A frame of any length as sheets of up to ``most`` rows, each with the header; they have to be written in this order.

    Rows stream through the driver a partition at a time, once for all sheets.
    """
    count = max(1, -(-frame.count() // most))
    rows = (tuple(r) for r in frame.toLocalIterator(prefetchPartitions=True))
    names = sheet_series(name, count)
    return [(n, frame.columns, itertools.islice(rows, most) if n != names[-1] else rows) for n in names]
