"""Excel workbooks with the standard library: the first sheet in, one sheet out.

Workbooks are small by nature (a sheet has at most 1,048,576 rows); both ways go
through the driver, row by row.
"""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from gridsmith.errors import FileError

#: Rows whose cells decide the types of columns.
SAMPLED = 100
#: Excel's day 0 is this many days before 1970-01-01.
DAY_OFFSET = 25569
LIMIT_ROWS = 1_048_575
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def cells(path: str) -> Iterator[list]:
    """The rows of the first sheet: str, int, float, bool or None."""
    try:
        book = zipfile.ZipFile(path)
    except (OSError, zipfile.BadZipFile) as e:
        raise FileError(f"Cannot read {path}: {e}") from e
    with book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot().findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in item.iter(f"{{{_NS['m']}}}t")))
        sheet = "xl/worksheets/sheet1.xml"
        if sheet not in names:
            sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), default=None)
            if sheet is None:
                raise FileError(f"{path} has no sheet")
        for _, row in ElementTree.iterparse(book.open(sheet)):
            if row.tag != f"{{{_NS['m']}}}row":
                continue
            out: list = []
            for c in row.findall("m:c", _NS):
                at = _column(c.get("r")) if c.get("r") else len(out)
                out += [None] * (at + 1 - len(out))
                kind, v = c.get("t", "n"), c.find("m:v", _NS)
                if kind == "inlineStr":
                    out[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif v is not None and v.text is not None:
                    if kind == "s":
                        out[at] = shared[int(v.text)]
                    elif kind == "b":
                        out[at] = v.text == "1"
                    elif kind == "n":
                        x = float(v.text)
                        out[at] = int(x) if re.fullmatch(r"-?\d+", v.text) else x
                    else:
                        out[at] = v.text
            yield out
            row.clear()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet: row 1 names the columns; a column is long, double or string by up to SAMPLED rows, mixed ones string."""
    rows = cells(path)
    head = next(rows, [])
    names = [str(h) if isinstance(h, (str, int, float)) and not isinstance(h, bool) else f"Column_{i}" for i, h in enumerate(head)]
    data = [(r + [None] * len(names))[: len(names)] for r in rows]
    kinds = []
    for i in range(len(names)):
        seen = [r[i] for r in data[:SAMPLED]]
        if seen and all(isinstance(v, int) and not isinstance(v, bool) for v in seen):
            kinds.append("bigint")
        elif seen and all(isinstance(v, float) for v in seen):
            kinds.append("double")
        else:
            kinds.append("string")

    def cell(v, kind):
        if v is None:
            return None
        if kind == "string":
            return str(v)
        try:
            return int(v) if kind == "bigint" else float(v)
        except ValueError:
            return None

    typed = [tuple(cell(v, k) for v, k in zip(r, kinds, strict=True)) for r in data]
    return spark.createDataFrame(typed, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        return f'<c r="{ref}" s="1"><v>{(v - dt.date(1970, 1, 1)).days + DAY_OFFSET}</v></c>'
    if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write(names: list[str], rows: Iterable[tuple], path: str) -> int:
    """One sheet with a header row; returns the number of rows."""
    fixed = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>',
    }
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in fixed.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_NS["m"]}"><sheetData>'.encode())
            for y, row in enumerate(_chained(names, rows), 1):
                sheet.write(f'<row r="{y}">{"".join(_cell(f"{_letters(x)}{y}", v) for x, v in enumerate(row))}</row>'.encode())
                n = y - 1
                if n > LIMIT_ROWS:
                    raise FileError("Too many rows for a sheet")
            sheet.write(b"</sheetData></worksheet>")
    return n


def _chained(names: list[str], rows: Iterable[tuple]) -> Iterator:
    yield names
    yield from rows
