"""Workbooks (XLSX) of report size, written and read with the standard library: a zip of XML parts."""

from __future__ import annotations

import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.reports import check_sheet

# Namespaces and parts of the format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPES = f"""<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>"""


def _cell(value: object) -> str:
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbook(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """One table as a workbook with one sheet; more rows than a sheet holds raise ValueError. Rows come one partition at a time."""
    table = check_sheet(df, sheet)
    link = f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_REL}/{{kind}}" Target="{{target}}"/></Relationships>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", _TYPES)
        book.writestr("_rels/.rels", link.format(kind="officeDocument", target="xl/workbook.xml"))
        book.writestr("xl/_rels/workbook.xml.rels", link.format(kind="worksheet", target="worksheets/sheet1.xml"))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name="{escape(sheet[:31], {chr(34): "&quot;"})}" sheetId="1" r:id="r1"/></sheets></workbook>')
        with book.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            out.write(f"<row>{''.join(map(_cell, table.columns))}</row>".encode())
            for row in table.toLocalIterator():
                out.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
            out.write(b"</sheetData></worksheet>")


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet (the first by default) as text columns; the first row names them."""
    tag = lambda name: f"{{{_MAIN}}}{name}"
    with zipfile.ZipFile(Path(path)) as book:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(f"{{{_REL}}}id")]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(tag("sheet"))]
        target = next((t for name, t in sheets if sheet in (None, name)), None)
        if target is None:
            raise ValueError(f"{path} has no sheet {sheet}")
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(tag("t"))) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(tag("si"))]
        rows = []
        for row in ElementTree.fromstring(book.read("xl/" + target.removeprefix("/xl/"))).iter(tag("row")):
            cells: dict[int, str | None] = {}
            for i, c in enumerate(row.iter(tag("c"))):
                ref = re.match(r"[A-Z]+", c.get("r") or "")
                at = i if ref is None else sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(ref[0]))) - 1
                value = c.find(tag("v"))
                text = "".join(t.text or "" for t in c.iter(tag("t"))) if c.get("t") == "inlineStr" else value.text if value is not None else None
                cells[at] = shared[int(text)] if c.get("t") == "s" and text else text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    names = rows[0] if rows else []
    body = [tuple((r + [None] * len(names))[: len(names)]) for r in rows[1:]]
    return spark.createDataFrame(body, ", ".join(f"`{n}` string" for n in names))
