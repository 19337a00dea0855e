"""Workbooks (.xlsx) as a Spark data source, with the standard library: spark.read.format("workbook") and write.

Reading gives cells (document, sheet_no, sheet, row, col, text, sup: the superscripts of a cell, apart from its text), in
one partition for each sheet of each workbook; a sheet is read as a stream, so its size does not matter. Writing takes
sheet, row, col, text (and sup) and makes one workbook of what each task has, sorted by sheet, row and column or not.
Paths are any that pyarrow's file systems open (local, file:, s3:, gs:, hdfs:).
"""

from __future__ import annotations

import contextlib
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "document string, sheet_no int, sheet string, row int, col int, text string, sup string"
#: Cells of an Arrow batch.
BATCH = 8_192
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def _runs(node: ElementTree.Element) -> tuple[str, str]:
    """The text of a string and its superscripts."""
    if node.find(f"{_NS}r") is None:
        return "".join(t.text or "" for t in node.iter(f"{_NS}t")), ""
    text, sup = "", ""
    for r in node.iterfind(f"{_NS}r"):
        said = "".join(t.text or "" for t in r.iterfind(f"{_NS}t"))
        up = r.find(f"{_NS}rPr/{_NS}vertAlign")
        if up is not None and up.get("val") == "superscript":
            sup += said
        else:
            text += said
    return text, sup


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Name and part of each sheet, in order."""
    targets = {}
    with contextlib.suppress(KeyError):  # without relations the parts are numbered
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for i, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(f"{_NS}sheets/{_NS}sheet"), 1):
        target = targets.get(s.get(_REL)) or f"worksheets/sheet{i}.xml"
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def cells(z: zipfile.ZipFile, part: str) -> Iterator[tuple[int, int, str, str]]:
    """row, column, text and superscripts of a sheet's cells that hold any."""
    shared = []
    with contextlib.suppress(KeyError), z.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{_NS}si":
                shared.append(_runs(node))
                node.clear()
    with z.open(part) as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{_NS}row":
                for c in node.iterfind(f"{_NS}c"):
                    letters, row = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
                    value = c.find(f"{_NS}v")
                    if c.get("t") == "s" and value is not None:
                        text, sup = shared[int(value.text)]
                    elif c.get("t") == "inlineStr":
                        text, sup = _runs(c.find(f"{_NS}is"))
                    else:
                        text, sup = (value.text if value is not None else "") or "", ""
                    if text or sup:
                        yield int(row), reduce(lambda n, x: 26 * n + ord(x) - 64, letters, 0), text, sup
                node.clear()


@dataclass
class Sheet(InputPartition):
    document: str
    no: int
    name: str
    part: str


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Sheet]:
        system, at = store(self.path)
        found = system.get_file_info(at)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        out = []
        for f in sorted(x.path for x in files if x.path.lower().endswith(".xlsx")):
            with system.open_input_file(f) as data, zipfile.ZipFile(data) as z:
                out += [Sheet(f, i, name, part) for i, (name, part) in enumerate(sheets(z), 1)]
        return out or [Sheet("", 0, "", "")]

    def read(self, sheet: Sheet) -> Iterator[pa.RecordBatch]:
        if not sheet.document:
            return
        system, _ = store(self.path)
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch(rows):
            own = [(sheet.document, sheet.no, sheet.name, *r) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own, strict=True), kinds, strict=True)], names)

        with system.open_input_file(sheet.document) as data, zipfile.ZipFile(data) as z:
            held = []
            for cell in cells(z, sheet.part):
                held.append(cell)
                if len(held) == BATCH:
                    yield batch(held)
                    held = []
            if held:
                yield batch(held)


@dataclass
class Made(WriterCommitMessage):
    temporary: str
    path: str


def _name(col: int) -> str:
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def _workbook(rows: dict[str, dict[int, dict[int, tuple[str, str]]]]) -> bytes:
    """A workbook of sheets, rows and cells with inline texts."""
    main, data = _NS[1:-1], io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(rows)
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>")
        kind = _REL[1:].split("}")[0]
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{kind}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{kind}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        said = lambda t: f'<t xml:space="preserve">{escape(t)}</t>'
        for i, name in enumerate(names, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                for row, own in sorted(rows[name].items()):
                    inner = "".join(f'<c r="{_name(col)}{row}" t="inlineStr"><is>' + (f'<r>{said(text)}</r><r><rPr><vertAlign val="superscript"/></rPr>{said(sup)}</r>' if sup else said(text)) + "</is></c>" for col, (text, sup) in sorted(own.items()))
                    f.write(f'<row r="{row}">{inner}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return data.getvalue()


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator) -> Made:
        rows: dict = {}
        for r in iterator:
            if r["text"] is not None:
                sup = (r["sup"] if "sup" in r else None) or ""
                own = rows.setdefault(r["sheet"], {}).setdefault(r["row"], {})
                if own.setdefault(r["col"], (r["text"], sup)) != (r["text"], sup):
                    raise ValueError(f"two texts for row {r['row']}, column {r['col']} of {r['sheet']!r} in one task")
        if not rows:
            return Made("", "")
        system, at = store(self.path)
        system.create_dir(at, recursive=True)
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{at}/_{name}.tmp") as f:
            f.write(_workbook(rows))
        return Made(f"{at}/_{name}.tmp", f"{at}/part-{name}.xlsx")

    def commit(self, messages: list[Made | None]) -> None:
        """Workbooks of tasks that counted get their names; what others left is no workbook."""
        system, at = store(self.path)
        if self.overwrite and system.get_file_info(at).type == fs.FileType.Directory:
            for f in system.get_file_info(fs.FileSelector(at)):
                if f.path.lower().endswith(".xlsx"):
                    system.delete_file(f.path)
        for m in messages:
            if m and m.path:
                system.move(m.temporary, m.path)

    def abort(self, messages: list[Made | None]) -> None:
        system, _ = store(self.path)
        for m in messages:
            if m and m.temporary:
                system.delete_file(m.temporary)


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark) -> None:
    spark.dataSource.register(Workbook)
