"""A workbook sink: rows to .xlsx files as a Spark data source, one or more for each partition of the data.

``save_workbooks`` is the way in; it registers the source. A file has the sheet of rows, as a named table with frozen
and filtered titles, and a sheet that says what was exported. The format holds 1,048,576 lines in a sheet; a partition
with more rows gives several files. Files are written through the file system that the path names (local, HDFS, S3 and
others that Arrow knows) beside their place and are moved there when all tasks are done.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from itertools import chain, islice
from typing import IO
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from specloom.operators.export import TITLES, WIDTHS, column_of, metadata_pairs
from specloom.session import is_local

ROWS_PER_SHEET = 1_000_000
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: Fixed values. Names and colours of the sheets: titles white on dark, rows for review yellow, thin gray borders.
SHEET, ABOUT = "Спецификация", "Сведения"
ABOUT_TITLES, ABOUT_WIDTHS = ("Параметр", "Значение"), (26, 56)
DARK, YELLOW, GRAY = "FF1F2937", "FFFEF3C7", "FFD1D5DB"
FOR_REVIEW = ("review", "unrecognized")
#: Styles of cells by their number in styles.xml.
PLAIN, TITLE, MARKED = 1, 2, 3


def column_letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _text(value: object) -> str:
    return escape("".join(c for c in str(value) if c >= " " and c not in "￾￿" or c in "\t\n\r"))


def _cell(ref: str, value, style: int) -> str:  # noqa: ANN001
    if value is None or value == "" or value != value:
        return f'<c r="{ref}" s="{style}"/>'
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{ref}" s="{style}"><v>{int(value) if float(value).is_integer() else value}</v></c>'
    return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{_text(value)}</t></is></c>'


def _row(at: int, values, style: int, height: int | None = None) -> str:  # noqa: ANN001
    tall = f' ht="{height}" customHeight="1"' if height else ""
    return f'<row r="{at}"{tall}>' + "".join(_cell(f"{column_letters(i)}{at}", v, style) for i, v in enumerate(values)) + "</row>"


def _sheet_head(widths, frozen: bool) -> str:  # noqa: ANN001
    pane = '<pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/>' if frozen else ""
    cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths))
    return f'{_XML}<worksheet xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheetViews><sheetView showGridLines="0" workbookViewId="0">{pane}</sheetView></sheetViews><cols>{cols}</cols><sheetData>'


def _styles() -> str:
    side = "".join(f'<{s} style="thin"><color rgb="{GRAY}"/></{s}>' for s in ("left", "right", "top", "bottom"))
    fill = lambda c: f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>'
    top = '<alignment vertical="top" wrapText="1"/>'
    xf = lambda font, f, align: f'<xf numFmtId="0" fontId="{font}" fillId="{f}" borderId="1" xfId="0" applyFont="1" applyFill="1" applyBorder="1" applyAlignment="1">{align}</xf>'
    return (
        f'{_XML}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/><name val="Calibri"/></font></fonts>'
        f'<fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fill(DARK)}{fill(YELLOW)}</fills>'
        f'<borders count="2"><border><left/><right/><top/><bottom/><diagonal/></border><border>{side}<diagonal/></border></borders><cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
        f'<cellXfs count="4"><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/>{xf(0, 0, top)}{xf(1, 2, "<alignment horizontal=\"center\" vertical=\"center\" wrapText=\"1\"/>")}{xf(0, 3, top)}</cellXfs></styleSheet>'
    )


def write_workbook(out: IO[bytes] | str, columns: list[str], rows: Iterator[tuple[list, bool]], sheet: str = SHEET, headers: bool = True, at: str | None = None) -> int:
    """Writes one workbook and returns its number of data rows. rows: the values and whether they are marked for review."""
    titles = [TITLES.get(column_of(c), c) for c in columns]
    widths = [min(60, max(10, WIDTHS.get(column_of(c), 14))) for c in columns]
    sheet, last = (sheet or SHEET)[:31], column_letters(len(columns) - 1)
    n = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write((_sheet_head(widths, headers) + (_row(1, titles, TITLE, 34) if headers else "")).encode())
            line = 2 if headers else 1
            for values, marked in rows:
                f.write(_row(line, values, MARKED if marked else PLAIN).encode())
                line, n = line + 1, n + 1
            table = headers and n > 0
            area = f"A1:{last}{max(1, line - 1)}"
            f.write(("</sheetData>" + ('<tableParts count="1"><tablePart r:id="r1"/></tableParts>' if table else f'<autoFilter ref="{area}"/>') + "</worksheet>").encode())
        about = _row(1, ABOUT_TITLES, TITLE) + "".join(_row(i, pair, PLAIN) for i, pair in enumerate(metadata_pairs(n, columns, at or datetime.now(timezone.utc).strftime("%d.%m.%Y %H:%M")), 2))
        z.writestr("xl/worksheets/sheet2.xml", _sheet_head(ABOUT_WIDTHS, False) + about + "</sheetData></worksheet>")
        if table:
            unique = [t if titles.index(t) == i else f"{t} {i + 1}" for i, t in enumerate(titles)]
            named = "".join(f"<tableColumn id=\"{i}\" name={quoteattr(t)}/>" for i, t in enumerate(unique, 1))
            z.writestr("xl/tables/table1.xml", f'{_XML}<table xmlns="{_MAIN}" id="1" name="SpecificationTable" displayName="SpecificationTable" ref="{area}" totalsRowShown="0"><autoFilter ref="{area}"/><tableColumns count="{len(titles)}">{named}</tableColumns><tableStyleInfo name="TableStyleMedium2" showFirstColumn="0" showLastColumn="0" showRowStripes="1" showColumnStripes="0"/></table>')
            z.writestr("xl/worksheets/_rels/sheet1.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_RELS}/table" Target="../tables/table1.xml"/></Relationships>')
        parts = [("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("worksheets/sheet2", "worksheet"), ("styles", "styles"), *([("tables/table1", "table")] if table else [])]
        listed = "".join(f'<Override PartName="/xl/{p}.xml" ContentType="{_TYPES}.{t}+xml"/>' for p, t in parts)
        z.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{listed}</Types>')
        z.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="r1"/><sheet name={quoteattr(ABOUT)} sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_RELS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{_RELS}/worksheet" Target="worksheets/sheet2.xml"/><Relationship Id="r3" Type="{_RELS}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _styles())
    return n


@dataclass
class Written(WriterCommitMessage):
    paths: list[str] = field(default_factory=list)


class WorkbookWriter(DataSourceWriter):
    """Each attempt writes files of its own name; those of the attempts that count are moved on commit, the others removed."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.sheet, self.headers, self.at = options["path"], options.get("sheet", SHEET), options.get("headers", "true").lower() == "true", options.get("at")
        self.status, self.most = options.get("status", "_status"), int(options.get("rows", ROWS_PER_SHEET))
        self.names = [f.name for f in schema.fields]
        self.run = uuid.uuid4().hex

    def folder(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, folder = self.folder()
        system.create_dir(folder, recursive=True)
        columns = [i for i, c in enumerate(self.names) if c != self.status]
        mark = self.names.index(self.status) if self.status in self.names else None
        rows = (([r[i] for i in columns], mark is not None and r[mark] in FOR_REVIEW) for r in iterator)
        paths: list[str] = []
        while (first := next(rows, None)) is not None:
            path = f"{folder}/.{self.run}-{uuid.uuid4().hex}.xlsx.part"
            with system.open_output_stream(path) as out:
                write_workbook(out, [self.names[i] for i in columns], chain([first], islice(rows, self.most - 1)), self.sheet, self.headers, self.at)
            paths.append(path)
        return Written(paths)

    def _sweep(self) -> None:
        system, folder = self.folder()
        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith(f".{self.run}-"):
                system.delete_file(f.path)

    def commit(self, messages: list) -> None:
        system, folder = self.folder()
        for i, path in enumerate(p for m in messages if m is not None for p in m.paths):
            system.move(path, f"{folder}/part-{i:05d}-{self.run[:8]}.xlsx")
        self._sweep()

    def abort(self, messages: list) -> None:
        self._sweep()


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(schema, dict(self.options))


def save_workbooks(rows: DataFrame, path: str, sheet: str = SHEET, headers: bool = True, status: str = "_status", at: str | None = None, shared: bool = False, rows_per_file: int = ROWS_PER_SHEET) -> None:
    """Adds workbooks of rows to a folder. status: a column that isn't written but marks rows for review.

    path: a URI, or a path of this machine, which on a cluster must be one that all executors share: say so by ``shared``.
    An empty table writes no file.
    """
    uri = path if "://" in path else f"file://{path}"
    if uri.startswith("file:") and not shared and not is_local(rows.sparkSession):
        raise ValueError("executors don't share a folder of this machine; give a URI, or shared=True for one that they do share")
    rows.sparkSession.dataSource.register(WorkbookSource)
    w = rows.write.format("workbook").mode("append").option("path", uri).option("sheet", sheet).option("headers", str(headers).lower()).option("status", status).option("rows", rows_per_file)
    (w.option("at", at) if at else w).save()
