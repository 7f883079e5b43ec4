"""Files that other programs open: MAT version 5 for matrices and lists of names, XLSX workbooks, both ways where runs need it.

Files are written below paths that pyarrow's file systems reach, under a name of their own first and moved when they are whole,
so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import io
import itertools
import math
import posixpath
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .edf import file_system

# -- MAT version 5


#: Fixed values of the format: data types and array classes.
INT8, UINT16, INT32, UINT32, DOUBLE, MATRIX = 1, 4, 5, 6, 9, 14
CELL_CLASS, CHAR_CLASS, DOUBLE_CLASS = 1, 4, 6


def _element(kind: int, data: bytes) -> bytes:
    if len(data) > 0xFFFFFFFF:
        raise ValueError("a MAT file of version 5 holds 4 GB a variable at most")
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _array(name: str, kind: int, shape: tuple[int, ...], body: bytes) -> bytes:
    head = _element(UINT32, struct.pack("<II", kind, 0)) + _element(INT32, struct.pack(f"<{len(shape)}i", *shape)) + _element(INT8, name.encode("ascii"))
    return _element(MATRIX, head + body)


def mat_variable(name: str, value: np.ndarray | list[str] | str) -> bytes:
    """A numeric array (1-d ones are rows), a text, or a list of texts (a row of cells)."""
    if isinstance(value, str):
        units = value.encode("utf-16-le")
        return _array(name, CHAR_CLASS, (1, len(units) // 2), _element(UINT16, units))
    if isinstance(value, list):
        return _array(name, CELL_CLASS, (1, len(value)), b"".join(mat_variable("", v) for v in value))
    x = np.atleast_2d(np.asarray(value, dtype="<f8"))
    return _array(name, DOUBLE_CLASS, x.shape, _element(DOUBLE, x.tobytes(order="F")))


def mat_bytes(variables: dict[str, np.ndarray | list[str] | str]) -> bytes:
    head = b"MATLAB 5.0 MAT-file".ljust(116) + b" " * 8 + struct.pack("<H", 0x0100) + b"IM"
    return head + b"".join(mat_variable(k, v) for k, v in variables.items())


def put_file(path: str, data: bytes) -> None:
    """Whole or not at all; an older file of that name goes."""
    system, at = file_system(path)
    system.create_dir(posixpath.dirname(at), recursive=True)
    own = f"{posixpath.dirname(at)}/.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        f.write(data)
    if system.get_file_info(at).is_file:
        system.delete_file(at)
    system.move(own, at)


def _safe(name: str) -> str:
    return re.sub(r"[^\w.+-]", "_", name) or "_"


def mat_signals(wide: DataFrame, path: str) -> None:
    """`path`/SUBJECT/RUN.mat for every run, with `data` [channels, samples] and `ch_names`; and `path`/files, which lists them.  A run is one task."""

    def put(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("channel")
        subject, run = str(g.subject.iloc[0]), str(g["run"].iloc[0])
        data = mat_bytes({"data": np.stack(g.samples.to_numpy()), "ch_names": [str(v) for v in g["name"]]})
        at = f"{path}/{_safe(subject)}/{_safe(run)}.mat"
        put_file(at, data)
        return pd.DataFrame([(subject, run, at, len(data))], columns=["subject", "run", "file", "bytes"])

    done = wide.select("subject", "run", "channel", "name", "samples").groupBy("subject", "run").applyInPandas(put, "subject string, run string, file string, bytes long")
    done.write.mode("overwrite").json(f"{path}/files")


def mat_labels(lists: DataFrame, path: str) -> None:
    """`path`/SUBJECT/soz_info.mat and resect_info.mat from the labels' lists (see `sinks.labels`); indices count from 0."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                for word, channels, names in (("soz", r.soz_channels, r.soz_names), ("resect", r.resected_channels, r.resected_names)):
                    at = f"{path}/{_safe(str(r.subject))}/{word}_info.mat"
                    data = mat_bytes({f"{word}_channel_indices": np.array(channels, dtype=float), f"{word}_channel_names": [str(n) for n in names]})
                    put_file(at, data)
                    rows.append((str(r.subject), at, len(data)))
            yield pd.DataFrame(rows, columns=["subject", "file", "bytes"])

    lists.mapInPandas(put, "subject string, file string, bytes long").write.mode("overwrite").json(f"{path}/label_files")


# -- XLSX


#: Rows of a sheet and characters of a cell, at most; names of the parts' kinds.
MOST_ROWS, MOST_TEXT = 1_048_576, 32_767
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
SHEETS = "application/vnd.openxmlformats-officedocument.spreadsheetml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def column_name(k: int) -> str:
    """0 is A, 26 is AA."""
    return (column_name(k // 26 - 1) if k > 25 else "") + chr(65 + k % 26)


def _cell(ref: str, v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, int) or isinstance(v, float) and math.isfinite(v):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    text = str(v)
    if len(text) > MOST_TEXT:
        raise ValueError(f"a cell of {len(text)} characters; a workbook takes {MOST_TEXT}")
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", lambda m: f"_x{ord(m[0]):04X}_", text)
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet(columns: list[str], rows: Iterator) -> Iterator[str]:
    yield f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>'
    for n, row in enumerate(([columns], rows), 0):
        for at, r in enumerate(row, 1 + n):
            if at > MOST_ROWS:
                raise ValueError(f"a sheet takes {MOST_ROWS} rows; write the table as CSV")
            yield f'<row r="{at}">{"".join(_cell(f"{column_name(k)}{at}", v) for k, v in enumerate(r))}</row>'
    yield "</sheetData></worksheet>"


def _book(f, tables: dict[str, tuple[list[str], Iterator]]) -> None:
    """Sheets (columns, rows), by name, into an open file; rows stream."""
    numbers = range(1, len(tables) + 1)
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{SHEETS}.worksheet+xml"/>' for k in numbers)
        z.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{SHEETS}.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(numbers, tables))
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{k}" Type="{LINKS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers)
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>')
        for k, (columns, rows) in zip(numbers, tables.values()):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as part:
                for text in _sheet(columns, rows):
                    part.write(text.encode())


def _sheet_name(name: str) -> str:
    return re.sub(r"[\[\]:*?/\\]", "_", name)[:31]


def workbook(tables: dict[str, DataFrame], path: str) -> None:
    """One XLSX file with a sheet for each table.  For reports that people read: rows come to the driver one partition at a time and go straight into the file."""
    names = [_sheet_name(n) for n in tables]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("names of sheets are the same in their first 31 letters")
    system, at = file_system(path)
    system.create_dir(posixpath.dirname(at), recursive=True)
    own = f"{posixpath.dirname(at)}/.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        _book(f, {n: (df.columns, df.toLocalIterator()) for n, df in zip(names, tables.values())})
    if system.get_file_info(at).is_file:
        system.delete_file(at)
    system.move(own, at)


def workbooks(df: DataFrame, path: str, sheet: str, rows: int = 50_000) -> None:
    """A long table as workbooks of up to `rows` rows below `path`, each partition writing its own."""
    columns, name = df.columns, _sheet_name(sheet)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), []

        def book(k: int, some: list[tuple]) -> pa.RecordBatch:
            raw = io.BytesIO()
            _book(raw, {name: (columns, iter(some))})
            put_file(at := f"{path}/part-{part:05d}-{k:05d}.xlsx", raw.getvalue())
            return pa.RecordBatch.from_pydict({"file": [at]})

        k = 0
        for b in batches:
            held += zip(*[c.to_pylist() for c in b.columns])
            while len(held) >= rows:
                yield book(k, held[:rows])
                held, k = held[rows:], k + 1
        if held:
            yield book(k, held)

    if not df.mapInArrow(put, "file string").count():
        workbook({sheet: df.limit(0)}, f"{path}/part-00000-00000.xlsx")  # its header alone


def _number(ref: str | None) -> int | None:
    """A cell's column by its reference."""
    letters = re.match(r"[A-Z]+", ref or "")
    if not letters:
        return None
    at = -1
    for x in letters[0]:
        at = (at + 1) * 26 + ord(x) - 65
    return at


def _elements(f, name: str) -> Iterator[ElementTree.Element]:
    """Elements of that name as they end; what has been read is let go."""
    root = None
    for event, node in ElementTree.iterparse(f, ("start", "end")):
        if root is None:
            root = [node]
        elif event == "start" and node.tag == f"{{{MAIN}}}sheetData":
            root.append(node)
        if event == "end" and node.tag == f"{{{MAIN}}}{name}":
            yield node
            for r in root:
                r.clear()


def sheet_rows(raw: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The cells of a workbook's first sheet, or of a named one, as texts, row by row."""
    tag = lambda n: f"{{{MAIN}}}{n}"
    text = lambda node: "".join(t.text or "" for t in node.iter(tag("t")))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                shared = [text(si) for si in _elements(f, "si")]
        sheets = list(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(tag("sheet")))
        found = next((s for s in sheets if sheet is None or s.get("name") == sheet), None)
        if found is None:
            raise ValueError(f"no sheet {sheet or ''} in the workbook")
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        part = posixpath.normpath(posixpath.join("/xl", links[found.get(f"{{{LINKS}}}id")])).lstrip("/")
        with z.open(part) as f:
            for row in _elements(f, "row"):
                cells: list[str | None] = []
                for k, c in enumerate(row.iter(tag("c"))):
                    at = _number(c.get("r"))
                    at = k if at is None else at
                    cells += [None] * (at + 1 - len(cells))
                    v = c.find(tag("v"))
                    cells[at] = text(c) if c.get("t") == "inlineStr" else shared[int(v.text)] if c.get("t") == "s" else None if v is None else v.text
                yield cells


def spreadsheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A workbook's sheet, or that of all workbooks of a folder, as a table of texts, whose columns the first row of each names.

    A workbook is one task's work and its rows stream; columns are those of the first workbook.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b.content:
                yield pd.DataFrame({"cells": [next(sheet_rows(bytes(raw), sheet), [])]})

    first = files.mapInPandas(heads, "cells array<string>").first()
    names = [n for n in (first["cells"] if first else []) if n]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b.content:
                rows = sheet_rows(bytes(raw), sheet)
                head = next(rows, [])
                at = [head.index(n) if n in head else len(head) for n in names]
                while some := list(itertools.islice(rows, 10_000)):
                    yield pd.DataFrame({"cells": [[r[k] if k < len(r) else None for k in at] for r in some]})

    rows = files.mapInPandas(decode, "cells array<string>")
    return rows.select(*[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)])
