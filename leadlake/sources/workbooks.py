"""Workbooks (.xlsx) as a Spark data source, for reading and writing.

Reading plans one partition per sheet of every file; a sheet is parsed as a stream
and comes out in Arrow batches, so a task never holds more than a piece of the sheet and
the file's table of shared texts. Pieces of plain cells are cut up by array operations;
where a piece has anything else, the rest of the sheet goes through the XML parser. A sheet or file that can't be read gives one row
with a reason instead of failing the load, if ``mode`` is ``permissive`` (the default);
``failfast`` raises.

Row numbers count the filled rows of a sheet from 0. Row 0 is the header, and every
row carries it: sheets of one file may differ in their columns. With ``blocks=true`` a
row of the table is a run of rows of one sheet (``rows``, from number ``first_row`` on), so
that what depends on the header is found once per run.

Paths are local, ``file:``, or of a store that Arrow opens; others are refused at once.
This module stands alone, so that executors need nothing of the package to run it.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "workbook"
SCHEMA = "src_group string, src_file string, section string, row_no long, header array<string>, cells array<string>, problem string"
BLOCKS = "src_group string, src_file string, section string, first_row long, header array<string>, rows array<array<string>>, problem string"
BATCH_ROWS = 4096
#: Rows of a block at most.
BLOCK_ROWS = 1024
#: Bytes of a sheet that are cut up together.
PIECE = 1 << 22
#: Rows that the XML parser gives together, and texts in bytes that are written together.
WAITING_ROWS, WRITTEN_BYTES = 256, 1 << 26
#: Rows of a sheet, by the file format; longer sections go on in further sheets.
SHEET_ROWS = 1_048_576

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_CELL, _VALUE, _INSIDE, _RUN = (f"{_MAIN}{tag}" for tag in ("c", "v", "is", "t"))
_XMLNS = f'xmlns="{_MAIN[1:-1]}"'.encode()
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_TEXTS = pa.list_(pa.string())
_ARROW = pa.schema([
    ("src_group", pa.string()), ("src_file", pa.string()), ("section", pa.string()), ("row_no", pa.int64()),
    ("header", _TEXTS), ("cells", _TEXTS), ("problem", pa.string()),
])
_ARROW_BLOCKS = pa.schema([
    ("src_group", pa.string()), ("src_file", pa.string()), ("section", pa.string()), ("first_row", pa.int64()),
    ("header", _TEXTS), ("rows", pa.list_(_TEXTS)), ("problem", pa.string()),
])
#: Characters that XML can't hold.
_BARRED = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]"
#: These, and characters that XML writes in another way.
_SPECIAL = r"[&<>\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a URI or local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    try:
        return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))
    except (pa.ArrowInvalid, NotImplementedError) as error:
        raise ValueError(f"workbooks can't be opened at {uri}: Arrow knows no such store") from error


@dataclass
class Sheet(InputPartition):
    path: str
    section: str | None
    entry: str | None
    problem: str | None = None


def _sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, entry) of the sheets in their order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    out = []
    for sheet in book.iter(f"{_MAIN}sheet"):
        target = links[sheet.get(_LINK)]
        out.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _elements(stream, tag: str):
    """Elements of one kind, each given up after use."""
    wanted, depth = f"{_MAIN}{tag}", 0
    parents: list[ElementTree.Element] = []
    for event, element in ElementTree.iterparse(stream, events=("start", "end")):
        # What lies inside a wanted element goes with it.
        if depth and element.tag != wanted:
            continue
        if event == "start":
            depth += element.tag == wanted
            parents.append(element)
            continue
        parents.pop()
        if element.tag == wanted:
            depth -= 1
            yield element
            parents[-1].remove(element)


def _text(element: ElementTree.Element) -> str:
    """All text runs, without phonetic hints."""
    runs = [t for child in element if child.tag != f"{_MAIN}rPh" for t in child.iter(f"{_MAIN}t")]
    return "".join(t.text or "" for t in runs)


def _shared(archive: zipfile.ZipFile) -> list[str]:
    name = "xl/sharedStrings.xml"
    if name not in archive.namelist():
        return []
    with archive.open(name) as stream:
        return [_text(e) for e in _elements(stream, "si")]


def _column(reference: str) -> int:
    number = 0
    for letter in reference.rstrip("0123456789"):
        number = number * 26 + ord(letter) - 64
    return number - 1


def _inline(cell: ElementTree.Element) -> str | None:
    """The text inside a cell; most have one run and nothing else."""
    if len(cell) == 1 and cell[0].tag == _INSIDE and len(cell[0]) == 1 and cell[0][0].tag == _RUN and not len(cell[0][0]):
        return cell[0][0].text
    return "".join(_text(e) for e in cell.iter(_INSIDE))


def _cells(row: ElementTree.Element, shared: list[str]) -> list[str | None]:
    out: list[str | None] = []
    for cell in row.iter(_CELL):
        kind, reference = cell.get("t", "n"), cell.get("r")
        at = _column(reference) if reference else len(out)
        if at > len(out):
            out.extend([None] * (at - len(out)))
        if kind == "inlineStr":
            text = _inline(cell)
        else:
            value = cell.find(_VALUE)
            if value is None:
                text = None
            else:
                text = shared[int(value.text)] if kind == "s" else value.text
        out.append(text or None)
    return out


class _Chained:
    """What was read of a stream, and then the rest of it."""

    def __init__(self, read: bytes, stream):
        self._read, self._stream = read, stream

    def read(self, size: int = -1) -> bytes:
        if self._read:
            out, self._read = (self._read, b"") if size < 0 else (self._read[:size], self._read[size:])
            return out
        return self._stream.read(size)


#: Kinds of tags in a piece of plain cells, with the tags that may follow each.
_ROW, _ROW_END, _ROW_ONLY, _C, _C_END, _C_ONLY, _IS, _IS_END, _T, _T_END, _V, _V_END, _OTHER = range(13)
_FOLLOWS = np.zeros((13, 13), bool)
for _kind, _next in {
    _ROW: (_C, _C_ONLY, _ROW_END), _ROW_END: (_ROW, _ROW_ONLY), _ROW_ONLY: (_ROW, _ROW_ONLY), _C: (_IS, _V, _C_END), _C_END: (_C, _C_ONLY, _ROW_END),
    _C_ONLY: (_C, _C_ONLY, _ROW_END), _IS: (_T,), _IS_END: (_C_END,), _T: (_T_END,), _T_END: (_IS_END,), _V: (_V_END,), _V_END: (_C_END,),
}.items():
    _FOLLOWS[_kind, list(_next)] = True
#: The bytes that end the name of a tag, and the kind of a tag by its first two bytes; longer names are looked at again.
_AFTER_NAME = np.zeros(256, bool)
_AFTER_NAME[list(b" >/\t\n")] = True
_BY_BYTES = np.full(1 << 16, _OTHER, np.int8)
for _name, _kind in ((b"c", _C), (b"t", _T), (b"v", _V)):
    _BY_BYTES[_name[0] + 256 * np.flatnonzero(_AFTER_NAME)] = _kind
for _name, _kind in ((b"/c", _C_END), (b"/t", _T_END), (b"/v", _V_END), (b"/i", _IS_END), (b"/r", _ROW_END), (b"is", _IS), (b"ro", _ROW)):
    _BY_BYTES[_name[0] + 256 * _name[1]] = _kind
#: Bytes between the brackets of an end tag.
_LENGTHS = np.zeros(13, np.int8)
_LENGTHS[[_C_END, _T_END, _V_END, _IS_END, _ROW_END]] = (2, 2, 2, 3, 4)
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
#: What tags that end themselves are.
_ONLY = np.full(13, _OTHER, np.int8)
_ONLY[[_ROW, _C]] = _ROW_ONLY, _C_ONLY
#: Types of cells: a text in the cell, the number of a shared one, any other.
_INLINE, _NUMBER, _VALUE_TYPE = 1, 2, 0
#: Forms of the attributes of cells that a piece may have.
_FORMS = 16


def _starts(data: np.ndarray, at: np.ndarray, text: bytes) -> np.ndarray:
    """Whether the text stands at each place."""
    found = np.ones(len(at), bool)
    for i, byte in enumerate(text):
        found &= data[at + i] == byte
    return found


def _kinds(data: np.ndarray, opened: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """The kind of each tag, by its name and by whether it ends itself."""
    kinds = _BY_BYTES[data[opened + 1] + data[opened + 2].astype(np.uint16) * np.uint16(256)]
    for kind, rest in ((_IS, b""), (_ROW, b"w"), (_IS_END, b"s"), (_ROW_END, b"ow")):
        of_kind = np.flatnonzero(kinds == kind)
        at = opened[of_kind] + 3
        good = _starts(data, at, rest)
        if kind in (_IS, _ROW):
            good &= _AFTER_NAME[data[at + len(rest)]]
        kinds[of_kind[~good]] = _OTHER
    wanted = _LENGTHS[kinds]
    kinds[(wanted > 0) & (closed - opened - 1 != wanted)] = _OTHER
    only = np.flatnonzero((data[closed - 1] == ord("/")) & (wanted == 0))
    kinds[only] = _ONLY[kinds[only]]
    return kinds


def _attributes(data: np.ndarray, piece: bytes, opened: np.ndarray, closed: np.ndarray):
    """(column or None if no cell says it, type) of cell tags; None if they take other forms than usual."""
    begins = opened + 2
    given = _starts(data, begins, b' r="')
    columns = None
    if given.any():
        if not given.all():
            return None
        columns, letters = np.zeros(len(opened), np.int64), np.ones(len(opened), bool)
        for i in range(4):
            byte = data[begins + 4 + i].astype(np.int64)
            letters &= (byte >= 65) & (byte <= 90)
            if i == 3 and letters.any():
                return None
            columns = np.where(letters, columns * 26 + byte - 64, columns)
        quotes = np.flatnonzero(data == ord('"'))
        begins = quotes[np.searchsorted(quotes, begins + 4)] + 1
        columns -= 1
    lengths = closed - begins - (data[closed - 1] == ord("/"))
    types, left, forms = np.empty(len(opened), np.int8), np.ones(len(opened), bool), 0
    while left.any():
        forms += 1
        at = int(np.argmax(left))
        form = piece[begins[at] : begins[at] + lengths[at]]
        if forms > _FORMS or not re.fullmatch(rb'(?: (?:s="[0-9]*"|t="[A-Za-z]+"))* ?', form) or form.count(b" t=") > 1 or form.count(b" s=") > 1:
            return None
        same = left & (lengths == lengths[at])
        same[same] = _starts(data, begins[same], form)
        named = re.search(rb't="([A-Za-z]+)"', form)
        types[same] = {b"inlineStr": _INLINE, b"s": _NUMBER}.get(named[1] if named else b"n", _VALUE_TYPE)
        left &= ~same
    return columns, types


def _plain(piece: bytes, shared: pa.Array) -> pa.Array | None:
    """The cells of the rows of a piece that has whole rows of plain cells and nothing else; None of any other piece."""
    if b"\r" in piece:
        piece = piece.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    coded = piece.count(b"&")
    if (coded and coded != sum(piece.count(e.encode()) for e in _ENTITIES)) or b"xmlns" in piece or b"\xef\xbf\xbe" in piece or b"\xef\xbf\xbf" in piece or b"]]>" in piece:
        return None
    # Places after the last tag may be looked at.
    data = np.frombuffer(piece + bytes(16), np.uint8)
    opened, closed = np.flatnonzero(data == ord("<")).astype(np.int32), np.flatnonzero(data == ord(">")).astype(np.int32)
    if not len(opened) or len(opened) != len(closed) or (opened >= closed).any() or (closed[:-1] >= opened[1:]).any():
        return None
    low = data[:-16][data[:-16] < 32]
    if len(low) and not np.isin(low, (9, 10)).all():
        return None
    kinds = _kinds(data, opened, closed)
    if kinds[0] not in (_ROW, _ROW_ONLY) or kinds[-1] not in (_ROW_END, _ROW_ONLY) or not _FOLLOWS.ravel()[kinds[:-1].astype(np.int16) * 13 + kinds[1:]].all():
        return None
    is_cell = (kinds == _C) | (kinds == _C_ONLY)
    is_row = (kinds == _ROW) | (kinds == _ROW_ONLY)
    cells = np.flatnonzero(is_cell)
    found = _attributes(data, piece, opened[cells], closed[cells])
    if found is None:
        return None
    columns, types = found
    # The texts of cells, one after the other; of cells without any, nothing.
    texts = np.flatnonzero((kinds == _T) | (kinds == _V))
    owner = np.searchsorted(cells, texts) - 1
    inline = types[owner] == _INLINE
    if (inline != (kinds[texts] == _T)).any():
        return None
    # Texts and what stands between them, by turns, as they lie in the piece.
    bounds = np.empty(2 * len(texts) + 1, np.int32)
    bounds[:-1:2], bounds[1::2], bounds[-1] = closed[texts] + 1, opened[texts + 1], len(piece)
    parts = pa.StringArray.from_buffers(2 * len(texts), pa.py_buffer(bounds), pa.py_buffer(piece))
    part_of = np.full(len(cells), -1, np.int64)
    part_of[owner] = 2 * np.arange(len(texts))
    values = parts.take(pa.array(part_of, mask=part_of < 0))
    try:
        values.validate(full=True)
        if coded:
            for entity, char in _ENTITIES.items():
                values = pc.replace_substring(values, entity, char)
        by_number = types == _NUMBER
        if by_number.any():
            at = pc.if_else(pa.array(by_number), values, pa.scalar(None, pa.string())).cast(pa.int32())
            values = pc.if_else(pa.array(by_number), shared.take(at), values)
    except (pa.ArrowInvalid, pa.ArrowIndexError, IndexError):
        return None
    values = pc.if_else(pc.equal(values, ""), pa.scalar(None, pa.string()), values)
    row_of = np.cumsum(is_row)[cells] - 1
    rows = int(is_row.sum())
    count = np.bincount(row_of, minlength=rows)
    before = np.cumsum(count) - count
    place = np.arange(len(cells)) - before[row_of]
    if columns is not None and (columns != place).any():
        step = np.diff(columns)
        if (columns < place).any() or (step[np.diff(row_of) == 0] < 1).any():
            return None
        width = np.zeros(rows, np.int64)
        np.maximum.at(width, row_of, columns + 1)
        total = int(width.sum())
        at = np.full(total, -1)
        at[(np.cumsum(width) - width)[row_of] + columns] = np.arange(len(cells))
        values, count = values.take(pa.array(at, mask=at < 0)), width
    bounds = np.zeros(rows + 1, np.int32)
    np.cumsum(count, out=bounds[1:])
    filled = np.concatenate([[0], np.cumsum(np.asarray(pc.is_valid(values)))])
    out = pa.ListArray.from_arrays(pa.array(bounds), values)
    kept = filled[bounds[1:]] > filled[bounds[:-1]]
    return out if kept.all() else out.filter(pa.array(kept))


def _cell_rows(archive: zipfile.ZipFile, entry: str, shared: list[str]):
    """Lists of the cells of filled rows, some rows at a time."""
    with archive.open(entry) as stream:
        head, rest = b"", stream.read(PIECE)
        begins = re.search(rb"<sheetData(?: [^<>]*[^<>/])?>", rest)
        if begins and re.match(rb"(?:\xef\xbb\xbf)?\s*(?:<\?xml[^<>]*\?>)?\s*<worksheet(?:\s[^<>]*)?>", rest) and _XMLNS in rest[: rest.index(b">", rest.index(b"<worksheet"))]:
            prolog = re.match(rb"[^<]*<\?xml[^<>]*", rest)
            named = re.search(rb"encoding=[\"']([^\"']*)", prolog[0]) if prolog else None
            if (not named or named[1].lower() == b"utf-8") and b"<!" not in rest[: begins.end()]:
                head, rest = rest[: begins.end()], rest[begins.end() :]
                texts = pa.array(shared, pa.string())
                while True:
                    end = rest.rfind(b"</row>") + 6
                    if end > 6:
                        cells = _plain(rest[:end], texts)
                        if cells is None:
                            break
                        rest = rest[end:]
                        for at in range(0, len(cells), BATCH_ROWS):
                            yield cells.slice(at, BATCH_ROWS)
                    more = stream.read(max(PIECE, len(rest)))
                    if not more:
                        break
                    rest += more
        waiting: list[list] = []
        problem = None
        try:
            for row in _elements(_Chained(head + rest, stream), "row"):
                cells = _cells(row, shared)
                if any(cells):
                    waiting.append(cells)
                if len(waiting) == WAITING_ROWS:
                    yield pa.array(waiting, _TEXTS)
                    waiting = []
        except _UNREADABLE as error:
            problem = error
        # What could be read comes before what is wrong.
        if waiting:
            yield pa.array(waiting, _TEXTS)
        if problem:
            raise problem


#: Errors of sheets that can't be read.
_UNREADABLE = (zipfile.BadZipFile, KeyError, IndexError, ValueError, ElementTree.ParseError, EOFError)


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, strict: bool, blocks: bool):
        self._path, self._strict, self._blocks = path, strict, blocks

    def partitions(self):
        system, path = place(self._path)
        if system.get_file_info(path).type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(path, recursive=True))
            files = sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".xlsx") and not f.base_name.startswith(("_", ".", "~")))
        else:
            files = [path]
        return [sheet for file in files for sheet in self._planned(system, file)]

    def _planned(self, system, file: str) -> list[Sheet]:
        try:
            with system.open_input_file(file) as stream, zipfile.ZipFile(stream) as archive:
                return [Sheet(file, name, entry) for name, entry in _sheets(archive)]
        except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as error:
            if self._strict:
                raise ValueError(f"{file} is no workbook: {error}") from error
            return [Sheet(file, None, None, f"no workbook: {type(error).__name__}")]

    def read(self, partition: Sheet):
        folder, file = ["", *partition.path.split("/")][-2:]
        same = (folder, file, partition.section)

        def told(problem: str, number: int | None = None, header: pa.Scalar | None = None):
            schema = _ARROW_BLOCKS if self._blocks else _ARROW
            values = (*same, number, header and header.as_py(), None, problem)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)

        if partition.problem:
            yield told(partition.problem)
            return
        system, _ = place(self._path)
        header, number = None, 0
        try:
            with system.open_input_file(partition.path) as stream, zipfile.ZipFile(stream) as archive:
                for cells in _cell_rows(archive, partition.entry, _shared(archive)):
                    header = cells[0] if header is None else header
                    yield self._batch(same, number, header, cells)
                    number += len(cells)
        except _UNREADABLE as error:
            if self._strict:
                raise
            yield told(f"unreadable from here: {type(error).__name__}", number, header)

    def _batch(self, same: tuple, number: int, header: pa.Scalar, cells: pa.ListArray) -> pa.RecordBatch:
        """Rows of one sheet; folder, file, sheet and header are the same for all."""
        n = len(cells)
        numbers = pa.array(np.arange(number, number + n))
        if self._blocks:
            bounds = [*range(0, n, BLOCK_ROWS), n]
            cells, numbers, n = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), cells), numbers.take(pa.array(bounds[:-1])), len(bounds) - 1
        first = pa.array(np.zeros(n, np.int64))
        names = [pa.array([v], pa.string()).take(first) for v in same]
        heads = pa.array([header.as_py()], _TEXTS).take(first)
        return pa.RecordBatch.from_arrays([*names, numbers, heads, cells, pa.nulls(n, pa.string())], schema=_ARROW_BLOCKS if self._blocks else _ARROW)


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


_BOOK = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>%s</sheets></workbook>'
)
_LINKS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">%s</Relationships>'
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>%s</Types>'
)
_SHEET_TYPE = '<Override PartName="/%s" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'


#: Cells by whether they have text, and text whose blanks at the ends count.
_OPEN = ("<c/>", '<c t="inlineStr"><is><t>', '<c t="inlineStr"><is><t xml:space="preserve">')
_CLOSE = ("", "</t></is></c>", "</row>", "</t></is></c></row>")


def _markup(cells: pa.ListArray) -> pa.Buffer | bytes:
    """The rows of a sheet in its XML. Cells follow each other, so that none has to name its place."""
    values = cells.flatten()
    if not len(values):
        return b"<row/>" * len(cells)
    filled = np.asarray(pc.fill_null(pc.not_equal(values, ""), False))
    if pc.any(pc.match_substring_regex(values, _SPECIAL)).as_py():
        values = pc.replace_substring_regex(values, _BARRED, "")
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            values = pc.replace_substring(values, char, entity)
    count = np.asarray(pc.fill_null(pc.list_value_length(cells), 0)).astype(np.int64)
    row_of, begins = np.repeat(np.arange(len(cells)), count), np.cumsum(count) - count
    # Of a row, what stands up to its last filled cell.
    ends = np.zeros(len(cells), np.int64)
    np.maximum.at(ends, row_of[filled], np.flatnonzero(filled) + 1)
    kept = np.flatnonzero(np.arange(len(row_of)) < ends[row_of])
    if not len(kept):
        return b"<row/>" * len(cells)
    values, filled, row_of = pc.fill_null(values, "").take(pa.array(kept)), filled[kept], row_of[kept]
    first, last = np.append(True, row_of[1:] != row_of[:-1]), np.append(row_of[1:] != row_of[:-1], True)
    # Rows without text before a row, and after the last one.
    gaps = np.diff(row_of[first], prepend=-1) - 1
    blanks = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    bounds = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    long = bounds[1:] > bounds[:-1]
    spaced = np.zeros(len(values), bool)
    spaced[long] = (blanks[bounds[:-1][long]] <= 32) | (blanks[bounds[1:][long] - 1] <= 32)
    opens = filled.astype(np.int64) + (filled & spaced)
    steps, step_of = np.unique(gaps, return_inverse=True)
    opens[first] += 3 * (1 + step_of)
    table = [*_OPEN, *["<row/>" * int(g) + "<row>" + o for g in steps for o in _OPEN]]
    whole = pc.binary_join_element_wise(
        pa.array(table).take(pa.array(opens)), values, pa.array(_CLOSE).take(pa.array(filled.astype(np.int64) + 2 * last)), "",
    )
    offsets = np.frombuffer(whole.buffers()[1], np.int32)
    made = whole.buffers()[2].slice(int(offsets[whole.offset]), int(offsets[whole.offset + len(whole)] - offsets[whole.offset]))
    after = len(cells) - 1 - int(row_of[-1])
    return made.to_pybytes() + b"<row/>" * after if after else made


class _Book:
    """A workbook that is written run by run, with texts inside their cells."""

    def __init__(self, stream):
        self._stream, self._zip = stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
        self._names: list[str] = []
        self._sheet = self._section = self._header = None
        self._n = 0

    def add(self, section: str, header: pa.ListArray, cells: pa.ListArray) -> None:
        """Rows of one section, and its header, which counts where the section begins."""
        while len(cells):
            if section != self._section or self._n == SHEET_ROWS:
                self._begin(section, header if section != self._section else self._header)
            room = min(SHEET_ROWS - self._n, max(1, WRITTEN_BYTES * len(cells) // (cells.nbytes + 1)))
            self._rows(cells.slice(0, room))
            cells = cells.slice(room)

    def _begin(self, section: str, header: pa.ListArray) -> None:
        self._end()
        name, taken = section[:31], set(self._names)
        while name in taken:
            tail = f" {len(self._names) + 1}"
            name = section[: 31 - len(tail)] + tail
        self._names.append(name)
        self._section, self._header, self._n = section, header, 0
        self._sheet = self._zip.open(f"xl/worksheets/sheet{len(self._names)}.xml", "w", force_zip64=True)
        self._sheet.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
        if header[0].as_py():
            self._rows(header)

    def _rows(self, cells: pa.ListArray) -> None:
        self._n += len(cells)
        self._sheet.write(memoryview(_markup(cells)))

    def _end(self) -> None:
        if self._sheet:
            self._sheet.write(b"</sheetData></worksheet>")
            self._sheet.close()

    def close(self) -> None:
        self._end()
        numbered = list(enumerate(self._names, 1))
        sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in numbered)
        links = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in numbered)
        self._zip.writestr("xl/workbook.xml", _BOOK % sheets)
        self._zip.writestr("xl/_rels/workbook.xml.rels", _LINKS % links)
        self._zip.writestr("_rels/.rels", _LINKS % f'<Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/>')
        self._zip.writestr("[Content_Types].xml", _TYPES % "".join(_SHEET_TYPE % f"xl/worksheets/sheet{i}.xml" for i, _ in numbered))
        self._zip.close()
        self._stream.close()


class WorkbookWriter(DataSourceArrowWriter):
    """Rows (src_group, src_file, section, header, cells) to folder/file.xlsx; a file's rows come from one task, in order.

    Files get their names when all tasks are done; those of lost or repeated tasks
    stay under hidden names and go when the write ends.
    """

    def __init__(self, path: str):
        self._path = path
        self._hidden = f".write-{uuid.uuid4().hex}"

    def write(self, batches):
        system, path = place(self._path)
        system.create_dir(f"{path}/{self._hidden}", recursive=True)
        moves, taken, book, current = [], set(), None, None
        for batch in batches:
            # Runs of rows of one section of one file.
            coded = [batch.column(c).dictionary_encode(null_encoding="encode") for c in ("src_group", "src_file", "section")]
            codes = np.stack([np.asarray(c.indices) for c in coded])
            starts = np.flatnonzero((np.diff(codes, axis=1, prepend=-1) != 0).any(axis=0)).tolist()
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                group, file, section = (batch.column(c)[start].as_py() for c in ("src_group", "src_file", "section"))
                target = f"{path}/{group}/{file}"
                if target != current:
                    if book:
                        book.close()
                    if target in taken:
                        raise ValueError(f"rows of {target} are not together: partition by folder and file, and sort by them")
                    hidden = f"{path}/{self._hidden}/{uuid.uuid4().hex}"
                    book, current = _Book(system.open_output_stream(hidden)), target
                    moves.append((hidden, target))
                    taken.add(target)
                book.add(section, batch.column("header").slice(start, 1), batch.column("cells").slice(start, end - start))
        if book:
            book.close()
        return Written(moves)

    def commit(self, messages):
        system, path = place(self._path)
        moves = [m for message in messages if message for m in message.moves]
        if len({target for _, target in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("a file was written by several tasks: partition by folder and file")
        for hidden, target in moves:
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            system.move(hidden, target)
        self._drop(system, path)

    def abort(self, messages):
        self._drop(*place(self._path))

    def _drop(self, system, path):
        if system.get_file_info(f"{path}/{self._hidden}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self._hidden}")


class Workbook(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return BLOCKS if self._in_blocks() else SCHEMA

    def _in_blocks(self) -> bool:
        return self.options.get("blocks", "false").lower() == "true"

    def _place(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("a workbook source needs a path")
        place(path)
        return path

    def reader(self, schema):
        mode = self.options.get("mode", "permissive").lower()
        if mode not in ("permissive", "failfast"):
            raise ValueError("mode is permissive or failfast")
        return WorkbookReader(self._place(), mode == "failfast", self._in_blocks())

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("workbooks are appended to a folder; name another one instead of overwriting")
        return WorkbookWriter(self._place())


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("workbook")`` and ``df.write.format("workbook")`` known.

    The classes travel with the plan, so executors need not have this package.
    """
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Workbook)
