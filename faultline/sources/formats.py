"""Workbooks and Word reports as formats of spark.read and df.write, read and written by groups of files on all executors.

    formats.register(spark)
    spark.read.format("workbook_cells").load("hdfs://host/books")      # workbook.CELLS
    spark.read.format("report_parts").load("file:///data/reports")     # documents.PARTS
    formats.write_workbooks(cells, path); formats.write_reports(parts, path)

Paths are URIs that pyarrow.fs opens (file, hdfs, s3, gs), or absolute paths. Streams of files are read by `stream_cells` and
`stream_parts`: Spark's own file stream keeps the log of the files it has seen.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby
from operator import itemgetter
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import documents, workbook

#: Files of one task hold at least the first many zipped bytes together (some ten to twenty times that as XML) and at most the second, so that there
#: are about TASKS tasks in between; the option `groupBytes` says otherwise. A file is never parted.
GROUP_BYTES = (1 << 20, 64 << 20)
TASKS = 10_000
BATCH_ROWS = 4096
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[kind]) for n, kind in (c.split() for c in ddl.split(", "))])


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class _Reader(DataSourceReader):
    """One row for each cell or paragraph; a file that can't be read is one row with `error`, and the others go on."""

    def __init__(self, source: _FileSource):
        self.source, self.path = source, source.options["path"]
        self.group = source.options.get("groupBytes")

    def partitions(self) -> list[Files]:
        system, root = fs.FileSystem.from_uri(self.path)
        at = system.get_file_info(root)
        if at.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if at.type == fs.FileType.Directory else [at]
        below = lambda f: f.path[len(root) :].lstrip("/") or f.base_name
        found = sorted((f for f in found if f.type == fs.FileType.File and self.source.wanted(below(f))), key=lambda f: f.path)
        group = int(self.group) if self.group else min(max(sum(f.size for f in found) // TASKS, GROUP_BYTES[0]), GROUP_BYTES[1])
        groups, size = [[]], 0
        for f in found:
            if groups[-1] and size + f.size > group:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        schema = _arrow(self.source.DDL)
        for path in partition.paths:
            columns, error = [], None
            try:
                with system.open_input_stream(path) as f:
                    content = f.read()
                # A file is read to its end before its rows go on: one that breaks later gives its error alone.
                columns = [pa.array(c, t) for c, t in zip(self.source.columns(content), schema.types[2:])]
            except Exception as e:  # noqa: BLE001  whatever is wrong with one file, the others are read
                error = f"{type(e).__name__}: {e}"
            file = self.source.file_name(path)
            if error is not None:
                yield pa.RecordBatch.from_pylist([{"path": path, schema.names[1]: file, "error": error}], schema)
            for i in range(0, len(columns[0]) if columns else 0, BATCH_ROWS):
                part = [c.slice(i, BATCH_ROWS) for c in columns]
                n = len(part[0])
                yield pa.RecordBatch.from_arrays([pa.repeat(path, n), pa.repeat(file, n), *part, pa.nulls(n, schema.types[-1])], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    """Files beside each other in a folder of this write's own; the commit moves those of the tasks that succeeded to their place.

    A file's rows stand together in one task, in their order (`write_workbooks` and `write_reports` see to it). Lost or doubled attempts leave
    nothing behind but names in that folder, which goes with commit or abort. An overwrite replaces files of the same name alone.
    """

    def __init__(self, source: _FileSource):
        self.source, self.path = source, source.options["path"]
        self.work = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.path)
        attempt = uuid.uuid4().hex
        system.create_dir(f"{root}/{self.work}/{attempt}", recursive=True)
        names = []
        for name, content in self.source.built(iterator):
            with system.open_output_stream(f"{root}/{self.work}/{attempt}/{name}") as f:
                f.write(content)
            names.append(f"{attempt}/{name}")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        names = [n for m in messages if m is not None for n in m.names]
        if len({n.split("/", 1)[1] for n in names}) < len(names):
            self.abort(messages)
            raise ValueError("the rows of a file were written by more than one task")
        for n in names:
            system.move(f"{root}/{self.work}/{n}", f"{root}/{n.split('/', 1)[1]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(f"{root}/{self.work}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.work}")


class _FileSource(DataSource):
    DDL = ""

    def schema(self) -> str:
        return self.DDL

    def reader(self, schema) -> _Reader:
        return _Reader(self)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self)

    @staticmethod
    def wanted(path: str) -> bool:
        raise NotImplementedError

    @staticmethod
    def file_name(path: str) -> str:
        raise NotImplementedError

    @staticmethod
    def parse(content: bytes) -> Iterable[tuple]:
        raise NotImplementedError

    @classmethod
    def columns(cls, content: bytes) -> list[list]:
        """parse() by columns; none, if there are no rows."""
        return [list(c) for c in zip(*cls.parse(content))]

    @staticmethod
    def build(rows: Iterator[tuple]) -> bytes:
        """A file of its rows, tuples of the columns of DDL."""
        raise NotImplementedError

    @classmethod
    def built(cls, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        """(name, content) of each file of batches in the columns of DDL."""
        # Tuples in the order of DDL: a dictionary a row would cost as much as its XML.
        rows = (r for b in batches for r in zip(*map(_listed, b.columns)))
        for name, own in groupby(rows, key=itemgetter(0)):
            yield name, cls.build(own)


def _listed(column: pa.Array) -> list:
    """column.to_pylist(), by way of numpy, which is several times faster, where it gives the same values."""
    if column.null_count == len(column):
        return [None] * len(column)
    if column.null_count and pa.types.is_integer(column.type):  # numpy would make them floats
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def _hidden(path: str) -> bool:
    return any(p.startswith((".", "_", "~$")) for p in path.split("/"))


@cache
def _column(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


_ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "\r": "&#13;"}
_TABLE = str.maketrans(_ESCAPES)


def _xml(text: str) -> str:
    """Text for XML; a carriage return would be read as a line feed. Other control characters can't be written at all."""
    return text.translate(_TABLE)


def _numbers(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("a cell without a place")
    return column.to_numpy(zero_copy_only=False)


_CLOSED = "</row>"


def _cell_xml(row: np.ndarray, col: np.ndarray, value: pa.Array, is_number: pa.Array, opens: np.ndarray) -> pa.Array:
    """The XML of each cell of a batch, behind the end of the row before it and the beginning of its own where it opens one."""
    large = pa.large_string()
    one = lambda x: pa.scalar(x, large)
    text, held = value.cast(large), bytes(value.buffers()[2] or b"")
    for sign, escaped in _ESCAPES.items():  # the ampersand first
        if sign.encode() in held:
            text = pc.replace_substring(text, sign, escaped)
    number, n = is_number.fill_null(False), pa.array(row).cast(large)
    kinds, at = np.unique(col, return_inverse=True)
    letters = pa.array([_column(int(k)) for k in kinds], large).take(pa.array(at))
    head = pc.if_else(pa.array(opens), pc.binary_join_element_wise(one(f'{_CLOSED}<row r="'), n, one('"><c r="'), one("")), one('<c r="'))
    begin = pc.if_else(number, one('"><v>'), one('" t="inlineStr"><is><t xml:space="preserve">'))
    end = pc.if_else(number, one("</v></c>"), one("</t></is></c>"))
    return pc.binary_join_element_wise(head, letters, n, begin, text, end, one(""))


class WorkbookCells(_FileSource):
    """workbook.CELLS of .xlsx and .xlsm files. Written are path (the file's name), sheet, sheet_index, row, col, value and is_number."""

    DDL = workbook.CELLS

    @classmethod
    def name(cls) -> str:
        return "workbook_cells"

    @staticmethod
    def wanted(path: str) -> bool:
        return path.lower().endswith((".xlsx", ".xlsm")) and not _hidden(path)

    @staticmethod
    def file_name(path: str) -> str:
        return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]

    parse = staticmethod(workbook.parse)
    columns = staticmethod(workbook.columns)

    @classmethod
    def build(cls, rows: Iterator[tuple]) -> bytes:
        schema = _arrow(cls.DDL)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), schema.types)], schema=schema)
        return next(cls.built([batch]))[1]

    @classmethod
    def built(cls, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        """The cells of a batch become XML at once, whose bytes then stand behind each other in its array: a sheet is cut out of them."""
        name, sheets, last = None, {}, None
        for b in batches:
            if not len(b):
                continue
            path, sheet, index = b.column(0), b.column(2), _numbers(b.column(3))
            row = _numbers(b.column(4))
            turned = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
            files = np.concatenate([[True], pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False)])
            parts = files | turned(index)
            rows = parts | turned(row)
            # A row may go on in the next batch.
            rows[0] = (path[0].as_py(), index[0], row[0]) != last
            last = (path[-1].as_py(), index[-1], row[-1])
            xml = _cell_xml(row + 1, _numbers(b.column(5)), b.column(6), b.column(7), rows)
            ends, data = np.frombuffer(xml.buffers()[1], np.int64)[xml.offset :][: len(xml) + 1], memoryview(xml.buffers()[2])
            starts = np.flatnonzero(parts)
            for at, end in zip(starts, [*starts[1:], len(b)]):
                if (own := path[at].as_py()) != name:
                    if name is not None:
                        yield name, cls._book(sheets)
                    name, sheets = own, {}
                sheets.setdefault(int(index[at]), (sheet[at].as_py(), []))[1].append(bytes(data[ends[at] : ends[end]]))
        if name is not None:
            yield name, cls._book(sheets)

    @staticmethod
    def _book(sheets: dict[int, tuple[str, list[bytes]]]) -> bytes:
        # A sheet's place is its index: those before it that have no cells are written, too.
        every = [sheets.get(i, (f"Sheet{i + 1}", [])) for i in range(max(sheets) + 1)]
        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            sheet_types = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(len(every)))
            z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{sheet_types}</Types>')
            z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r0" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(every))) + "</Relationships>")
            z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i + 1}" r:id="r{i}"/>' for i, (n, _) in enumerate(every)) + "</sheets></workbook>")
            for i, (_, parts) in enumerate(every):
                # Each row closes the one before it, but the first.
                rows = b"".join(parts)[len(_CLOSED) :] + _CLOSED.encode() if parts else b""
                z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet {main}><sheetData>".encode() + rows + b"</sheetData></worksheet>")
        return out.getvalue()


class ReportParts(_FileSource):
    """documents.PARTS of .docx files. Written are path (the file's name), kind, ord, style, text and second; each row of a table is a table."""

    DDL = documents.PARTS

    @classmethod
    def name(cls) -> str:
        return "report_parts"

    @staticmethod
    def wanted(path: str) -> bool:
        return path.lower().endswith(".docx") and not _hidden(path)

    @staticmethod
    def file_name(path: str) -> str:
        return path.rsplit("/", 1)[-1]

    parse = staticmethod(documents.parse)

    @staticmethod
    def build(rows: Iterator[tuple]) -> bytes:
        def run(text: str | None) -> str:
            lines = (text or "").split("\n")
            tabs = lambda line: "<w:tab/>".join(f'<w:t xml:space="preserve">{_xml(t)}</w:t>' for t in line.split("\t"))
            return "<w:r>" + "<w:br/>".join(map(tabs, lines)) + "</w:r>"

        body, styles = [], {}
        for _, _, kind_of, _, named, text, second, _ in rows:
            if kind_of == "row":
                cells = [c for c in (text, second) if c is not None]
                body.append("<w:tbl><w:tr>" + "".join(f"<w:tc><w:p>{run(c)}</w:p></w:tc>" for c in cells) + "</w:tr></w:tbl>")
            else:
                style = styles.setdefault(named or "Normal", f"S{len(styles)}")
                body.append(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{run(text)}</w:p>')
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{kind}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{kind}.styles+xml"/></Types>')
            z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r0" Type="{rel}/officeDocument" Target="word/document.xml"/></Relationships>')
            z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
            z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(body)}</w:body></w:document>")
            z.writestr("word/styles.xml", f"<w:styles {w}>" + "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val={quoteattr(n)}/></w:style>' for n, i in styles.items()) + "</w:styles>")
        return out.getvalue()


def register(spark: SparkSession) -> None:
    """The two formats in this session."""
    for source in (WorkbookCells, ReportParts):
        spark.dataSource.register(source)


def _write(rows: DataFrame, source: type[_FileSource], path: str, order: list[str], in_order: bool = False) -> None:
    register(rows.sparkSession)
    columns = {c.split()[0]: c.split()[1] for c in source.DDL.split(", ")}
    whole = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])
    placed = whole if in_order else whole.repartition("path").sortWithinPartitions("path", *order)
    placed.write.format(source.name()).mode("append").save(path)


def write_workbooks(cells: DataFrame, path: str, in_order: bool = False) -> None:
    """A workbook for each `path` (a file name) of the cells; one file's cells meet in one task, as a file must. Null values are no cells.

    in_order: the cells stand so already, by path, sheet_index, row and col, so they are not shuffled. A file that two tasks write is an error.
    """
    _write(cells.where("value IS NOT NULL AND path IS NOT NULL"), WorkbookCells, path, ["sheet_index", "row", "col"], in_order)


def write_reports(parts: DataFrame, path: str) -> None:
    """A report for each `path` (a file name) of the parts, in the order of `ord`."""
    _write(parts.where("path IS NOT NULL"), ReportParts, path, ["ord"])


def _stream(spark: SparkSession, path: str, per_batch: int) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return files.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)


def stream_cells(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """workbook.CELLS of the workbooks that arrive in a folder, each file once."""
    return workbook.cells(workbook.only_workbooks(_stream(spark, path, per_batch)))


def stream_parts(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """documents.PARTS of the reports that arrive in a folder, each file once."""
    return documents.parts(documents.only_reports(_stream(spark, path, per_batch)))
