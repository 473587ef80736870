"""Excel workbooks (.xlsx, .xlsm) as DataFrames of cells, read from their zipped XML; and the two FMEA layouts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ingest import last_before
from .files import shared_folder

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_CELL, _VALUE, _IS, _T = (f"{_MAIN}{name}" for name in ("c", "v", "is", "t"))
CELLS = "path string, file_name string, sheet string, sheet_index int, row int, col int, value string, is_number boolean, error string"

# Headers of the new layout (its seventh row) and those of the old one, with the columns to fall back to.
NEW_HEADERS = {
    "Potential Effect(s) of Failure\n(Activity)": "failure_effect",
    "Severity": "severity",
    "Potential Failure Mode\n(Process step)": "failure_mode",
    "Potential Cause(s) of Failure\n(per discipline)": "failure_cause",
    "Controls prevention": "controls_prevention",
    "Occurrence": "occurrence",
    "Current Detection": "current_detection",
    "Detection": "detection",
    "RPN": "rpn",
    "Recommended Actions": "recommended_action",
}
NEW_HEADER_ROW = 6
OLD_HEADERS = {
    "failure_type": (("process step",), 1),
    "failure_mode": (("potential failure mode",), 2),
    "failure_effect": (("potential effect(s) of failure",), 3),
    "severity": (("severity",), 4),
    "failure_cause": (("potential cause(s) of failure",), 5),
    "occurrence": (("occurrence",), 6),
    "current_detection": (("current controls",), 8),
    "detection": (("detection",), 9),
    "rpn": (("rpn", "so"), 10),
    "recommended_action": (("recommended actions", "recommended action"), 11),
}
OLD_NUMBERS = ("severity", "occurrence", "detection", "rpn")


def cell_address(a1: str) -> tuple[int, int]:
    """Row and column, from 0, of an address like J4."""
    m = re.fullmatch(r"([A-Z]+)(\d+)", a1.strip().upper())
    if not m:
        raise ValueError(f"not a cell address: {a1!r}")
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _inline(c) -> str:
    """_text of a cell, which mostly holds one text alone."""
    if len(c) == 1 and len(c[0]) == 1 and c[0].tag == _IS and c[0][0].tag == _T and not len(c[0][0]):
        return c[0][0].text or ""
    return _text(c)


def _number(raw: str) -> str:
    x = float(raw)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _typed(kind: str, style: str, raw: str, shared: list[str], dates: set[int]) -> tuple[str, bool]:
    """(value, is_number) of the content of a cell's <v>."""
    if kind == "s":
        return shared[int(raw)], False
    if kind == "n":
        if int(style) in dates:
            return (datetime(1899, 12, 30) + timedelta(days=float(raw))).strftime("%Y-%m-%d"), False
        return _number(raw), True
    return raw, False


#: Cells as spreadsheets mostly write them: a value or one text, in attributes of this order; and cells without any.
_PLAIN = re.compile(r'<c r="([A-Z]+)([0-9]+)"(?: s="([0-9]+)")?(?: t="inlineStr"><is><t(?: xml:space="preserve")?>([^<]*)</t></is>|(?: t="(n|s|str|b|e|d)")?><v>([^<]+)</v>)</c>')
_BLANK = re.compile(r'<c r="[A-Z]+[0-9]+"(?: s="[0-9]+")?/>')
_ROOT = re.compile(r'\s*(?:<\?xml [^>]*\?>\s*)?<worksheet\b([^>]*)>')
_REFERENCE = re.compile(r"&(#x[0-9A-Fa-f]+|#[0-9]+|[a-z]+);")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def _sign(m: re.Match) -> str:
    return _NAMED[m[1]] if m[1][0] != "#" else chr(int(m[1][2:], 16) if m[1][1] == "x" else int(m[1][1:]))


def _unescaped(text: str) -> str:
    return _REFERENCE.sub(_sign, text) if "&" in text else text


def _plain_cells(content: bytes) -> list[tuple[str, ...]] | None:
    """(letters, digits, style, text, kind, raw) of a sheet's cells by one expression; None where it can't be sure to see what a parser of XML does.

    The sheet is well-formed, has no comments, sections or instructions, its elements have no prefix, and each <c> is a plain cell.
    """
    if b"<!" in content or content.count(b"<?") > content.startswith((b"<?xml ", b"\xef\xbb\xbf<?xml ")):
        return None
    try:
        text = content.decode("utf-8-sig")
        root = _ROOT.match(text)
        if root is None or "&" in root[1] or f' xmlns="{_MAIN[1:-1]}"' not in root[1] or text.count(_MAIN[1:-1]) != 1 or text.count("xmlns") != root[1].count("xmlns"):
            return None
        if "encoding" in text[: root.start(1)] and not re.search(r"""encoding=["']utf-8["']""", text[: root.start(1)], re.I):
            return None
        expat.ParserCreate().Parse(content, True)
    except (UnicodeDecodeError, expat.ExpatError):
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    found = _PLAIN.findall(text)
    # Mostly no other element's name begins like a cell's.
    if text.count("<c") != len(found) and sum(text.count(f"<c{end}") for end in " >/\t\n") != len(found) + len(_BLANK.findall(text)):
        return None
    return [(*c[:3], _unescaped(c[3]), c[4], _unescaped(c[5])) for c in found] if "&" in text else found


def _tree_cells(content: bytes, shared: list[str], dates: set[int]) -> Iterator[tuple[str, str, str, bool]]:
    """(address, its letters, value, is_number) of each cell of a sheet with a value."""
    for c in ElementTree.fromstring(content).iter(_CELL):
        kind = c.get("t", "n")
        number = False
        if kind == "inlineStr":
            value = _inline(c)
        elif (v := c.find(_VALUE)) is None or v.text is None:
            continue
        else:
            value, number = _typed(kind, c.get("s", "0"), v.text, shared, dates)
        at = c.get("r")
        yield at, at.rstrip("0123456789"), value, number


def _sheets(content: bytes) -> Iterator[tuple[str, int, list, list, list, list]]:
    """(sheet, sheet_index, rows, cols, values, are_numbers) of each sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        read = lambda name: ElementTree.fromstring(z.read(name))
        # Columns by their letters: an address is matched as a whole only where its letters are new.
        columns: dict[str, int] = {}
        shared = [_text(si) for si in read("xl/sharedStrings.xml").findall(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = read("xl/styles.xml")
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
            formats = styles.find(f"{_MAIN}cellXfs")
            for i, xf in enumerate(formats if formats is not None else ()):
                n = int(xf.get("numFmtId", 0))
                if 14 <= n <= 22 or 45 <= n <= 47 or re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")), re.I):
                    dates.add(i)
        targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        for index, sheet in enumerate(read("xl/workbook.xml").iter(f"{_MAIN}sheet")):
            target, name = targets[sheet.get(f"{_REL}id")], sheet.get("name")
            xml = z.read(target[1:] if target.startswith("/") else f"xl/{target}")
            if (plain := _plain_cells(xml)) is not None:
                letters, digits, styled, said, kinds, raws = zip(*plain) if plain else [()] * 6
                for col, n in zip(letters, digits):
                    if col not in columns:
                        columns[col] = cell_address(col + n)[1]
                typed = {k: _typed(k[0] or "n", k[1] or "0", k[2], shared, dates) if k[2] else None for k in set(zip(kinds, styled, raws))}
                values = [typed[k] or (t, False) for k, t in zip(zip(kinds, styled, raws), said)]
                yield name, index, [int(n) - 1 for n in digits], [columns[c] for c in letters], [v for v, _ in values], [n for _, n in values]
                continue
            rows, cols, values, numbers = [], [], [], []
            for at, letters, value, number in _tree_cells(xml, shared, dates):
                if (col := columns.get(letters)) is not None and len(letters) < len(at):
                    row = int(at[len(letters) :]) - 1
                else:
                    row, col = cell_address(at)
                    if letters.isascii() and letters.isalpha():
                        columns[letters] = col
                for column, x in zip((rows, cols, values, numbers), (row, col, value, number)):
                    column.append(x)
            yield name, index, rows, cols, values, numbers


def columns(content: bytes) -> list[list]:
    """(sheet, sheet_index, row, col, value, is_number) of each cell with a value, as columns; dates as yyyy-MM-dd."""
    out = [[], [], [], [], [], []]
    for name, index, *cells_ in _sheets(content):
        for column, more in zip(out, ([name] * len(cells_[0]), [index] * len(cells_[0]), *cells_)):
            column.extend(more)
    return out


def parse(content: bytes) -> Iterator[tuple[str, int, int, int, str, bool]]:
    """The same as rows."""
    return zip(*columns(content))


def cells(files: DataFrame) -> DataFrame:
    """CELLS of binaryFile rows (path, content). A file that can't be read is one row with `error`; others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CELLS.split(", ")]
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                file = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    rows = [(path, file, *cell, None) for cell in parse(bytes(content))]
                except Exception as e:  # noqa: BLE001  whatever is wrong with one file, the others are read
                    rows = [(path, file, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({c: "Int32" for c in ("sheet_index", "row", "col")})

    return files.select("path", "content").mapInPandas(run, CELLS)


def only_workbooks(files: DataFrame) -> DataFrame:
    """The .xlsx and .xlsm files without the lock files beside open ones."""
    return files.where(F.lower("path").rlike(r"\.(xlsx|xlsm)$") & ~F.col("path").rlike(r"/~\$[^/]*$"))


def read_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Cells of all .xlsx and .xlsm files under a folder, or of these files (other extensions are skipped)."""
    return cells(only_workbooks(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)))


#: Rows that are looked at for headers, names and cells of the project.
TOP = 20


def _top(sheet: DataFrame) -> DataFrame:
    """(file_name, row, at) of the first rows of each file of a sheet: `at` are its (col, value) by column. One file's rows are in one task."""
    top = sheet.where(F.col("row") < TOP).select("file_name", "row", "col", "value").repartition("file_name")
    return top.groupBy("file_name", "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("at"))


def _at(col: int) -> Column:
    return F.get(F.filter("at", lambda a: a["col"] == col), F.lit(0))["value"]


def _project(description: str, *date: str) -> list[Column]:
    """project_description and fmea_date of a file by the addresses of their cells (of the date: of the first that has one), Unknown where they are empty: aggregates over _top."""

    def given(address: str) -> Column:
        row, col = cell_address(address)
        return F.max(F.when(F.col("row") == row, F.nullif(_at(col), F.lit(""))))

    return [F.coalesce(given(description), F.lit("Unknown")).alias("project_description"), F.coalesce(*map(given, date), F.lit("Unknown")).alias("fmea_date")]


def header_values(cells_: DataFrame, rows: dict[str, int] = {"system_name": 5, "system_element": 7, "function_name": 8}) -> DataFrame:  # noqa: B006
    """(file_name, system_name, system_element, function_name): what stands behind the colon in the first cells of fixed rows, else blank."""
    behind = F.when(F.contains("value", F.lit(":")), T.strip(F.get(F.split("value", ":", 2), F.lit(1)))).otherwise(F.lit(""))
    first = cells_.where("sheet_index = 1 AND col = 0")
    return first.groupBy("file_name").agg(*[F.coalesce(F.max(F.when(F.col("row") == n, behind)), F.lit("")).alias(c) for c, n in rows.items()])


def _system_name() -> Column:
    """Of the first row whose first cell has "system" and says a name, in the third cell or behind a colon: an aggregate over _top."""
    low, third = F.lower(T.strip_short(F.replace(_at(0), F.lit("："), F.lit(":")))), _at(2)
    name = F.when(third.isNotNull(), T.strip_prefix(third)).when(F.contains(low, F.lit(":")), T.strip_prefix(F.get(F.split(low, ":", 2), F.lit(1))))
    return F.min_by(name, F.when(F.contains(low, F.lit("system")) & name.isNotNull(), F.col("row")))


def _rows(sheet: DataFrame, files: DataFrame, names: list[str], fixed: dict[str, int]) -> DataFrame:
    """(file_name, row, values, columns of files but masks) of a sheet's rows: the values of the cells below the header that files tell to be of a name, and of fixed columns.

    files has one row a file: head, the row of its header; masks, by column the names whose value stands there, a bit each; and what else its records say.
    One shuffle and one sort by file and row serve the rows, the windows over them, and the join with files, which are hashed.
    """
    placed = sheet.select("file_name", "row", "col", "value").repartition("file_name").sortWithinPartitions("file_name", "row")
    said = [c for c in files.columns if c not in ("file_name", "head", "masks")]
    cells_ = placed.join(files.select("file_name", "head", "masks", F.struct(*said).alias("of")).hint("shuffle_hash"), "file_name")
    cells_ = cells_.select("file_name", "row", "col", "value", F.when(F.col("row") > F.col("head"), F.get("masks", F.col("col"))).alias("mask"), "of")
    values = {c: F.col("col") == i for c, i in fixed.items()} | {n: F.col("mask").bitwiseAND(1 << i) != 0 for i, n in enumerate(names)}
    rows = cells_.groupBy("file_name", "row").agg(*[F.max(F.when(holds, F.col("value"))).alias(c) for c, holds in values.items()], F.first("of").alias("of"))
    return rows.select("file_name", "row", *values, "of.*")


def _by_column(last: Column, of) -> Column:
    """of(i) for each column i up to the last."""
    return F.transform(F.sequence(F.lit(0), F.coalesce(last, F.lit(0))), of)


def new_layout(sheet: DataFrame) -> DataFrame:
    """Flat records of new-format workbooks (cells of their second sheet): cause present and severity not "-", with element and function from the markers above."""
    bits = F.create_map(*[F.lit(x) for i, h in enumerate(NEW_HEADERS) for x in (h, 1 << i)])
    heads = F.flatten(F.collect_list(F.when(F.col("row") == NEW_HEADER_ROW, F.transform("at", lambda a: F.struct(a["col"].alias("col"), F.element_at(bits, a["value"]).alias("bit"))))))
    files = _top(sheet).groupBy("file_name").agg(heads.alias("heads"), *_project("I2", "T4"), F.coalesce(_system_name(), F.lit("")).alias("system_name"))
    masks = _by_column(F.array_max(F.transform("heads", lambda h: h["col"])), lambda i: F.get(F.filter("heads", lambda h: h["col"] == i), F.lit(0))["bit"])
    files = files.withColumns({"masks": masks, "head": F.lit(NEW_HEADER_ROW)}).drop("heads")
    rows = _rows(sheet, files, list(NEW_HEADERS.values()), {"c0": 0, "c2": 2})
    marker = F.lower(T.strip_short(F.coalesce("c0", F.lit(""))))
    element = F.contains(marker, F.lit("system element"))
    function = F.contains(marker, F.lit("function")) & ~element
    named = T.strip_prefix(T.strip_short(F.coalesce("c2", F.lit(""))))
    # Strictly above: a record's own row is no marker of its context.
    rows = rows.withColumns({n: F.coalesce(last_before(rows, m, named, ["file_name"], ["row"]), F.lit("")) for m, n in ((element, "system_element"), (function, "function_name"))})
    wide = rows.where((T.strip_short(F.coalesce("failure_cause", F.lit(""))) != "") & (T.strip_short(F.coalesce("severity", F.lit(""))) != "-"))
    cause = T.discipline_and_cause(F.col("failure_cause"))
    filled = lambda c: T.strip_short(F.coalesce(F.col(c), F.lit("")))
    return wide.select(
        F.lit("new_fmea").alias("source_type"), "fmea_date", "project_description", "system_name", "system_element", "function_name",
        T.strip_prefix(F.col("failure_mode")).alias("failure_mode"), T.strip_prefix(F.col("failure_effect")).alias("failure_effect"), cause["cause"].alias("failure_cause"), cause["discipline"].alias("cause_discipline"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("severity", "occurrence", "detection", "rpn")], *[filled(c).alias(c) for c in ("controls_prevention", "current_detection", "recommended_action")], "file_name", F.col("row").alias("row_ord"))


def old_layout(sheet: DataFrame) -> DataFrame:
    """Flat records of old-format workbooks (cells of their sheet FMEA): the header row is the first of 20 that says "process step"; named columns, else fixed ones."""
    line = F.lower(F.concat_ws(" ", F.transform("at", lambda a: a["value"])))
    head = F.when(F.contains(line, F.lit("process step")), F.col("row"))
    files = _top(sheet).groupBy("file_name").agg(F.min(head).alias("head"), F.min_by("at", head).alias("at"), *_project("E2", "J4", "J3")).where("head IS NOT NULL")
    named = F.transform("at", lambda a: F.struct(T.header_name(a["value"]).alias("name"), a["col"].alias("col")))
    of = lambda n: F.array_max(F.transform(F.filter("named", lambda a: a["name"] == n), lambda a: a["col"]))
    cols = {f"col_{k}": F.coalesce(*map(of, names), F.lit(fixed)) for k, (names, fixed) in OLD_HEADERS.items()}
    masks = _by_column(F.greatest(*cols), lambda i: sum((F.when(F.col(c) == i, 1 << k).otherwise(0) for k, c in enumerate(cols)), F.lit(0)))
    files = files.withColumn("named", named).withColumns(cols).withColumn("masks", masks).drop("named", "at", *cols)
    body = _rows(sheet, files, list(OLD_HEADERS), {})
    filled = {k: F.coalesce(k, F.lit("")) for k in OLD_HEADERS}
    filled |= {k: F.when(T.is_numeric_like(filled[k]), filled[k]).otherwise(F.lit("")) for k in OLD_NUMBERS}
    out = body.select("file_name", "row", "project_description", "fmea_date", *[c.alias(k) for k, c in filled.items()]).where("failure_cause <> ''")
    from ..operators.ingest import record_text

    return out.withColumns({"source_type": F.lit("old_fmea"), "text": record_text(out)}).withColumnRenamed("row", "row_ord")


def read_fmea(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(records of both layouts with file_ord and row_ord, files that could not be read) of a folder: .xlsm are new, .xlsx old."""
    return records_of(read_cells(spark, path))


def records_of(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of CELLS, however they were read; written once, since the layouts look at them several times. Files are numbered by name, for those who ask."""
    kept = shared_folder(every.sparkSession)
    ends = lambda x: F.lower("path").endswith(x)
    layout = F.when(ends(".xlsm") & (F.col("sheet_index") == 1), "new").when(ends(".xlsx") & (F.col("sheet") == "FMEA"), "old")
    bad = F.col("error").isNotNull()
    # What no layout looks at is not written: cells of other sheets, paths of files that could be read.
    every = every.select("file_name", "row", "col", "value", F.when(~bad, layout).alias("layout"), F.when(bad, F.col("path")).alias("path"), "error").where("layout IS NOT NULL OR error IS NOT NULL")
    every.write.parquet(kept)
    every = every.sparkSession.read.schema(every.schema).parquet(kept)
    records = new_layout(every.where("layout = 'new'")).unionByName(old_layout(every.where("layout = 'old'")), allowMissingColumns=True)
    files = records.select("file_name").distinct().withColumn("file_ord", F.row_number().over(Window.orderBy("file_name")) - 1)
    # A left join of distinct names: one that nobody's columns come from is left out of the plan, and records are made once.
    return records.join(files, "file_name", "left"), every.where("error IS NOT NULL").select("path", "error")
