"""Workbooks, reports and JSON lines: written and read again, broken and odd files, streams."""

import io
import os
import zipfile

import pyarrow as pa
import pytest

from faultline.operators import eightd
from faultline.sources import documents, files, formats, workbook

CELL = "path string, sheet string, sheet_index int, row int, col int, value string, is_number boolean"
#: Odd texts: markup, quotes, line ends, tabs, outer blanks, other scripts.
ODD = ["a < b & c", 'say "so"', " outer ", "two\nlines", "cr\rhere", "tab\there", "größe 漢字 \U0001f600", "]]>"]


def cells_of(rows):
    return sorted((r.file_name, r.sheet, r.sheet_index, r.row, r.col, r.value, r.is_number) for r in rows)


@pytest.fixture
def books(spark, tmp_path):
    """Forty workbooks with a cell of each odd text, a number, and a far column; the second sheet alone has cells."""
    rows = [(f"b{n}.xls{'mx'[n % 2]}", "Data & more", 1, i, i * 30, v, False) for n in range(40) for i, v in enumerate(ODD)]
    rows += [(f"b{n}.xls{'mx'[n % 2]}", "Data & more", 1, 9, 701, str(n), True) for n in range(40)]
    folder = str(tmp_path / "books")
    formats.write_workbooks(spark.createDataFrame(rows, CELL), folder)
    return folder, sorted((p.rsplit(".", 1)[0], s, i, r, c, v, k) for p, s, i, r, c, v, k in rows)


def test_cells_come_back(spark, books):
    folder, want = books
    formats.register(spark)
    assert len(os.listdir(folder)) == 40  # the folder of the write itself is gone
    got = spark.read.format("workbook_cells").option("groupBytes", "4000").load(folder)
    assert 5 < got.rdd.getNumPartitions() <= 40
    assert cells_of(got.collect()) == cells_of(workbook.read_cells(spark, folder).collect()) == want
    assert spark.read.format("workbook_cells").load("file://" + folder).rdd.getNumPartitions() == 1


def test_broken_hidden_and_other_files(spark, books):
    folder, want = books
    for name, content in (("broken.xlsx", b"no workbook"), ("empty.xlsm", b""), ("~$b0.xlsx", b"lock"), ("note.txt", b"x")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content)
    with zipfile.ZipFile(f"{folder}/half.xlsx", "w") as z:  # begins well, its sheet does not end
        z.writestr("xl/workbook.xml", '<w xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheet name="s" r:id="r0"/></w>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r0" Target="s.xml"/></R>')
        z.writestr("xl/s.xml", '<x xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><c r="A1"><v>1</v></c>')
    got = spark.read.format("workbook_cells").load(folder).collect()
    assert cells_of(r for r in got if r.error is None) == want
    assert {r.file_name for r in got if r.error is not None} == {"broken", "empty", "half"}
    assert spark.read.format("workbook_cells").load(f"{folder}/b0.xlsm").count() == 9


def test_empty_folder_and_no_rows(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "none").mkdir()
    assert spark.read.format("workbook_cells").load(str(tmp_path / "none")).count() == 0
    formats.write_workbooks(spark.createDataFrame([(None, "s", 0, 0, 0, "v", False), ("a.xlsx", "s", 0, 0, 0, None, False)], CELL), str(tmp_path / "out"))
    assert spark.read.format("workbook_cells").load(str(tmp_path / "none")).schema.simpleString() == workbook.cells(spark.createDataFrame([], "path string, content binary")).schema.simpleString()


def test_a_file_in_two_tasks_is_an_error(spark, tmp_path):
    formats.register(spark)
    rows = spark.createDataFrame([("a.xlsx", "a", "s", 0, n, 0, "v", False, None) for n in range(50)], workbook.CELLS).repartition(4)
    with pytest.raises(Exception, match="more than one task"):
        rows.write.format("workbook_cells").mode("append").save(str(tmp_path / "out"))
    assert not [f for f in os.listdir(tmp_path / "out")]


def test_reports_come_back(spark, tmp_path):
    rows = [(f"r{n}.docx", "paragraph", i, "Heading 2" if i % 3 == 0 else "Normal", v.replace("\r", ""), None) for n in range(9) for i, v in enumerate(ODD)]
    rows += [(f"r{n}.docx", "row", 20, None, "Product", f"pump\n{n}") for n in range(9)]
    formats.write_reports(spark.createDataFrame(rows, "path string, kind string, ord int, style string, text string, second string"), str(tmp_path / "r"))
    (tmp_path / "r" / "bad.docx").write_bytes(b"PK")
    got = spark.read.format("report_parts").load(str(tmp_path / "r"))
    plain = documents.read_reports(spark, str(tmp_path / "r"))
    shown = lambda df: sorted(((r.file, r.kind, r.ord, r.style, r.text, r.second) for r in df.where("error IS NULL").collect()), key=str)
    # Places are counted anew, so that the table's row comes right behind the paragraphs.
    assert shown(got) == shown(plain) == sorted(((p, k, min(o, len(ODD)), s, t, x) for p, k, o, s, t, x in rows), key=str)
    assert {(r.file, r.ord): r.text for r in got.where("kind = 'paragraph'").collect()} == {(p, o): t for p, k, o, _, t, _ in rows if k == "paragraph"}
    assert {r.product for r in documents.products(got).collect()} == {f"pump\n{n}" for n in range(9)}
    assert [r.file for r in got.where("error IS NOT NULL").collect()] == ["bad.docx"]
    assert eightd.sections(got.where("error IS NULL AND kind = 'paragraph'")).count() == 27


def test_streams_read_each_file_once(spark, books, tmp_path):
    folder, want = books
    names = sorted(os.listdir(folder))
    arriving = tmp_path / "arriving"
    arriving.mkdir()
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def arrive(some):
        for n in some:
            os.link(f"{folder}/{n}", arriving / n)
        stream = formats.stream_cells(spark, str(arriving), per_batch=7)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()

    arrive(names[:25])
    arrive(names[25:])
    assert cells_of(spark.read.parquet(out).collect()) == want


def test_lines_of_faults_through_blocks(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    want, good = [], 0
    for name, n in (("a.jsonl", 4000), ("b.jsonl", 10), ("empty.jsonl", 0)):
        lines = []
        for i in range(n):
            line = {0: "", 1: "   ", 2: "{broken", 3: '{"k": "text"}', 4: '{"k": 1} tail', 5: "[1, 2]"}.get(i % 97, f'{{"k": {i}, "s": "zeile ü {i}", "more": 1}}')
            lines.append(line)
            if line.strip() and i % 97 in (2, 3, 5):
                want.append((name, i + 1, line))
            elif line.strip():
                good += 1
        (folder / name).write_text("\n".join(lines), encoding="utf-8")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "9000")  # a block ends within a line
    try:
        rows, faults = files.read_lines_checked(spark, str(folder), "k long, s string")
        assert rows.rdd.getNumPartitions() > 10
        got = sorted((r.file.rsplit("/", 1)[1], r.line, r.text) for r in faults.collect())
        n = rows.count()
        assert rows.columns == ["k", "s"]
    finally:
        spark.conf.set(key, before)
    assert (got, n) == (sorted(want), good)


def test_addresses_are_matched_once_a_column(monkeypatch):
    asked, plain = [], workbook.cell_address
    monkeypatch.setattr(workbook, "cell_address", lambda at: asked.append(at) or plain(at))
    rows = [("b.xlsx", None, "s", 0, r, c, "<x>&" if c else str(r), not c, None) for r in range(300) for c in (0, 2, 30)]
    assert list(workbook.parse(formats.WorkbookCells.build(iter(rows)))) == [(s, i, r, c, v, k) for _, _, s, i, r, c, v, k, _ in rows]
    assert asked == ["A1", "C1", "AE1"]
    # A text in runs, and in no run at all.
    cells = {"<is><r><t>a</t></r><r><t> b</t></r></is>": "a b", "<is/>": "", "<is><t>x</t></is>": "x", "<is><t/></is>": ""}
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    nodes = [workbook.ElementTree.fromstring(f"<c {main}>{c}</c>") for c in cells]
    assert [workbook._inline(n) for n in nodes] == [workbook._text(n) for n in nodes] == list(cells.values())
    columns = [pa.array([1, None], pa.int32()), pa.array([1, 2], pa.int32()), pa.array(["a", None]), pa.array([True, None]), pa.array([False, True]), pa.array([None, None], pa.string()), pa.array([], pa.int32())]
    for c in columns:
        assert [(type(v), v) for v in formats._listed(c)] == [(type(v), v) for v in c.to_pylist()]


def test_rows_of_a_file_through_batches():
    rows = [(f"{b}.xlsx", None, "s", i, r, c, f"{r}&{c}", False, None) for b in "ab" for i in (0, 2) for r in range(5) for c in range(7)]
    schema = formats._arrow(workbook.CELLS)
    parts = [rows[i : i + 4] for i in range(0, len(rows), 4)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*p), schema.types)], schema=schema) for p in parts]
    files = list(formats.WorkbookCells.built(batches))
    assert [n for n, _ in files] == ["a.xlsx", "b.xlsx"]
    for name, content in files:
        assert list(workbook.parse(content)) == [(s, i, r, c, v, k) for n, _, s, i, r, c, v, k, _ in rows if n == name]
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            assert z.read("xl/worksheets/sheet3.xml").count(b"<row ") == z.read("xl/worksheets/sheet3.xml").count(b"</row>") == 5  # a row that two batches hold is one


def test_plain_cells_are_those_of_the_tree():
    main = workbook._MAIN[1:-1]
    whole = lambda cells, root="": f'<?xml version="1.0" encoding="UTF-8"?>\r\n<worksheet xmlns="{main}"{root}><cols><col min="1"/></cols><sheetData><row r="1">{cells}</row></sheetData></worksheet>'.encode()
    shared, dates = ["first", "second"], {3}

    def both(xml):
        plain = workbook._plain_cells(xml)
        tree = [(a, v, n) for a, _, v, n in workbook._tree_cells(xml, shared, dates)]
        return plain and [(c + r, *(workbook._typed(k or "n", s or "0", v, shared, dates) if v else (t, False))) for c, r, s, t, k, v in plain], tree

    text = '<c r="A1" t="inlineStr"><is><t xml:space="preserve">{}</t></is></c>'.format
    for cells in (text("a &lt; b &amp;amp; &#65;&#x1F600; &quot;"), text(" cr\rand\r\nlf "), text(""), '<c r="B1" s="3"><v>45000</v></c><c r="C1" s="1"/><c r="D1" t="s"><v>1</v></c><c r="AA1"><v>1.50</v></c><c r="AB1" t="str"><v>x&gt;y</v></c><c r="AC1" t="b"><v>1</v></c>'):
        plain, tree = both(whole(cells))
        assert plain == tree and plain
    # All else is left to the tree, or is an error there.
    others = ["<!-- " + text("x") + " -->", '<c r="A1" t="inlineStr"><is><t><![CDATA[<c r="A1"><v>1</v></c>]]></t></is></c>', '<c r="A1"><f>B1</f><v>1</v></c>', '<c s="1" r="A1"><v>1</v></c>', '<c r="A1" t="inlineStr"><is><r><t>a</t></r></is></c>', '<c r="A1"><v></v></c>', f'<y xmlns="z">{text("x")}</y>', "<?odd " + text("x") + "?>"]
    assert [both(whole(c))[0] for c in others] == [None] * len(others)
    assert both(whole(text("x"), f' xmlns:p="{main}"'))[0] is None
    for broken in (whole(text("x"))[:-3], whole(text("&odd;")), whole(text("\x01"))):
        assert workbook._plain_cells(broken) is None
        with pytest.raises(workbook.ElementTree.ParseError):
            list(workbook._tree_cells(broken, shared, dates))


def test_records_are_made_once_and_headers_may_repeat(spark, tmp_path):
    new = list(workbook.NEW_HEADERS)
    rows = [("n.xlsm", "S", 1, 6, c, h, False) for c, h in ((3, new[3]), (5, new[2]), (6, new[1]), (8, new[3]))]
    rows += [("n.xlsm", "S", 1, 7, 0, " System element ", False), ("n.xlsm", "S", 1, 7, 2, "[x] pump", False)]
    rows += [("n.xlsm", "S", 1, 8 + i, c, v, False) for i, (c, v) in enumerate(((3, "[S01 - HW] left"), (8, "right")))] + [("n.xlsm", "S", 1, 8, 6, "-", False)]
    rows += [("n.xlsm", "other", 0, 9, 3, "of no sheet that counts", False)]
    rows += [("o.xlsx", "FMEA", 0, 2, c, h, False) for c, h in ((7, "Process Step"), (2, "severity"), (9, "RPN"))] + [("o.xlsx", "FMEA", 0, 3, c, str(c), False) for c in range(12)]
    formats.write_workbooks(spark.createDataFrame(rows, CELL), str(tmp_path / "w"))
    (tmp_path / "w" / "bad.xlsm").write_bytes(b"PK")
    formats.register(spark)
    records, bad = workbook.records_of(spark.read.format("workbook_cells").load(str(tmp_path / "w")))
    found = {r.file_name: r.asDict() for r in records.collect()}
    pick = lambda n, *c: tuple(found[n][k] for k in c)
    assert pick("n", "failure_cause", "cause_discipline", "system_element", "row_ord", "file_ord", "project_description") == ("right", "", "pump", 9, 0, "Unknown")
    assert pick("o", "failure_type", "failure_mode", "severity", "failure_cause", "rpn", "detection", "row_ord", "file_ord") == ("7", "2", "2", "5", "9", "9", 3, 1)
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.xlsm"]
    # Two scans a layout, and no second making of records for numbers of files that nobody asks for.
    plan = records.drop("file_ord")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 4
