import glob
import os
import random
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from faultline import queries
from faultline.functions import hooks
from faultline.functions.text import parse_number  # noqa: F401
from faultline.operators import eightd, graph, ingest, quality, texteval, vectors
from faultline.sources import documents, files, workbook
from faultline.streaming import incremental

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cells(row):
    return tuple(None if v is None else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((cells(r[c] for c in columns) for r in df.collect()), key=str)
    c = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in c.description]
    want = sorted((cells(r[names.index(x)] for x in columns) for r in c.fetchall()), key=str)
    assert got == want


def test_queries_without_sql_run(spark):
    assert queries.QUERIES["pca_project"](spark, SF).count() == 500
    rows = queries.QUERIES["faithfulness_fuzzy"](spark, SF).collect()
    assert {r.faithful_type for r in rows} <= {"exact", "fuzzy", "partial", "hallucinated"}


# --- Ingest against record-at-a-time deduplication ----------------------------------------------------------------


def normal(x):
    import re

    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", (x or "").lower().strip()))


def one_by_one(rows):
    """A plain simulation: files in order, groups in order of their first record, stores searched from the start."""
    failures, causes, groups = {}, {}, {}
    for r in rows:
        sig = tuple(normal(r[c]) for c in (("system_name", "system_element", "function_name") if r["source_type"] == "new_fmea" else ("failure_type",)) + ("failure_mode", "failure_effect"))
        groups.setdefault((r["file_ord"], r["source_type"] == "new_fmea", sig), []).append(r)
    number = {}
    for (file, new, _), members in sorted(groups.items(), key=lambda g: (g[0][0], g[1][0]["row_ord"])):
        f = members[0]
        element = f["system_element"] if new else {"Pump / Impeller": "pump / impeller", "Motor/ Connectors": "motor / connectors"}.get(f["failure_type"])
        system = f["system_name"] if new else None
        key = normal(f["failure_mode"]), normal(f["failure_effect"]), normal(element), normal(system)
        if key not in failures:
            number[file] = number.get(file, 0) + 1
            severities = [float(m["severity"]) for m in members if (m["severity"] or "").strip().isdigit()]
            failures[key] = {"id": f"{f['file_name']}__F{number[file]}", "severity": max(severities, default=None), "causes": []}
        own = failures[key]
        for m in members:
            if m["failure_cause"]:
                ck = own["id"], normal(m["failure_cause"])
                if ck not in causes:
                    causes[ck] = f"{own['id']}_C{len(own['causes']) + 1}", m["failure_cause"], f["failure_mode"]
                    own["causes"].append(causes[ck][0])
    return {v["id"]: (v["severity"], v["causes"]) for v in failures.values()}, set(causes.values())


@pytest.mark.parametrize("seed", range(3))
def test_ingest_against_simulation(spark, seed):
    r = random.Random(seed)
    rows = []
    for file in range(4):
        for n in range(60):
            new = r.random() < 0.5
            rows.append({"file_ord": file, "file_name": f"f{file}", "row_ord": n, "source_type": "new_fmea" if new else "old_fmea", "system_name": r.choice(["s", "S.", None]) if new else None, "system_element": r.choice(["e", ""]) if new else None, "function_name": r.choice(["g", "h"]) if new else None, "failure_type": None if new else r.choice(["Pump / Impeller", "Motor/ Connectors", "Mechanics", None]), "failure_mode": r.choice(["fails", "Fails", "fails.", "stuck"]), "failure_effect": r.choice(["stop", None, ""]), "failure_cause": r.choice(["dust", "Dust", "wear.", "", None]), "severity": r.choice(["3", "7", "n/a", None, "x"])})
    schema = "file_ord int, file_name string, row_ord int, source_type string, system_name string, system_element string, function_name string, failure_type string, failure_mode string, failure_effect string, failure_cause string, severity string"
    failures, causes = ingest.ingest(spark.createDataFrame([tuple(x[c.split()[0]] for c in schema.split(", ")) for x in rows], schema))
    want_f, want_c = one_by_one(rows)
    assert {x.failure_id: (x.severity, x.cause_ids) for x in failures.collect()} == want_f
    assert {(x.cause_id, x.failure_cause, x.failure_mode) for x in causes.collect()} == want_c
    by_ranges = ingest.ingest(spark.createDataFrame([tuple(x[c.split()[0]] for c in schema.split(", ")) for x in rows], schema), by_ranges=True)
    assert [sorted(map(str, x.collect())) for x in by_ranges] == [sorted(map(str, x.collect())) for x in (failures, causes)]
    # what was ingested has consistent keys
    assert quality.orphan_causes(failures, causes).count() == quality.orphan_failures(failures, causes).count() == 0


def test_files_are_numbered_by_ranges(spark, monkeypatch):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from faultline.plans import fixtures

    monkeypatch.setattr(fixtures, "RANGE", 7, raising=False)
    rows = fixtures.fmea_rows(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "range" in plan.split("windowspecdefinition(", 1)[1].split(")")[0], "a whole file is numbered in one task"
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")]
    lines = fixtures.table(spark, "/root/testdata/sf0.001", "lineitem").join(fixtures.table(spark, "/root/testdata/sf0.001", "part"), F.expr("l_partkey = p_partkey"))
    plain = lines.select(F.expr("CAST(l_orderkey % 5 AS INT)").alias("f"), "l_linenumber", "p_name", F.row_number().over(Window.partitionBy(F.expr("l_orderkey % 5")).orderBy(*order)).alias("n"))
    want = {(r.f, r.n): r.p_name + ("." if r.l_linenumber == 2 else "") for r in plain.collect()}
    assert {(r.file_ord, r.row_ord): r.failure_mode for r in rows.collect()} == want


def test_repeated_records_are_ingested_once(spark):
    schema = "file_ord int, file_name string, row_ord int, source_type string, failure_type string, failure_mode string, failure_effect string, failure_cause string, severity string"
    rows = [(n // 400, f"f{n // 400}", n, "old_fmea", "Pump / Impeller", ("fails", "Fails.", "stuck")[n % 3], None, ("dust", "", "wear")[n % 4 % 3], str(n % 9)) for n in range(800)]
    d = spark.createDataFrame(rows, schema)
    few = ingest.distinct_records(d)
    assert few.count() == len({(r[0], *r[5:8]) for r in rows}) and "SortAggregate" not in few._jdf.queryExecution().executedPlan().toString()
    failures, causes = ingest.ingest(d)
    want_f, want_c = one_by_one([dict(zip(d.columns, r)) | {"system_name": None, "system_element": None, "function_name": None} for r in rows])
    assert {x.failure_id: (x.severity, x.cause_ids) for x in failures.collect()} == want_f
    assert {(x.cause_id, x.failure_cause, x.failure_mode) for x in causes.collect()} == want_c


def test_clashing_files(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "file_ord int, file_name string")
    assert [x.file_name for x in ingest.clashing_files(df).collect()] == ["a"]


# --- Vectors ------------------------------------------------------------------------------------------------------


def test_causes_of_pairs_meet_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "PAIRED", 5, raising=False)
    r = np.random.default_rng(5)
    x = r.normal(size=(60, 8))
    rows = [(int(n % 4), n, [float(v) for v in x[n]]) for n in range(60)]
    causes = spark.createDataFrame(rows, "failure_id long, cause_id long, embedding array<double>")
    pairs = spark.createDataFrame([(1, 0), (0, 1), (2, 3), (2, 2), (0, 9)], "failure_a long, failure_b long")
    found = vectors.near_duplicate_causes(pairs, causes, 0.3)
    assert "FlatMapGroupsInPandas" in found._jdf.queryExecution().optimizedPlan().toString(), "pairs of causes are rows with both vectors"
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f, g, a, b): round(float(unit[a] @ unit[b]), 4) for f, a, _ in rows for g, b, _ in rows if (f, g) in ((0, 1), (2, 3)) and unit[a] @ unit[b] >= 0.3}
    got = found.collect()
    assert len(got) == len(want) > 20 and {(x.failure_a, x.failure_b, x.cause_a, x.cause_b): x.similarity for x in got} == want


def test_scans_in_small_blocks(spark):
    from faultline.plans.fixtures import kb_vec

    v = kb_vec(spark, SF)
    one = vectors.nearest(v, 4).select("vec_id", "other", "neighbour").collect()
    many = vectors.nearest(v, 4, block=60).select("vec_id", "other", "neighbour").collect()
    assert set(one) == set(many)
    a, b = (set(vectors.near_duplicate_failures(v, 0.2, block=n).collect()) for n in (2000, 50))
    assert a == b and a


def test_search_without_some_roles(spark):
    from faultline.plans.fixtures import kb_vec

    v = kb_vec(spark, SF)
    q = v.where("vec_id = 0").first()["embedding"]
    assert vectors.search_failures(v, {"failure_mode": q, "failure_effect": None}).first()["failure_id"] == 0
    assert vectors.search_failures(v, {}).count() == 0


def test_embedding_and_extraction_hooks(spark):
    df = spark.createDataFrame([(1, "pump stuck"), (2, None)], "id int, text string")
    got = {r.id: r.embedding for r in hooks.embed(df).collect()}
    assert len(got[1]) == 64 and sum(x * x for x in got[1]) == pytest.approx(1) and not any(got[2])
    answers = hooks.extract(df, lambda texts: [f'x {{"n": {len(t)}}} y' for t in texts], "struct<n:int>").collect()
    assert [r.answer.n for r in answers] == [10, 0]
    assert hooks.extract(df, None, "struct<n:int>").first().answer is None


# --- Graph, text evaluation, 8D -------------------------------------------------------------------------------------


def test_graph_upsert_and_store(spark, tmp_path):
    schema = "id string, label string, props map<string,string>"
    old = spark.createDataFrame([("a", "X", {"k": "1", "m": "2"}), ("b", "Y", {})], schema)
    new = spark.createDataFrame([("a", "", {"k": "9"}), ("c", "Z", {"q": "1"})], schema)
    got = {r.id: (r.label, r.props) for r in graph.upsert_nodes(old, new).collect()}
    assert got == {"a": ("X", {"k": "9", "m": "2"}), "b": ("Y", {}), "c": ("Z", {"q": "1"})}
    causes = spark.createDataFrame([("c1", "f1", "m", None, "e", "why", None, None, None, None)], "cause_id string, failure_id string, failure_mode string, failure_element string, failure_effect string, failure_cause string, discipline string, occurrence double, detection string, recommended_action string")
    g = graph.Graph.from_causes(causes)
    g.save(str(tmp_path))
    h = graph.Graph.load(spark, str(tmp_path))
    assert h.find("FailureElement", "name", "x").count() == 0 and h.node("FailureElement::name::None").count() == 1
    assert {(r.kind, r.value) for r in h.chain("f1").collect()} == {("failure_element", "FailureElement::name::None"), ("failure_mode", "m"), ("failure_effect", "e"), ("failure_cause", "why")}
    with pytest.raises(ValueError):
        h.neighbours("x", direction="up")


def test_faithfulness_types(spark):
    pairs = [("Motor stops", "the motor  stops here"), ("here stops the motor", "the motor stops here"), ("", "x"), ("alpha beta", "gamma delta"), (None, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, sentence string, source string")
    got = {r.i: (r.faithful_type, r.faithful_score) for r in texteval.faithfulness(df).collect()}
    assert got[0] == ("exact", 100) and got[1] == ("fuzzy", 100) and got[2] == ("hallucinated", 0) and got[3][0] == "hallucinated" and got[4] == ("hallucinated", 0)


def test_a_source_is_made_plain_once_for_all_its_sentences(spark):
    import re

    from faultline import case_queries

    plan = case_queries.case_flow(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # What lies above the join sees no whole source, but what was made of it.
    assert plan.count("Join Inner") == 1 and not re.search(r"\bsource#", plan.split("Join Inner")[0])
    sources = spark.createDataFrame([(1, "The motor  stops here. Dust everywhere in it"), (2, "x"), (3, None)], "file int, source string")
    said = [(1, "Motor stops"), (1, "here stops the motor"), (1, "dust is everywhere"), (1, ""), (2, "alpha beta"), (2, None), (3, "a"), (3, ""), (4, "of no case")]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(said)], "i int, file int, sentence string")
    pairs = rows.join(sources, "file")
    got = texteval.faithfulness_by(rows, sources, "file")
    want = texteval.faithfulness(pairs).drop("source").select(got.columns)
    assert got.columns == ["i", "file", "sentence", "faithful_type", "faithful_score", "faithful"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("faithful_type = 'fuzzy'").count() == 2
    got = texteval.exact_or_covered_by(rows, sources, "file")
    assert sorted(map(str, got.collect())) == sorted(map(str, texteval.exact_or_covered(pairs).select(got.columns).collect()))


def test_summary_equal_to_source(spark):
    df = spark.createDataFrame([(1, "The pump is stuck. It was cold.", ["The pump is stuck", "It was cold"]), (2, "", [])], "doc_id int, source string, summary_sentences array<string>")
    got = {r.doc_id: r for r in texteval.compression_report(df).collect()}
    assert (got[1].mean_coverage, got[1].mean_faithfulness, got[1].compression_ratio, got[1].information_density) == (1.0, 1.0, 1.0, 1.0)
    assert (got[2].unit_count, got[2].mean_coverage, got[2].sentence_count) == (0, 0.0, 0)


CASE = """{"documents": [{"file_name": "8D%d", "product_name": "pump"}], "failure": {"failure_ID": "F%d", "failure_mode": "stuck", "failure_element": "rotor",
 "supporting_entities": [{"sentence_id": "s1_%d", "text": "seen", "source_section": "D2", "annotations": {"assertion_level": "observed", "faithful_score": %d}}],
 "root_causes": [{"cause_ID": "C%d", "failure_cause": "dust", "supporting_entities": [{"sentence_id": "s2_%d", "text": "dusty", "source_section": "D4"}]}]},
 "selected_sentences": [{"sentence_id": "s1_%d", "text": "seen"}, {"sentence_id": "s3_%d", "text": "else"}]}"""


def test_case_ingest(spark, tmp_path):
    for n, score in ((1, 96), (2, 50)):
        (tmp_path / f"case{n}.json").write_text(CASE % (n, n, n, score, n, n, n, n))
    failures, causes, sentences = eightd.ingest(files.read_cases(spark, str(tmp_path)))
    assert {(r.failure_id, r.status, tuple(r.cause_ids), r.product, r.maintenance.version) for r in failures.collect()} == {("F1", "supported", ("C1",), "pump", "V0"), ("F2", "hypothesis", ("C2",), "pump", "V0")}
    assert {(r.cause_id, r.failure_id, r.root_cause, tuple(r.supporting_sentence_ids)) for r in causes.collect()} == {("C1", "F1", "dust", ("s2_1",)), ("C2", "F2", "dust", ("s2_2",))}
    assert {(r.sentence_id, r.sentence_role) for r in sentences.collect()} == {(f"s{k}_{n}", role) for n in (1, 2) for k, role in ((1, "failure_sentence"), (2, "cause_sentence"), (3, "other"))}


def test_blocks_and_invalid_cases(spark, tmp_path):
    df = spark.sql("SELECT 'Drive' AS s, CAST(NULL AS STRING) AS p, array(named_struct('system_element', 'rotor', 'failure_mode', 'stuck', 'failure_effect', CAST(NULL AS STRING))) AS f")
    assert df.select(eightd.context_block(F.col("s"), F.col("p"), F.col("f"))).first()[0] == "\nSystem Name: Drive\nProblem Symptoms: None\n\nFailures:\n\n  - Element: rotor\n  - Mode: stuck\n  - Effect: None\n\n"
    (tmp_path / "a.json").write_text('{"documents": [], "failure": {"failure_mode": "x", "root_causes": [{"failure_cause": "y"}]}, "selected_sentences": [{"sentence_id": "s"}]}')
    (tmp_path / "b.json").write_text(CASE % (1, 1, 1, 96, 1, 1, 1, 1))
    found = eightd.invalid_cases(files.read_cases(spark, str(tmp_path))).collect()
    assert {(r.file_ord, r.message) for r in found} == {(0, m) for m in ("missing documents", "missing failure_ID", "missing cause_ID", "missing sentence text")}
    sentences = spark.createDataFrame([("k", 1, "s1", "seen", "D4", ("support", "pump", 96, "exact"))], "case_id string, ord int, sentence_id string, text string, source_section string, annotations struct<status:string,subject:string,faithful_score:int,faithful_type:string>")
    r = eightd.signals(eightd.second_input(sentences)).first()
    assert (r.D2, r.D4) == ("- (none)", "- [id:s1] [subject:pump] seen (status=support, faithful_score=96, type=exact)")


def test_small_reports(spark):
    s = spark.createDataFrame([("f", "a", "failure"), ("f", "c", "cause"), ("f", "b", "failure")], "file_name string, sentence_id string, role string")
    assert tuple(vectors.role_index(s).first()) == ("f", ["a", "b"], ["c"], [])
    listing = spark.createDataFrame([("fmea_x.XLSM",), ("x_FMEA.xlsm",), ("FMEA.xlsx",)], "file string")
    assert [r.file for r in files.fmea_files(listing).collect()] == ["fmea_x.XLSM"]
    rated = spark.createDataFrame([("a and b", "symptom", "observed", "exact")], "text string, entity_type string, assertion_level string, faithful_type string")
    assert texteval.rates_text(texteval.iteration_rates(rated)).first()[0].startswith("Total: 1\nFaithful: 1\nHallucinated: 0")


def test_root_cause_defaults_and_resolve(spark):
    df = spark.sql("SELECT 'D' AS d, array(named_struct('failure_cause', ' ', 'cause_level', CAST(NULL AS STRING), 'discipline_type', 'XX', 'confidence', CAST(NULL AS STRING))) AS c, CAST(NULL AS array<struct<failure_cause:string,cause_level:string,discipline_type:string,confidence:string>>) AS n")
    r = df.select(eightd.root_cause_defaults(F.col("d"), F.col("c")).alias("c"), eightd.root_cause_defaults(F.col("d"), F.col("n")).alias("n")).first()
    assert tuple(r.c[0]) == ("D_F1_C1", "unknown", "Unknown cause (LLM incomplete)", "Other", "medium") and r.n == []
    ids = spark.createDataFrame([("k", ["b", "zz", "a"])], "case_id string, ids array<string>")
    index = spark.createDataFrame([("k", "a", "A"), ("k", "b", "B")], "case_id string, sentence_id string, text string")
    assert [s.sentence_id for s in eightd.resolve(ids, index).first().sentences] == ["b", "a"]


# --- Sources --------------------------------------------------------------------------------------------------------


def make_workbook(path, sheets):
    """A small workbook: {sheet: {A1: value}}."""
    with zipfile.ZipFile(path, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<R>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</R>")
        for i, at in enumerate(sheets.values()):
            body = "".join(f'<c r="{a}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{a}" t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>' for a, v in at.items())
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData><row>{body}</row></sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    heads = list(workbook.NEW_HEADERS)
    table = {f"{chr(65 + i)}7": h for i, h in enumerate(heads)}
    row = lambda n, *v: {f"{chr(65 + i)}{n}": x for i, x in enumerate(v) if x is not None}
    new = {"I2": "Pump 5", "A2": "System", "C2": "[S01] Drive", "A4": "System element", "C4": "[E] Rotor", "A5": "Function", "C5": "spin", **table}
    new |= row(8, "stops", 7, "[M] stuck", "[S01 - HW] dust", "seal", 3, "look", 2, 42, "clean")
    new |= row(9, "stops", "-", "stuck", "wear", None, None, None, None, None, None)
    new |= {"A10": "Function", "C10": "hold"} | row(11, None, 5, "loose", "shock", None, 1.5, None, None, None, None)
    make_workbook(tmp_path / "a.xlsm", {"cover": {}, "dfmea": new})
    old = {"E2": "Fan", "J3": "2020", "B6": "Process Step", "D6": "Potential  Effect(s)\nof Failure", "C6": "Potential Failure Mode", "F6": "Potential cause(s) of failure", "L6": "Severity"}
    old |= {"B7": "Motor/ Connectors", "C7": "open", "D7": "silent", "E7": "wrong", "F7": "vibration", "L7": "n/a", "G7": 4} | {"B8": "x", "L8": 9}
    make_workbook(tmp_path / "b.xlsx", {"FMEA": old})
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    (tmp_path / "d.txt").write_text("skipped")
    records, bad = workbook.read_fmea(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["c.xlsx"]
    got = {(r.file_name, r.failure_cause): r for r in records.collect()}
    assert set(got) == {("a", "dust"), ("a", "shock"), ("b", "vibration")}
    a, s, b = got[("a", "dust")], got[("a", "shock")], got[("b", "vibration")]
    assert (a.system_name, a.system_element, a.function_name, a.failure_mode, a.cause_discipline, a.severity, a.rpn, a.project_description, a.fmea_date) == ("Drive", "Rotor", "spin", "stuck", "HW", "7", "42", "Pump 5", "Unknown")
    assert (s.function_name, s.occurrence, s.failure_effect) == ("hold", "1.5", "")
    assert (b.failure_type, b.failure_mode, b.failure_effect, b.severity, b.occurrence, b.project_description, b.fmea_date) == ("Motor/ Connectors", "open", "silent", "", "4", "Fan", "2020")
    assert b.text == "Failure mode open. Cause vibration leads to effect silent. Severity , Occurrence 4, Detection , RPN . Action n/a."  # no header for actions: the fixed column, L
    assert workbook.cell_address("aa10") == (9, 26)
    with pytest.raises(ValueError):
        workbook.cell_address("10A")


def test_reports(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s=None: f'<w:p>{f"""<w:pPr><w:pStyle w:val="{s}"/></w:pPr>""" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("intro") + "<w:tbl><w:tr><w:tc>" + p("Product name") + "</w:tc><w:tc>" + p("Pump") + "</w:tc></w:tr></w:tbl>" + p("D2 problem", "H2") + p("It stops.") + p(" ") + p("Always.") + p("D4 cause", "H2") + p("Dust.")
    with zipfile.ZipFile(tmp_path / "r.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>')
    (tmp_path / "~$r.docx").write_bytes(b"lock")
    parts = documents.read_reports(spark, str(tmp_path))
    assert documents.products(parts).first()["product"] == "Pump"
    sections = eightd.sections(parts.where("kind = 'paragraph'"))
    assert {(r.title, r.content) for r in sections.collect()} == {("D2 problem", "It stops.\nAlways."), ("D4 cause", "Dust.")}
    picked = eightd.pick_sections(sections).first()
    assert (picked.D2, picked.D3, picked.D4) == ("It stops.\nAlways.", None, "Dust.")
    assert eightd.with_prefixes(sections, ("D4",)).count() == 1
    done = spark.createDataFrame([("r.docx",)], "file string")
    assert documents.read_reports(spark, str(tmp_path), done).count() == 0


def test_record_files_and_stores(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"file_name": "B", "failure_mode": "x", "severity": 3, "function": "f"}, {"failure_mode": "y"}]')
    (tmp_path / "a.json").write_text('{"failure_mode": "z"}')
    got = sorted((r.file_ord, r.file_name, r.row_ord, r.failure_mode, r.severity, r.function_name) for r in files.read_records(spark, str(tmp_path)).collect())
    assert got == [(0, "a", 0, "z", None, None), (1, "B", 0, "x", "3", "f"), (1, "B", 1, "y", None, None)]
    (tmp_path / "s.store").write_text('{"k1": {"v": 1}, "k2": {"v": 2}}')
    assert {(r.id, r.v) for r in files.read_store(spark, str(tmp_path / "s.store"), "v:int").collect()} == {("k1", 1), ("k2", 2)}
    (tmp_path / "i.csv").write_text("A;B;C;D;E;F\n1;4711;name.doc;8D report;x;N:\\q\n2;5;PFMEA x;FMEA;x;N:\\q\n3;6;d;Design FMEA;x;C:\\q\n", encoding="utf-8-sig")
    assert [(r.number, r.kind) for r in files.read_inventory(spark, str(tmp_path / "i.csv")).collect()] == [("4711", "8D")]
    wanted = spark.createDataFrame([("12-345678-9",), ("999",)], "number string")
    listing = spark.createDataFrame([("8D12345678_x.docx",), ("8D12345678_y.doc",), ("8D00000000.doc",), ("other.doc",)], "file string")
    assert {(r.number, r.file) for r in files.match_8d(wanted, listing).collect()} == {("12-345678-9", "8D12345678_y.doc"), ("999", "8D00000000.doc")}


def test_streams(spark, tmp_path):
    schema = "file_ord int, file_name string, row_ord int, source_type string, failure_mode string, failure_effect string, failure_cause string, failure_type string"
    rows = [(f, f"f{f}", n, "old_fmea", f"m{n % 3}", "e", f"c{n}", "Mechanics") for f in range(3) for n in range(5)]
    for f in range(3):
        spark.createDataFrame([r for r in rows if r[0] == f], schema).write.parquet(str(tmp_path / f"in/{f}"))
    stream = incremental.read_records_stream(spark, str(tmp_path / "in/*"), schema, files=1)
    incremental.ingest_stream(stream, str(tmp_path / "kb"), str(tmp_path / "cp")).awaitTermination()
    failures, causes = ingest.ingest(spark.createDataFrame(rows, schema))
    kept, kept_causes = incremental.read_store(spark, str(tmp_path / "kb"))
    assert {r.failure_id for r in kept.collect()} == {r.failure_id for r in failures.collect()}
    assert {r.cause_id for r in kept_causes.collect()} == {r.cause_id for r in causes.collect()}
    events = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events*.parquet")
    q = incremental.windowed_counts(events).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = incremental.windowed_counts(spark.read.parquet(f"{SF}/events.parquet"))
    streamed, counted = (sorted((str(r.start), r.event_type, r.n, round(r.total, 3)) for r in d.collect()) for d in (spark.table("counts"), batch))
    assert streamed == counted


def test_require_valid_names_the_case(spark):
    from faultline.operators import eightd
    from faultline.plans.fixtures import cases

    good = cases(spark, SF)
    assert eightd.require_valid(good) is good
    with pytest.raises(ValueError, match="case 3: missing documents"):
        eightd.require_valid(good.withColumn("documents", F.when(F.col("file_ord") != 3, F.col("documents"))))


def test_broken_line_ends_the_job(spark, tmp_path):
    from faultline.sources import files

    (tmp_path / "a.json").write_text('{"a": "x"}\n\n{"a": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_lines(spark, str(tmp_path), "a string").collect()


def test_retrieval_pairs_last_wins_and_empty_is_an_error(spark):
    from faultline.operators import quality

    a = spark.createDataFrame([(1, 1, "old", 0), (1, 1, "new", 1), (2, 1, "x", 0)], "failure_id int, cause_id int, q string, n int")
    b = spark.createDataFrame([(1, 1, "r", 0)], "failure_id int, cause_id int, q string, n int")
    rows = quality.retrieval_pairs(a, b, order="n").select("failure_id", F.col("o.q").alias("o"), F.col("r.q").alias("r")).collect()
    assert [tuple(r) for r in rows] == [(1, "new", "r")]
    with pytest.raises(ValueError):
        quality.retrieval_pairs(a, b.limit(0))


def test_report_with_an_empty_check(spark, tmp_path):
    from faultline.operators import quality

    found = spark.createDataFrame([(1, "bad")], "id int, message string")
    rows = quality.written_report({"some": found, "none": found.limit(0)}, str(tmp_path / "report")).collect()
    assert sorted((r["check"], r["message"]) for r in rows) == [("none", None), ("some", "1: bad")]


def test_clashing_names_end_an_ingest(spark):
    from faultline.operators import ingest

    rows = spark.createDataFrame([(0, "same", 0, "new_fmea", "m"), (1, "same", 0, "new_fmea", "n")], "file_ord int, file_name string, row_ord int, source_type string, failure_mode string")
    with pytest.raises(ValueError, match="same"):
        ingest.ingest(rows)


def test_projection_histogram_against_numpy(spark):
    import numpy as np

    from faultline.plans.fixtures import kb_vec

    rows = kb_vec(spark, SF).collect()
    x = np.array([r.embedding for r in rows], float)
    x -= x.mean(0)
    axis = np.linalg.svd(x, full_matrices=False)[2][0]
    got = {}
    for r in queries.QUERIES["projection_histogram"](spark, SF).orderBy("bin").collect():
        got.setdefault(r.role, []).append(r.n)
    for role, counts in got.items():
        want = np.histogram([v @ axis for v, r in zip(x, rows) if r.role == role], 50)[0].tolist()
        # The sign of a component is free.
        assert counts in (want, want[::-1])
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", None), ("b", float("nan"))], "g string, v double")
    flat = vectors.histogram(df, "v", "g", 4).orderBy("bin").collect()
    assert [(r.g, r.low, r.n) for r in flat] == [("a", 1.5, 0), ("a", 1.75, 0), ("a", 2.0, 2), ("a", 2.25, 0)]


def test_own_neighbours_are_those_of_the_whole_scan(spark):
    from faultline.plans.fixtures import kb_vec

    v = kb_vec(spark, SF)
    whole = vectors.nearest(v, 4).where("own = other").select("vec_id", "neighbour").collect()
    for block in (4000, 30):
        assert set(vectors.nearest_of_own(v, 4, block=block).select("vec_id", "neighbour").collect()) == set(whole)


def test_accuracy_without_pairs_is_an_error(spark):
    empty = spark.createDataFrame([], "truth int, original_ids array<int>, rephrased_ids array<int>")
    with pytest.raises(Exception, match="no key in common"):
        quality.retrieval_accuracy(empty).collect()


def test_role_digests_without_lists(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(vectors, "RUN", 3, raising=False)
    rows = [(f"f{n % 3}", ("failure", "failure", "cause", "effect")[n % 4], f"s{n * 37 % 101}") for n in range(101)] + [("only", "cause", "c")]
    s = spark.createDataFrame(rows, "file_name string, role string, sentence_id string")
    lists = vectors.role_index(s).select("file_name", F.size("failure_ids"), F.size("cause_ids"), F.size("effect_ids"), F.when(F.size("failure_ids") > 0, F.md5(F.array_join("failure_ids", ","))))
    assert sorted(map(tuple, vectors.role_digests(s).collect())) == sorted(map(tuple, lists.collect()))


def test_scans_fill_wide_blocks(spark, monkeypatch):
    import numpy as np

    from pyspark.sql import functions as F

    for name, value in (("BLOCK", 10), ("SIDES", 2), ("WIDE", 40), ("STRIP", 7)):
        monkeypatch.setattr(vectors, name, value, raising=False)
    x = np.random.default_rng(3).normal(size=(100, 6)).astype(np.float32)
    rows = [(n // 3, ("failure_mode", "failure_element", "failure_effect")[n % 3], n, [float(v) for v in x[n]]) for n in range(100)]
    v = spark.createDataFrame(rows, "failure_id long, role string, vec_id long, embedding array<float>")
    found = vectors.nearest(v, 2)
    assert "sequence(0, 2," in found._jdf.queryExecution().analyzed().toString(), "each vector is sent to a hundred vectors' ten blocks"
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(2)
    want = {(a, rows[b][1], b) for a in range(100) for g in range(3) for b in sorted(range(g, 100, 3), key=lambda b: (d[a, b], b))[:2]}
    assert {(r.vec_id, r.other, r.neighbour) for r in found.collect()} == want
    near = vectors.near_duplicate_failures(v, threshold=0.3, block=12).select("failure_a", "failure_b", F.round("score", 3).alias("s")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    weight = [vectors.ROLE_WEIGHTS[rows[n][1]] for n in range(3)]
    score = lambda a, b: sum(w * float(unit[3 * a + n] @ unit[3 * b + n]) for n, w in enumerate(weight) if 3 * max(a, b) + n < 100)
    assert {(r.failure_a, r.failure_b) for r in near} == {(a, b) for a in range(34) for b in range(a + 1, 34) if score(a, b) >= 0.3} and near
