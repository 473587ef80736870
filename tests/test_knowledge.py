"""The kept knowledge base: increments against one ingest of all files, versions, folders, graph upserts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import graph, ingest
from faultline.operators.knowledge import KnowledgeBase
from faultline.sources import folders
from faultline.sources import store as stores
from faultline.sources.store import Store
from faultline.streaming import incremental

from .test_engine import make_workbook
from faultline.sources import workbook

SCHEMA = "file_ord int, file_name string, row_ord int, source_type string, system_name string, system_element string, function_name string, failure_type string, failure_mode string, failure_effect string, failure_cause string, severity string"


def records(seed, files=6, n=25):
    r = random.Random(seed)
    out = []
    for file in range(files):
        for i in range(n):
            new = r.random() < 0.5
            out.append((file, f"f{file}", i, "new_fmea" if new else "old_fmea", r.choice(["s", "S.", None]) if new else None, r.choice(["e", ""]) if new else None, r.choice(["g", "h"]) if new else None, None if new else r.choice(["Pump / Impeller", "Mechanics", None]), r.choice(["fails", "Fails", "fails.", "stuck", f"m{file % 3}"]), r.choice(["stop", None, ""]), r.choice(["dust", "Dust", "wear.", "", None, f"c{file}"]), r.choice(["3", "7", "n/a", None, "x"])))
    return out


def content(failures, causes):
    f = {r.failure_id: (r.failure_mode, r.failure_element, r.failure_effect, r.system, r.severity, tuple(r.cause_ids)) for r in failures.collect()}
    return f, {r.cause_id: (r.failure_id, r.failure_cause, r.failure_mode, r.discipline) for r in causes.collect()}


def edges_and_nodes(g):
    return {tuple(r) for r in g.edges.select("src", "rel", "dst").collect()}, {(r.id, r.label, tuple(sorted(r.props.items(), key=str))) for r in g.nodes.collect()}


def test_increments_equal_one_ingest(spark, tmp_path):
    rows = records(1)
    want = ingest.ingest(spark.createDataFrame(rows, SCHEMA))
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    for files in ((0, 1), (2,), (3, 4, 5)):
        kb.add(spark.createDataFrame([r for r in rows if r[0] in files], SCHEMA))
    assert content(kb.failures(), kb.causes()) == content(*want)
    assert edges_and_nodes(kb.graph()) == edges_and_nodes(graph.Graph.from_causes(want[1]))
    assert kb.store.version() == 3 and kb.failures(1).count() < kb.failures(3).count()
    assert {r.sentence_id for r in kb.sentences().collect()} == {r.sentence_id for r in ingest.sentences_of(spark.createDataFrame(rows, SCHEMA)).collect()}
    with pytest.raises(ValueError, match="f2"):
        kb.add(spark.createDataFrame([r for r in rows if r[0] == 2], SCHEMA))
    with pytest.raises(ValueError, match="named f0"):
        kb.add(spark.createDataFrame([(9, "f0", *rows[0][2:]), (10, "f0", *rows[0][2:])], SCHEMA))
    assert kb.store.version() == 3
    kb.rebuild(kb.store.read("records"))
    assert content(kb.failures(), kb.causes()) == content(*want)


def test_streamed_batches_once_each(spark, tmp_path):
    rows = records(3, files=2)
    for f in range(2):
        spark.createDataFrame([r for r in rows if r[0] == f], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{f}"))
    base, check = str(tmp_path / "kb"), str(tmp_path / "cp")
    stream = lambda: incremental.ingest_stream(incremental.read_records_stream(spark, str(tmp_path / "in/*"), SCHEMA, files=1), base, check)
    stream().awaitTermination()
    store = Store(spark, base)
    assert store.version() == 2
    # The last batch's commit is lost: it is run again, and changes nothing.
    for name in ("1", ".1.crc"):
        os.remove(os.path.join(check, "commits", name))
    stream().awaitTermination()
    assert store.version() == 2
    failures, causes = incremental.read_store(spark, base)
    order = {r.file_name: r.file_ord for r in store.read("files").collect()}
    again = spark.createDataFrame([(order[r[1]], *r[1:]) for r in rows], SCHEMA)
    assert content(failures, causes) == content(*ingest.ingest(again))


def test_a_look_up_reads_no_more_of_a_larger_table(spark, tmp_path, monkeypatch):
    """The rows that one key's look-up reads do not grow with the table; a batch of known keys writes no failure anew."""
    monkeypatch.setattr(stores, "PART_ROWS", 50)
    read = {}
    for size in (200, 1600):
        store = Store(spark, str(tmp_path / f"s{size}"))
        store.commit({"t": spark.range(size).selectExpr("id", "md5(cast(id AS string)) AS v")}, keys={"t": ["id"]})
        only = store.touched("t", spark.range(7, 8).toDF("id"))
        read[size] = store.read("t", only=only).count()
        assert len(only) == 1 and store.read("t", only=only).where("id = 7").count() == 1 and store.table("t").rows == size
    assert 0 < read[1600] <= 75 and 0 < read[200] <= 75
    monkeypatch.undo()
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    one = lambda name: spark.createDataFrame([(0, name, 0, "old_fmea", None, None, None, "Mechanics", "stuck", "stop", "dust", "3")], SCHEMA)
    kb.add(one("a"))
    before = {t: kb.store.table(t).live for t in ("failures", "causes", "nodes", "edges")}
    kb.add(one("b"))
    assert {t: kb.store.table(t).live for t in before} == before and kb.failures().count() == 1


def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    rows = records(4, files=2)
    kb.add(spark.createDataFrame([r for r in rows if r[0] == 0], SCHEMA))
    before = content(kb.failures(), kb.causes())

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", crash)
        with pytest.raises(RuntimeError, match="lost"):
            kb.add(spark.createDataFrame([r for r in rows if r[0] == 1], SCHEMA))
    assert content(kb.failures(), kb.causes()) == before and kb.store.version() == 1
    assert os.listdir(tmp_path / "kb/_staged") == []
    kb.add(spark.createDataFrame([r for r in rows if r[0] == 1], SCHEMA))
    assert content(kb.failures(), kb.causes()) == content(*ingest.ingest(spark.createDataFrame(rows, SCHEMA)))
    assert kb.store.vacuum(keep=1) > 0
    assert content(kb.failures(), kb.causes()) == content(*ingest.ingest(spark.createDataFrame(rows, SCHEMA)))
    # Two writers of one version: the second fails.
    state = kb.store.state()
    with pytest.raises(RuntimeError, match="another writer"):
        kb.store._publish(state["version"], {}, {})


def test_store_replaces_touched_partitions_only(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    table = lambda rows: spark.createDataFrame(rows, "id int, kind string, v string")
    store.commit({"t": table([(i, "a" if i % 2 else "b", "old") for i in range(40)])}, keys={"t": ["id"]}, by={"t": ["kind"]})
    first = store.table("t")
    new = table([(3, "a", "new")])
    only = store.touched("t", new)
    assert len(only) == 1 and only[0].startswith("kind=a/")
    kept = store.read("t", only=only)
    store.commit(replaced={"t": kept.where("id <> 3").unionByName(new)})
    second = store.table("t")
    assert {p for p in first.live if first.live[p] != second.live[p]} == set(only)
    assert {(r.id, r.v) for r in store.read("t").collect()} == {(i, "new" if i == 3 else "old") for i in range(40)}
    assert {r.v for r in store.read("t", version=1).collect()} == {"old"}
    # Many small batches are written as one.
    monkeypatch.setattr(stores, "MOST_BATCHES", 2)
    for i in range(4):
        store.commit({"t": table([(100 + i, "a", "late")])})
    assert max(len(b) for b in store.table("t").live.values()) <= 3 and store.read("t").count() == 44
    assert store.read("t", only=[]).count() == 0
    with pytest.raises(ValueError):
        store.read("none")


def test_graph_upserts(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    nodes = lambda *rows: spark.createDataFrame(rows, "id string, label string, props map<string,string>")
    edges = lambda *rows: spark.createDataFrame(rows, "src string, rel string, dst string")
    kb.upsert_graph(nodes(("a", "X", {"k": "1", "m": "2"}), ("b", "Y", {"q": "0"})), edges(("a", "r", "b")))
    kb.upsert_graph(nodes(("a", "X", {"k": "9"}), ("c", "Z", {"q": "1"})), edges(("a", "r", "b"), ("a", "s", "c"), ("a", "s", "c")))
    assert edges_and_nodes(kb.graph()) == ({("a", "r", "b"), ("a", "s", "c")}, {("a", "X", (("k", "9"), ("m", "2"))), ("b", "Y", (("q", "0"),)), ("c", "Z", (("q", "1"),))})
    assert edges_and_nodes(kb.graph(1))[0] == {("a", "r", "b")}


def book(path, cause, mode="open"):
    old = {"E2": "Fan", "J3": "2020", "B6": "Process Step", "C6": "Potential Failure Mode", "D6": "Potential Effect(s) of Failure", "F6": "Potential Cause(s) of Failure"}
    make_workbook(path, {"FMEA": old | {"B7": "Motor/ Connectors", "C7": mode, "D7": "silent", "F7": cause}})


def test_folder_to_base(spark, tmp_path, monkeypatch):
    folder, base = tmp_path / "in", str(tmp_path / "kb")
    folder.mkdir()
    book(folder / "b.xlsx", "dust")
    book(folder / "c.xlsx", "wear")
    (folder / "broken.xlsx").write_bytes(b"no workbook")
    first = folders.update_base(spark, str(folder), base)
    assert (first["version"], first["new"], first["broken"]) == (1, ["b", "broken", "c"], ["broken"])
    kb = KnowledgeBase(spark, base)
    causes = lambda: {(r.cause_id, r.failure_cause) for r in kb.causes().collect()}
    assert causes() == {("b__F1_C1", "dust"), ("b__F1_C2", "wear")}

    def unread(*_):
        raise AssertionError("a workbook was read")

    with monkeypatch.context() as m:
        m.setattr(folders, "read_fmea", unread)
        m.setattr(folders, "digests_of", unread)
        assert folders.update_base(spark, str(folder), base) == {"version": 1, "new": [], "changed": [], "gone": [], "broken": []}
    # A new file, although first by name, is merged as a later one.
    book(folder / "a.xlsx", "rust")
    assert folders.update_base(spark, str(folder), base)["new"] == ["a"]
    assert causes() == {("b__F1_C1", "dust"), ("b__F1_C2", "wear"), ("b__F1_C3", "rust")}
    # A changed file replaces its own records and keeps its place.
    book(folder / "b.xlsx", "shock")
    read = []
    with monkeypatch.context() as m:
        m.setattr(folders, "read_fmea", lambda s, paths: read.extend(p.rsplit("/", 1)[1] for p in paths) or workbook.read_fmea(s, paths))
        assert folders.update_base(spark, str(folder), base)["changed"] == ["b"]
    assert read == ["b.xlsx"]
    assert causes() == {("b__F1_C1", "shock"), ("b__F1_C2", "wear"), ("b__F1_C3", "rust")}
    os.remove(folder / "b.xlsx")
    assert folders.update_base(spark, str(folder), base)["gone"] == ["b"]
    assert causes() == {("c__F1_C1", "wear"), ("c__F1_C2", "rust")}
    assert folders.update_base(spark, str(folder), base)["version"] == 4
    # The same content under another time of change is the same file.
    os.utime(folder / "c.xlsx", (1, 1))
    assert folders.update_base(spark, str(folder), base)["version"] == 4
