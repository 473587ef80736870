"""Schema faults of JSON texts, against planted ones and a plain walk."""

import json
import random

import pytest
from pyspark.sql import types as t

from faultline.operators import conform
from faultline.operators.eightd import CASE_SCHEMA

SCHEMA = t.StructType([
    t.StructField("k", t.LongType(), False),
    t.StructField("device", t.StructType([t.StructField("os", t.StringType(), False), t.StructField("ver", t.DoubleType())])),
    t.StructField("tags", t.ArrayType(t.StringType(), False)),
    t.StructField("by name", t.MapType(t.StringType(), t.BooleanType(), True)),
    t.StructField("any", t.VariantType()),
])


def plain(text):
    """The same rules over Python's own parser."""
    kinds = lambda v: {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", int: "BIGINT", float: "DECIMAL"}[type(v)]
    out = []

    def field(path, n):
        return f"{path}.{n}" if n.replace("_", "a").isalnum() and not n[0].isdigit() else f"{path}['{n}']"

    def walk(v, d, nullable, path):
        if isinstance(d, t.VariantType):
            return
        name = {t.StructType: "OBJECT", t.MapType: "OBJECT", t.ArrayType: "ARRAY", t.LongType: "BIGINT"}.get(type(d)) or d.simpleString().upper()
        if v is None:
            out.extend([] if nullable else [(path, "null", name, "NULL")])
            return
        takes = {"DOUBLE": ("BIGINT", "DECIMAL")}.get(name, (name,))
        if kinds(v) not in takes:
            out.append((path, "type", name, kinds(v)))
        elif isinstance(d, t.StructType):
            for f in d.fields:
                if f.name in v:
                    walk(v[f.name], f.dataType, f.nullable, field(path, f.name))
                elif not f.nullable:
                    n = {t.LongType: "BIGINT"}.get(type(f.dataType)) or f.dataType.simpleString().upper()
                    out.append((field(path, f.name), "missing", n, None))
            out.extend((field(path, n), "unknown", None, "NULL" if v[n] is None else kinds(v[n])) for n in sorted(set(v) - set(d.names)))
        elif isinstance(d, t.ArrayType):
            for i, x in enumerate(v):
                walk(x, d.elementType, d.containsNull, f"{path}[{i}]")
        elif isinstance(d, t.MapType):
            for n in sorted(v):
                walk(v[n], d.valueType, d.valueContainsNull, field(path, n))

    if text is None:
        return [("$", "missing", "OBJECT", None)]
    try:
        value = json.loads(text)
    except ValueError:
        return [("$", "broken", "OBJECT", None)]
    walk(value, SCHEMA, False, "$")
    return out


def _texts():
    draw = random.Random(4)
    scalar = lambda: draw.choice([None, 1, 2.5, "x", "1", True, [], {}, [1, None, "a"], {"os": "o"}])
    made = [None, "", "{", "null", "[]", "3", '"x"', '{"k": 1}', '{"k": null}', '{"k": 1, "k": 2}', '{"k": 1.5}', '{"k": "1"}']
    for _ in range(150):
        device = draw.choice([scalar(), {"os": scalar(), "ver": scalar(), **({"z": scalar()} if draw.random() < 0.3 else {})}])
        full = {"k": scalar(), "device": device, "tags": draw.choice([scalar(), ["a", scalar()]]), "by name": draw.choice([scalar(), {"a b": scalar(), "c": True}]), "any": scalar(), "more": scalar()}
        made.append(json.dumps({n: v for n, v in full.items() if draw.random() < 0.7}))
    return made


def test_faults_are_those_of_a_plain_walk(spark):
    texts = _texts()
    rows = spark.createDataFrame([(i, x, "p", "f") for i, x in enumerate(texts)], "id int, text string, path string, fault string")
    got = {}
    for r in conform.faults(rows, "id", "text", SCHEMA).collect():
        got.setdefault(r.id, []).append((r.path, r.fault, r.expected, r.found))
    twice = texts.index('{"k": 1, "k": 2}')
    assert got.pop(twice) == [("$", "broken", "OBJECT", None)]
    sort = lambda rows: sorted(rows, key=lambda x: tuple(map(str, x)))
    for i, x in enumerate(texts):
        if i != twice:
            assert sort([(p, f, e, {"VOID": "NULL", "DOUBLE": "DECIMAL"}.get(n, n)) for p, f, e, n in got.get(i, [])]) == sort(plain(x)), x
    fine = {r.id for r in conform.conforming(rows, "text", SCHEMA).collect()}
    assert fine == {i for i in range(len(texts)) if i not in got and i != twice} and 0 < len(fine) < len(texts)
    assert conform.faults(rows.limit(0), "id", "text", SCHEMA).collect() == []


def test_case_files_with_one_fault_of_each_kind(spark):
    sound = {"documents": [{"file_name": "a", "product_name": None, "date": "x"}], "failure": {"failure_ID": "F1", "root_causes": [{"cause_ID": "C1", "supporting_entities": [{"sentence_id": "s", "annotations": {"faithful_score": 3}}]}]}}
    change = lambda f: (lambda c: (f(c), json.dumps(c))[1])(json.loads(json.dumps(sound)))
    cases = [
        ("fine", json.dumps(sound)), ("extra", change(lambda c: c["failure"].update(note=1))), ("kind", change(lambda c: c["failure"].update(root_causes="none"))),
        ("deep", change(lambda c: c["failure"]["root_causes"][0]["supporting_entities"][0]["annotations"].update(faithful_score="3"))), ("cut", json.dumps(sound)[:-5]), ("gone", change(lambda c: c.pop("failure"))),
    ]
    schema = conform.t._parse_datatype_string(CASE_SCHEMA)
    schema = t.StructType([t.StructField(f.name, f.dataType, f.name != "failure") for f in schema.fields])
    got = {(r.file, r.path, r.fault) for r in conform.faults(spark.createDataFrame(cases, "file string, text string"), "file", "text", schema).collect()}
    assert got == {
        ("extra", "$.failure.note", "unknown"), ("kind", "$.failure.root_causes", "type"), ("cut", "$", "broken"), ("gone", "$.failure", "missing"),
        ("deep", "$.failure.root_causes[0].supporting_entities[0].annotations.faithful_score", "type"),
    }


def test_types_that_json_has_not(spark):
    with pytest.raises(ValueError, match="date"):
        conform.faults(spark.createDataFrame([("{}",)], "text string"), "text", "text", "d date")
