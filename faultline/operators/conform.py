"""JSON texts held against a declared schema: what is missing, of another type, null or unknown, each with its path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

_FAULT = "array<struct<path: string, fault: string, expected: string, found: string>>"
#: Kinds of values that a declared type takes; other scalar types can't be declared.
_TAKES = {
    t.StringType: ("STRING",), t.BooleanType: ("BOOLEAN",), t.LongType: ("BIGINT",), t.IntegerType: ("BIGINT",),
    t.DoubleType: ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), t.DecimalType: ("BIGINT", "DECIMAL"),
}


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _named(declared: t.DataType) -> str:
    return {t.StructType: "OBJECT", t.MapType: "OBJECT", t.ArrayType: "ARRAY"}.get(type(declared)) or declared.simpleString().upper()


def _one(path: Column, fault: str, expected: str, found: Column) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(fault).alias("fault"), F.lit(expected).alias("expected"), found.alias("found"))).cast(_FAULT)


_NONE = lambda: F.array().cast(_FAULT)
_NOTHING = lambda: F.lit(None).cast("string")


def _check(value: Column, declared: t.DataType, nullable: bool, path: Column, missing: bool) -> Column:
    """Faults of a variant; missing: SQL null means that an object has no such field."""

    def inside(v: Column, kind: Column) -> Column:
        if isinstance(declared, t.StructType):
            return _bound(F.try_variant_get(v, "$", "map<string,variant>"), lambda fields: _fields(fields, declared, path))
        if isinstance(declared, t.MapType):
            pairs = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
            found = F.flatten(F.transform(pairs, lambda p: _check(p["value"], declared.valueType, declared.valueContainsNull, _field(path, p["key"]), False)))
            return F.array_sort(found)
        if isinstance(declared, t.ArrayType):
            items = F.try_variant_get(v, "$", "array<variant>")
            return F.flatten(F.transform(items, lambda x, i: _check(x, declared.elementType, declared.containsNull, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), False)))
        return _NONE()

    takes = ("OBJECT",) if isinstance(declared, (t.StructType, t.MapType)) else ("ARRAY",) if isinstance(declared, t.ArrayType) else _TAKES.get(type(declared))
    if takes is None and not isinstance(declared, t.VariantType):
        raise ValueError(f"JSON holds no values of type {declared.simpleString()}")

    def judged(v: Column) -> Column:
        kind = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
        right = F.lit(True) if takes is None else kind.isin(*takes)
        absent = _NONE() if nullable and missing else _one(path, "missing", _named(declared), _NOTHING())
        null = _NONE() if nullable else _one(path, "null", _named(declared), F.lit("NULL"))
        return F.when(v.isNull(), absent).when(F.is_variant_null(v), null).when(right, inside(v, kind)).otherwise(_one(path, "type", _named(declared), kind))

    return _bound(value, judged)


def _field(path: Column, name: Column) -> Column:
    """The path of a field: plain names behind a dot, others quoted in brackets."""
    quoted = F.concat(F.lit("['"), F.replace(name, F.lit("'"), F.lit("\\'")), F.lit("']"))
    return F.concat(path, F.when(F.rlike(name, F.lit("^[A-Za-z_][A-Za-z0-9_]*$")), F.concat(F.lit("."), name)).otherwise(quoted))


def _fields(fields: Column, declared: t.StructType, path: Column) -> Column:
    known = [_check(F.try_element_at(fields, F.lit(f.name)), f.dataType, f.nullable, _field(path, F.lit(f.name)), True) for f in declared.fields]
    others = F.array_sort(F.array_except(F.map_keys(fields), F.array(*[F.lit(n) for n in declared.names]).cast("array<string>")))
    unknown = F.transform(others, lambda n: F.struct(_field(path, n).alias("path"), F.lit("unknown").alias("fault"), _NOTHING().alias("expected"), F.regexp_extract(F.schema_of_variant(fields[n]), "^[A-Z]+", 0).alias("found")))
    return F.concat(*known, unknown.cast(_FAULT))


def faults_of(text: Column, schema: t.DataType) -> Column:
    """The faults of one JSON text as an array of (path, fault, expected, found), in the order of the schema, then of names and places."""
    parsed = F.try_parse_json(text)
    broken = _one(F.lit("$"), "broken", _named(schema), _NOTHING())
    return F.when(text.isNotNull() & parsed.isNull(), broken).otherwise(_check(parsed, schema, False, F.lit("$"), False))


def faults(rows: DataFrame, key: str, text: str, schema: str | t.DataType) -> DataFrame:
    """(key, path, fault, expected, found): each way in which the JSON texts of rows differ from a schema; one narrow pass.

    The schema is a type or its DDL. Faults: `missing` (a field that may not be null is not there, or the text is null), `null` (it is there, but null),
    `type` (a value of another kind), `unknown` (a field that is not declared), `broken` (no JSON, or a name twice in one object). Fields that may be null
    may also be absent. Whole numbers count as doubles and decimals, not the other way round; nothing is cast, so "1" is no number.
    Inside a value of a wrong kind nothing more is looked for. VARIANT takes all. Rows without a fault give no row; repeated rows and null keys count each.
    """
    declared = t._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return rows.select(F.col(key).alias(key), F.inline(faults_of(F.col(text), declared)))


def conforming(rows: DataFrame, text: str, schema: str | t.DataType) -> DataFrame:
    """The rows whose text has no fault, all columns kept."""
    declared = t._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return rows.where(F.size(faults_of(F.col(text), declared)) == 0)
