"""Numbers and fills over parts, against plain loops."""

import random

import pytest

from faultline.operators import ordered


def _rows(n, groups):
    draw = random.Random(n)
    # A group of null and one that holds most rows, over all parts.
    return [(draw.choice([None, "hot", "hot", "hot", *groups]), i, draw.choice([None, None, None, f"v{i}"]), "x") for i in range(n)]


SCHEMA = "g string, i int, v string, number string"


@pytest.mark.parametrize("by", [["g"], None])
def test_numbers_and_fills_over_parts(spark, by):
    data = _rows(3_000, ["a", "b", "c"])
    rows = spark.createDataFrame(random.Random(2).sample(data, len(data)), SCHEMA)
    count, last, want = {}, {}, {}
    for g, i, v, _ in data:
        k = g if by else ""
        last[k] = v if v is not None else last.get(k)
        want[i] = (count.get(k, 0), last[k])
        count[k] = count.get(k, 0) + 1
    got = {r.i: r.number for r in ordered.numbered(rows, ["i"], by, parts=13).collect()}
    full = {r.i: (r.v, r.full, r.number) for r in ordered.filled(rows, "v", ["i"], by, "full", parts=13).collect()}
    assert got == {i: n for i, (n, _) in want.items()}
    assert full == {i: (v, want[i][1], "x") for _, i, v, _ in data}
    assert {r.i: r.v for r in ordered.filled(rows, "v", ["i"], by, parts=5).collect()} == {i: w for i, (_, w) in want.items()}


def test_a_hot_group_lies_in_many_parts(spark):
    rows = spark.createDataFrame(_rows(3_000, []), SCHEMA)
    parts = {r._part: r["count"] for r in ordered.spread(rows, ["i"], ["g"], parts=12).where("g = 'hot'").groupBy("_part").count().collect()}
    assert len(parts) > 5 and max(parts.values()) < 1_000


def test_equal_rows_and_no_rows(spark):
    same = spark.createDataFrame([(None, 1, "v", "x")] * 7 + [("a", None, None, "x")], SCHEMA)
    assert sorted((r.g or "", r.number) for r in ordered.numbered(same, ["i"], ["g"], parts=4).collect()) == [*[("", n) for n in range(7)], ("a", 0)]
    assert [r.v for r in ordered.filled(same.where("g = 'a'"), "v", ["i"], ["g"]).collect()] == [None]
    assert ordered.numbered(same.limit(0), ["i"]).collect() == [] and ordered.filled(same.limit(0), "v", ["i"], ["g"]).collect() == []
