"""Query 13 against pairs of all with all."""

import math
import random
import zlib

from faultline.llm import bands, queries

LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, vendor_id long, p int, bucket string, u string"
ITEMS = "item_id long, price double, n int, lines string"


def plain(lines, items, absolute=10, per_mille=2, first=5):
    cents = lambda x: math.floor(100.0 * x + 0.5)
    out = []
    for item, price in items:
        pairs = []
        for sale, line, other, quantity, amount in lines:
            if None in (sale, other, quantity, amount, item, price) or not quantity or not math.isfinite(amount) or not math.isfinite(price) or other == item:
                continue
            p, u = cents(price), (2 * cents(amount) + quantity) // (2 * quantity)
            gap = abs(u - p)
            if gap <= absolute or 1000 * gap <= per_mille * p:
                text = f"{sale},{'' if line is None else line},{other}"
                pairs.append(((gap, u, sale, line is None, line or 0, other), line, zlib.crc32(text.encode())))
        pairs.sort(key=lambda x: x[0])
        sums = len(pairs), sum(x[0][0] for x in pairs), sum(x[2] for x in pairs)
        out += [(item, k + 1, x[0][0], x[0][1], x[0][2], x[1], x[0][5], *sums) for k, x in enumerate(pairs[:first])] or [(item, 0, None, None, None, None, None, 0, 0, 0)]
    return out


def _check(spark, lines, items, **more):
    a = spark.createDataFrame([(*x, 7, 1, "b", "u") for x in lines], LINES)
    b = spark.createDataFrame([(*x, 1, "l") for x in items], ITEMS)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in bands.near_prices(a, b, **more).collect()), key=key)
    assert got == sorted(plain(lines, items, **more), key=key)
    return got


def test_random_tables(spark):
    draw = random.Random(3)
    price = lambda: round(draw.choice([draw.uniform(0, 3), draw.uniform(49, 52), draw.uniform(300, 302), 100.0, 250.0]), 2)
    items = [(i, price()) for i in range(150)]
    lines = []
    for _ in range(1500):
        q = draw.choice([1, 1, 2, 3, 7, 50])
        lines.append((draw.randrange(300), draw.randrange(1, 4), draw.choice([7, 7, draw.randrange(160)]), q, round(price() * q * draw.uniform(0.999, 1.001), 2)))
    _check(spark, lines + lines[:200], items)
    got = _check(spark, lines, items, first=400)
    assert any(r[2] is not None and r[2] > 10 for r in got)
    _check(spark, lines, items, absolute=3, per_mille=25, first=2)


def test_broken_rows_ties_and_repeats(spark):
    lines = [(1, 1, 1, 1, 5.0), (1, 1, 2, 1, 5.0), (1, 1, 2, 1, 5.0), (1, None, 2, 1, 5.0), (1, 2, 2, 1, 5.0), (None, 1, 2, 1, 5.0), (2, 1, None, 1, 5.0), (2, 1, 3, None, 5.0), (2, 1, 3, 1, None)]
    lines += [(3, 1, 3, 0, 5.0), (3, 1, 3, 1, float("nan")), (3, 1, 3, 1, float("inf")), (4, 1, 4, -2, 10.0), (5, 1, 5, 2, -10.0), (6, 1, 6, 3, 0.0)]
    items = [(1, 5.0), (1, 5.0), (1, 5.05), (2, 5.0), (None, 5.0), (9, None), (8, float("nan")), (7, 900.0), (5, 0.02), (6, -5.0)]
    _check(spark, lines, items)


def test_one_items_lines_do_not_hide_the_others(spark):
    lines = [(s, 1, 7, 1, 100.0 + s % 7 / 100) for s in range(60)] + [(1000 + s, 1, s, 1, 100.19 + s / 100) for s in range(9)]
    _check(spark, lines, [(7, 100.0), (3, 100.0), (8, 100.02), (99, 100.2)])


def test_all_lines_of_one_item(spark):
    _check(spark, [(s, 1, 7, 1, 400.0 + s / 100) for s in range(-90, 90)], [(7, 400.0), (3, 400.0), (4, 399.3)])


def test_empty_tables(spark):
    assert _check(spark, [], [(1, 5.0)]) == [(1, 0, None, None, None, None, None, 0, 0, 0)]
    assert _check(spark, [(1, 1, 1, 1, 5.0)], []) == []


def test_bands_are_joined_by_bucket_once_each(spark):
    left = spark.createDataFrame([(p,) for p in (-40, 0, 9, 4999, 5000, 5001, 12345, 10**9)], "p long")
    right = spark.createDataFrame([(u,) for u in [*range(-60, 60), *range(4980, 5030), *range(12300, 12400), *range(10**9 - 2_000_050, 10**9 + 2_000_050, 7)]], "u long")
    near, far = bands.band_pairs(left, right)
    got = sorted((r.p, r.u) for d in (near, far) for r in d.collect())
    us = [r.u for r in right.collect()]
    assert got == sorted((p, u) for (p,) in left.collect() for u in us if abs(u - p) <= 10 or 1000 * abs(u - p) <= 2 * p)
    plan = far._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_query_13_gives_every_item(spark):
    sf = "/root/testdata/sf0.001"
    lines = [tuple(r) for r in spark.read.parquet(f"{sf}/sale_lines.parquet").select("sale_id", "line_no", "item_id", "quantity", "amount").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/items.parquet").select("item_id", "price").collect()]
    got = {tuple(r) for r in queries.op13_band_join(spark, sf).collect()}
    assert got == set(plain(lines, items))
