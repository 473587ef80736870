"""The metric index against scans of all with all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import metric, vectors

SCHEMA = "vec_id long, role string, embedding array<double>, g string, cell int, part int"


def _clustered(n, seed=3, dim=8, centers=12):
    draw = np.random.default_rng(seed)
    at = draw.normal(size=(centers, dim)) * 10
    own = draw.integers(0, centers, n)
    return at[own] + draw.normal(size=(n, dim)) * 0.1


def _items(spark, x, roles=("a", "b")):
    return spark.createDataFrame([(i, roles[i % len(roles)], [float(v) for v in r], "z", 7, 7) for i, r in enumerate(x)], SCHEMA)


def _plain_nearest(x, roles, k):
    out = {}
    for i in range(len(x)):
        mine = [j for j in range(len(x)) if j % roles == i % roles]
        d = ((x[i] - x[mine]) ** 2).sum(1)
        out[i] = [(float(d[p]), mine[p]) for p in np.lexsort((mine, d))[:k]]
    return out


@pytest.mark.parametrize("kind", ["clustered", "even", "copies"])
def test_nearest_is_that_of_a_scan(spark, kind):
    x = {"clustered": _clustered(700), "even": np.random.default_rng(1).normal(size=(500, 6)), "copies": np.repeat(_clustered(60), 9, axis=0)}[kind]
    index = metric.build(_items(spark, x), pivots=9, block=40)
    got = {}
    for r in metric.nearest(index, 4).collect():
        got.setdefault(r.vec_id, []).append((r.dist, r.neighbour))
    want = _plain_nearest(x, 2, 4)
    assert got.keys() == want.keys()
    for i, rows in want.items():
        assert sorted(got[i]) == rows


def test_fewer_vectors_than_k_and_no_vectors(spark):
    few = _items(spark, _clustered(5))
    assert metric.nearest(metric.build(few), 10).count() == 3 * 3 + 2 * 2
    none = metric.build(few.limit(0))
    assert metric.nearest(none, 3).collect() == [] and metric.within(none, 1.0).collect() == []


def test_within_gives_each_pair_once(spark):
    x = np.concatenate([_clustered(400), _clustered(100)])  # the last 100 repeat vectors' centers
    index = metric.build(_items(spark, x, ("a",)), pivots=8, block=30)
    got = [(r.a, r.b) for r in metric.within(index, 0.4).collect()]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert len(got) == len(set(got)) and set(got) == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(d <= 0.16, 1)))}


def test_vectors_that_cannot_be_compared_stay_out(spark):
    odd = [(1, "a", [1.0, 0.0]), (2, "a", None), (3, "a", [None, 1.0]), (4, "a", [float("nan"), 1.0]), (5, "a", [float("inf"), 1.0]), (6, None, [1.0, 0.0]), (None, "a", [1.0, 0.0]), (7, "a", [0.0, 0.0]), (8, "a", []), (9, "a", [2.0, 0.0])]
    items = spark.createDataFrame(odd, "vec_id long, role string, embedding array<double>")
    assert {r.vec_id for r in metric.build(items).rows.collect()} == {1, 7, 9}
    assert [(r.a, r.b, r.similarity) for r in metric.cosine_pairs(items, 1.0, "role").collect()] == [(1, 9, 1.0)]


def test_cohesion_is_that_of_blocks(spark):
    items = _items(spark, _clustered(600, seed=8))
    round_ = lambda d: sorted((r.vec_id, r.role, round(r.avg_dist, 9)) for r in d.collect())
    assert round_(metric.cohesion(metric.build(items, pivots=12, block=50))) == round_(vectors.cohesion(items))


def test_clustered_vectors_skip_more_blocks_as_the_table_grows(spark):
    shares = []
    for n in (1_500, 6_000):
        index = metric.build(_items(spark, _clustered(n), ("a",)), pivots=12, block=100)
        row = metric.pruning(index, k=4).first()
        assert row.compared <= row.block_pairs
        shares.append((row.pairs_skipped, row.vectors_skipped))
        print(n, row)
    assert min(min(s) for s in shares) > 0.5 and shares[1][1] >= shares[0][1] - 0.05
    with pytest.raises(ValueError):
        metric.pruning(index)


def test_pivots_are_far_from_each_other():
    x = np.array([[0.0], [1.0], [10.0], [10.0], [4.0]])
    assert metric.farthest_first(x, 3).ravel().tolist() == [0.0, 10.0, 4.0]
    assert len(metric.farthest_first(np.ones((5, 2)), 3)) == 1


@pytest.mark.parametrize("indexed", [False, True])
def test_blocks_read_each_other_in_stripes(spark, monkeypatch, indexed):
    monkeypatch.setattr(vectors, "STRIPE", 3)
    x = np.concatenate([_clustered(300), np.repeat(_clustered(20), 6, axis=0)])
    items = _items(spark, x)
    found = metric.nearest(metric.build(items, pivots=5, block=25), 4) if indexed else vectors.nearest_of_own(items, 4, block=25)
    got = {}
    for r in found.collect():
        got.setdefault(r.vec_id, []).append((r.dist, r.neighbour))
    assert {i: sorted(v) for i, v in got.items()} == _plain_nearest(x, 2, 4)
    # Vectors are written once and are not sent to the blocks that they meet.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "x#" not in plan and plan.count("[g#") >= 1


def test_a_limit_spares_no_neighbour_within_it():
    draw = np.random.default_rng(2)
    x, y = draw.normal(size=(700, 5)), draw.normal(size=(300, 5))
    row, col, d = vectors._near(x, y, 4)
    limit = np.where(np.arange(700) % 3 == 0, np.inf, d.reshape(700, 4)[:, 2])
    r, c, e = vectors._near(x, y, 4, limit)
    assert {(a, b) for a, b, far in zip(row, col, d) if far <= limit[a]} <= set(zip(r, c)) <= set(zip(row, col))


@pytest.mark.parametrize("scale", [1.0, 1e-25, 1e-21, 1e12, 1e30])
def test_single_precision_loses_no_neighbour(scale):
    draw = np.random.default_rng(4)
    far = draw.normal(size=(1, 16)) * 1e3  # near each other, far from zero: single precision can't tell them apart
    for x in (draw.normal(size=(600, 16)), far + draw.normal(size=(600, 16)) * 1e-3, np.repeat(draw.normal(size=(60, 16)), 10, axis=0)):
        x = x * scale
        row, col, d = vectors._near(x, x, 5)
        every = ((x[:, None] - x[None]) ** 2).sum(2)
        want = np.lexsort((np.broadcast_to(np.arange(600), every.shape), every), axis=1)[:, :5]
        assert (col.reshape(-1, 5) == want).all() and (d.reshape(-1, 5) == np.take_along_axis(every, want, 1)).all()
        # What is known of one half of the vectors is a limit for the other one.
        r, c, e = vectors._near(x, x[300:], 5, np.where(np.arange(600) % 2 == 0, d.reshape(-1, 5)[:, -1], np.inf))
        assert {(a, b) for a, b in zip(row, col) if b >= 300} <= set(zip(r, c + 300))
    odd = np.where(np.arange(20)[:, None] == 7, np.nan, draw.normal(size=(20, 3)))
    row, col, _ = vectors._near(odd, odd, 3)
    assert 7 not in {*row, *col} and len(row) == 19 * 3
