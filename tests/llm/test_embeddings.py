import numpy as np

from faultline.llm import embeddings


def brute(x, cosine=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= cosine
    np.fill_diagonal(hit, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[hit[i]]]) for i in range(len(x))])
        if (new == label).all():
            return hit.sum(1), label
        label = new


def test_against_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(400, 16))
    near = base[:150] + 0.08 * r.normal(size=(150, 16))
    chain = base[7] + np.linspace(0, 1, 12)[:, None] * r.normal(size=16)
    x = np.vstack([base, near, base[:20], 3 * base[20:30], chain, np.repeat(base[:1], 60, 0)]).astype(np.float32).astype(float)
    n, label = brute(x)
    df = spark.createDataFrame([(i, v.tolist(), "k") for i, v in enumerate(x)], "vec_id long, embedding array<float>, m string")
    for cell, block in ((100, 4000), (1000, 100)):
        got = {y.vec_id: y for y in embeddings.near_dedup(df, cell=cell, block=block).collect()}
        assert [got[i].n_links for i in range(len(x))] == n.tolist()
        assert [got[i].component_id for i in range(len(x))] == label.tolist()
        assert all(got[i].kept == (label[i] == i) for i in range(len(x)))


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [0.0, 5.0]), (8, [0.0, 5.0]), (8, [0.0, 5.0]), (9, []), (10, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((y.vec_id or 0), y.n_links, y.component_id, y.kept) for y in embeddings.near_dedup(df).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 9, 10)]
    assert got == sorted([(0, 2, None, True), (1, 1, 1, True), (2, 1, 1, False), (8, 2, None, False), (8, 2, None, False), *alone], key=lambda t: t[:2])
    assert embeddings.near_dedup(df.limit(0)).count() == 0


def test_links_near_the_bound_across_borders(spark):
    # Pairs of cosine just over 0.95 among many cells: both ends count, whichever of them visits the other's cell.
    r = np.random.default_rng(3)
    a = r.normal(size=(600, 6))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = r.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.vstack([a, 0.951 * a + np.sqrt(1 - 0.951**2) * side])
    n, label = brute(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {y.vec_id: y for y in embeddings.near_dedup(df, cell=12).collect()}
    assert [got[i].n_links for i in range(len(x))] == n.tolist()
    assert [got[i].component_id for i in range(len(x))] == label.tolist()


def test_many_cells_in_several_dimensions(spark):
    for width in (4, 8, 64):
        r = np.random.default_rng(width)
        base = r.normal(size=(300, width))
        x = np.vstack([base, base + 0.3 / np.sqrt(width) * np.linalg.norm(base, axis=1, keepdims=True) * r.normal(size=base.shape)])
        n, label = brute(x)
        assert 0 < (n > 0).sum() < len(x) or width == 4
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {y.vec_id: y for y in embeddings.near_dedup(df, cell=18).collect()}
        assert [got[i].n_links for i in range(len(x))] == n.tolist()
        assert [got[i].component_id for i in range(len(x))] == label.tolist()


def test_other_lengths_and_extreme_sizes(spark):
    rows = [(0, [1.0]), (1, [2.0, 0.0]), (2, [1e200, 1e190]), (3, [1e-200, 0.0]), (4, [0.0, 1.0]), (5, [5.0]), (6, [1.0, 0.0, 0.0]), (7, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(y.n_links, y.component_id) for y in sorted(embeddings.near_dedup(df).collect(), key=lambda y: y.vec_id)]
    assert got == [(1, 0), (2, 1), (2, 1), (2, 1), (0, 4), (1, 0), (0, 6), (0, 7)]
