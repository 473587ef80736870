"""Viterbi paths against every path there is."""

import itertools

import numpy as np

from faultline.llm.langid import viterbi


def value(scores, path, switch):
    return sum(scores[i, p] for i, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))


def test_two_other_labels_for_one_switch():
    assert viterbi(np.array([[0.0, 10.0, -100.0], [0.0, -100.0, 10.0]]), 12.0).tolist() == [1, 2]


def test_paths_are_the_best_of_all():
    rng = np.random.default_rng(4)
    for case in range(10_000):
        n, k = int(rng.integers(1, 7)), int(rng.integers(1, 6 if case % 10 == 0 else 4))
        scores = rng.normal(0, rng.choice([1.0, 6.0, 12.0]), (n, k))
        if case % 3 == 0:
            scores = np.round(scores)
        switch = float(rng.choice([0.0, 2.0, 12.0]))
        paths = np.array(list(itertools.product(range(k), repeat=n)))
        sums = scores[np.arange(n), paths].sum(1) - switch * (np.diff(paths, axis=1) != 0).sum(1)
        assert abs(value(scores, viterbi(scores, switch).tolist(), switch) - sums.max()) < 1e-6
