import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import common, ngram_join, prefix_tree


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {i: brute_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return sorted((i, len(sets[i]), root(i)) for i in sets)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=12), st.sets(st.integers(0, 30), min_size=1), st.integers(1, 4), st.sampled_from((50, 80, 100)))
def test_tree(sets, probe, node, similarity):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    before, prefix_tree.NODE_TOKENS = prefix_tree.NODE_TOKENS, node
    try:
        tree = prefix_tree.PrefixTree(arrays, [i % 2 for i in range(len(sets))])
    finally:
        prefix_tree.NODE_TOKENS = before
    alike = [i for i, s in enumerate(sets) if 100 * len(s & probe) >= similarity * len(s | probe)]
    assert sorted(tree.similar(np.array(sorted(probe), np.uint64), -1, similarity)) == alike
    others = tree.similar(np.array(sorted(probe), np.uint64), 1, similarity)
    assert [i for i in alike if i % 2 == 0] == sorted(i for i in others if i % 2 == 0)


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randint(0, 3000)
    passage = [word() for _ in range(60)]
    texts = ["", None, " \t\n", "One", "one", "a b c d", "a b c D", "x " * 40, "x " * 30]
    for _ in range(n):
        t = [word() for _ in range(r.randint(5, 120))]
        if r.random() < 0.4:
            t = t[:20] + passage + t[20:40]
        texts.append(" ".join(t))
        for _ in range(r.choice((0, 0, 1, 3))):
            u = list(t)
            for _ in range(r.choice((0, 1, 1, 2, 3))):
                u[r.randrange(len(u))] = word()
            texts.append(" ".join(u).replace("w", r.choice("wW")))
    chain = [word() for _ in range(200)]
    texts += [" ".join(chain[i * 8 : i * 8 + 120]) for i in range(10)]  # each like the next, the ends unlike
    r.shuffle(texts)
    return list(enumerate(texts))


def test_against_brute_force(spark, monkeypatch):
    rows = corpus(1, 60)
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, n int")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.groups(df).collect())
    assert got == brute(rows)


def test_enumeration_alone_and_frequent_order(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "FREQUENT_FROM", 2)
    rows = corpus(2, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.groups(df).collect()) == brute(rows)


def test_odd_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "A b c"), (4, "A b c"), (5, None)], "doc_id long, text string")
    got = sorted(((x.doc_id or 0), x.n_shingles, x.component_id, x.kept) for x in ngram_join.groups(df).collect())
    assert got == [(0, 1, None, True), (4, 1, None, False), (4, 1, None, False), (4, 1, None, False), (5, 0, 5, True)]
    assert ngram_join.groups(df.limit(0)).count() == 0


def test_copies_around_an_absent_original(spark):
    r = random.Random(5)
    rows = []
    for group in range(3):
        original = [f"g{group}w{r.randrange(10**6)}" for _ in range(150)]
        for _ in range(40):
            copy = list(original)
            for _ in range(r.choice((1, 2, 3, 4, 5))):
                copy[r.randrange(150)] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.groups(df).collect())
    assert got == brute(rows)
    assert len({c for _, _, c in got}) > 3  # some of the copies are near, but not similar, to all others


def test_hot_groups_small_trees_and_satellites(spark, monkeypatch):
    # Copies and texts that are alike, but not similar, around two originals; trees and blocks of few sets, hot keys joined apart.
    monkeypatch.setattr(prefix_tree, "TREE_TOKENS", 700)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    r = random.Random(8)
    rows = []
    for group in range(2):
        original = [f"g{group}w{r.randrange(10**6)}" for _ in range(120)]
        for changes in [1] * 30 + [2] * 20 + [4] * 20 + [6] * 30 + [9] * 10:
            copy = list(original)
            for i in r.sample(range(0, 120, 5), changes):
                copy[i] = f"new{r.randrange(10**6)}"
            rows += [(len(rows), " ".join(copy))] * 1
        rows += [(len(rows) + i, " ".join(original)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert 4 < len({c for _, _, c in want}) < len(rows) / 2
    for rounds in (4, 0):
        monkeypatch.setattr(ngram_join, "STAR_ROUNDS", rounds)
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.groups(df).collect()) == want


def test_truncated_and_extended_copies(spark, monkeypatch):
    # All tokens of a shorter copy are in the longer one, some of its prefix tokens behind the longer one's prefix.
    r = random.Random(6)
    rows = []
    for group in range(40):
        words = [f"g{group}w{r.randrange(10**6)}" for _ in range(104)]
        kept = r.choice((80, 80, 81, 83, 85)) + 4  # of 100 shingles
        at = r.choice((0, 104 - kept, r.randrange(104 - kept)))
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[at : at + kept]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len({c for _, _, c in want}) == 40
    for rounds in (4, 0):
        monkeypatch.setattr(ngram_join, "STAR_ROUNDS", rounds)
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.groups(df).collect()) == want
