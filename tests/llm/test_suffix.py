import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import difference_cover, suffix


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=0, max_size=80))
def test_suffix_array(s):
    assert difference_cover.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_distributed_suffix_ranks(spark):
    r = random.Random(1)
    parts = [[r.randint(1, 2) for _ in range(r.randint(1, 60))] + [100 + i] for i in range(12)] + [[1] * 50 + [200], [1, 2, 3] * 20 + [201], [202]]
    df = spark.createDataFrame(list(enumerate(parts)), "part long, symbols array<long>")
    order = sorted(((i, k) for i, p in enumerate(parts) for k in range(len(p))), key=lambda x: parts[x[0]][x[1] :])
    want = {place: rank for rank, place in enumerate(order, 1)}
    for local in (10**6, 150):
        got = {x.part: x.ranks for x in difference_cover.suffix_ranks(df, local).collect()}
        assert all(got[i] == [want[i, k] for k in range(len(p))] for i, p in enumerate(parts))


def brute(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(r[p : p + length] for _, r in raw for p in range(len(r) - length + 1))
    out = []
    for i, r in raw:
        hit = [False] * len(r)
        for p in range(len(r) - length + 1):
            if count[r[p : p + length]] > 1:
                hit[p : p + length] = [True] * length
        kept = bytes(c for c, h in zip(r, hit) if not h)
        spans = sum(h and not before for h, before in zip(hit, [False, *hit]))
        out.append((i, len(r), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    make = lambda n: "".join(r.choice("abcdeé \n漢") for _ in range(n))
    common = make(300)
    texts = ["", None, "a" * 200, "ab" * 90, make(39), common, common, common[:50], common[250:] + make(20)]
    for _ in range(40):
        t = make(r.randint(20, 300))
        texts += [t] * r.choice((1, 1, 2)) + [t[: len(t) // 2] + "#" + t[len(t) // 2 :], make(30) + common[r.randint(0, 100) : r.randint(150, 300)] + make(20)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, copied int")
    want = brute(rows, 40)
    monkeypatch.setattr(suffix, "NEIGHBOURS", 1000)
    for block in (1 << 20, 3000, 500):  # one block, blocks and hot minima, mostly hot minima
        got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.dedup(df, 40, 8, block).collect())
        assert got == want


def test_odd_ids_and_empty_table(spark):
    t = "".join(map(chr, range(200, 500)))
    df = spark.createDataFrame([(None, t), (1, t + "x"), (2, "y"), (2, "y"), (3, "z" * 500), (3, "z" * 500)], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.n_bytes, x.n_removed) for x in suffix.dedup(df).collect())
    n = len(t.encode())
    assert got == [(0, n, n), (1, n + 1, n), (2, 1, 0), (2, 1, 0), (3, 500, 500), (3, 500, 500)]
    assert suffix.dedup(df.limit(0)).count() == 0
