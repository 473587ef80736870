import hashlib
import random

from faultline.llm import common, substring


def brute(rows, window):
    """rows: (doc_id, text), ordered; first places by dictionary."""
    seen, out = set(), []
    for i, text in rows:
        words = (text or "").encode().split()
        hit = [False] * len(words)
        for p in range(len(words) - window + 1):
            w = tuple(words[p : p + window])
            if w in seen:
                hit[p : p + window] = [True] * window
            seen.add(w)
        kept = b" ".join(w for w, h in zip(words, hit) if not h)
        out.append((i, len(words), sum(hit), hashlib.sha256(kept).hexdigest()))
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    vocab = ["w%d" % i for i in range(60)] + ["Ä", "the", "of"]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    common = make(60)
    texts = ["", None, "a b c", "the " * 70, "x y z " * 25, common, common, make(100) + " " + common[40:200] + "\n" + make(30)]
    for _ in range(30):
        t = make(r.randint(5, 150))
        texts += [t] * r.choice((1, 1, 2)) + [t[: len(t) // 2] + " new " + t[len(t) // 2 :]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, first string")
    for window in (40, 20, 7, 3):
        got = sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring.dedup(df, window).collect())
        assert got == brute(rows, window)


def test_levels():
    assert substring.levels(20) == [5, 10, 20] and substring.levels(7) == [4, 7] and substring.levels(40) == [5, 10, 20, 40] and substring.levels(3) == [3]


def test_long_texts_and_hot_windows(spark, monkeypatch):
    # One window in most texts, twice in some, and texts of 60,000 words that share a passage.
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    r = random.Random(4)
    make = lambda n: " ".join("v%d" % r.randrange(10**5) for _ in range(n))
    common_line, passage = make(22), make(500)
    texts = [make(30) + " " + common_line + " " + make(9) for _ in range(40)] + [common_line + " " + common_line, make(30_000) + passage + make(30_000), make(60_000) + passage]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substring.dedup(df).collect()) == brute(rows, 20)


def test_odd_ids_and_empty_table(spark):
    t = " ".join(map(str, range(25)))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (1, "short")], "doc_id long, text string")
    got = sorted((x.doc_id or 0, x.n_words, x.n_removed) for x in substring.dedup(df).collect())
    assert got == [(0, 25, 0), (1, 1, 0), (1, 25, 25), (1, 25, 25)]
    assert substring.dedup(df.limit(0)).count() == 0
