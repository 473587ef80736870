"""Lemma rules against a plain version, and on words that show them."""

import random
from collections import Counter

from pyspark.sql import functions as F

from faultline.operators import lemmas


def plain_rules(words, support, share):
    words = {w for w in words if w is not None}
    ends = [(w[: len(w) - n], w[len(w) - n :]) for w in words for n in range(lemmas.ENDING + 1) if len(w) - n >= lemmas.STEM]
    by_stem = {}
    for stem, end in ends:
        by_stem.setdefault(stem, []).append(end)
    found = Counter((a, b) for e in by_stem.values() for a in e for b in e if a and len(b) < len(a) and len(b) <= lemmas.BASE)
    total = Counter(e for _, e in ends if e)
    best = {}
    for (a, b), n in sorted(found.items(), key=lambda x: (-x[1], len(x[0][1]), x[0][1])):
        if n >= support:
            best.setdefault(a, (b, n))
    return {(a, b, n, total[a]) for a, (b, n) in best.items() if n >= share * total[a]}


def plain_lemma(word, known):
    for n in range(min(lemmas.ENDING, len(word) - lemmas.STEM), 0, -1):
        if word[-n:] in known:
            return word[:-n] + known[word[-n:]]
    return word


def test_rules_and_lemmas_equal_a_plain_version(spark):
    r = random.Random(5)
    stems = ["".join(r.choice("abcü") for _ in range(r.randint(2, 5))) for _ in range(150)]
    words = sorted({s + r.choice(["", "s", "es", "ing", "en", "ien", "\U00010428"]) for s in stems for _ in range(3)})
    got = lemmas.rules(spark.createDataFrame([(w,) for w in [*words, None]], "word string"), support=3, share=0.2).collect()
    want = plain_rules(words, 3, 0.2)
    assert len(want) > 5 and {(x.ending, x.base, x.support, x.total) for x in got} == want
    known = {x.ending: x.base for x in got}
    rows = spark.createDataFrame([(w,) for w in words], "word string").select("word", lemmas.lemma(F.col("word"), known).alias("l")).collect()
    assert {x.word: x.l for x in rows} == {w: plain_lemma(w, known) for w in words}


def test_inflected_words_of_texts_meet(spark):
    stems = ["bearing", "motor", "pump", "sensor", "gasket", "rotor", "seal"]
    texts = [" ".join(stems), "The " + ", ".join(s + "s" for s in stems) + "."] * 2 + ["glass of one alone", None, "", "a of"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    known = lemmas.learnt(docs)
    assert known == {"s": ""}
    got = {r.id: r.j for r in docs.select("id", lemmas.joined(F.col("text"), known).alias("j")).collect()}
    assert got[0] == got[1] == " ".join(stems)
    assert (got[5], got[6], got[7]) == (None, "", "")


def test_nothing_to_learn_and_short_words(spark):
    none = spark.createDataFrame([], "text string")
    assert lemmas.learnt(none) == {}
    df = spark.createDataFrame([("gas",), ("gates",), ("",), (None,)], "w string")
    assert [r[0] for r in df.select(lemmas.lemma(F.col("w"), {})).collect()] == ["gas", "gates", "", None]
    # Three letters stay at least; the longest ending goes first.
    assert [r[0] for r in df.select(lemmas.lemma(F.col("w"), {"s": "", "es": "e"})).collect()] == ["gas", "gate", "", None]
