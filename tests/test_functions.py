import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.functions import classify
from faultline.functions import text as T


def values(spark, f, inputs, kind="string"):
    rows = [(i, x) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("x"))).collect())]


def test_normalize_key(spark):
    def plain(x):
        x = (x or "").lower().strip()
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", x))

    inputs = ["Motor fails.", "Motor fails", "\u00a0pad\u2003", "é-x", "ﬁlter", None, "", " a\t\nb ", "x\x1cy", "\x85z"]
    assert values(spark, T.normalize_key, inputs) == [plain(x) for x in inputs]
    assert values(spark, T.normalize_key, ["Motor fails."]) == ["motor fails "]


def test_normalizers(spark):
    assert values(spark, T.normalize_plain, ["Motor fails.", " É a "]) == ["motor fails", "a"]
    assert values(spark, T.normalize_spaces, ["  A,  b\n"]) == ["a, b"]
    assert values(spark, T.normalize_valuable, ["On 1-02-2020 Motor 12 stopped"]) == ["on motor stopped"]
    assert values(spark, T.normalize_document, ["ﬁx\r\n\r\n\r\n\r\n•\ta  b "]) == ["fix\n\n- a b"]


def test_parse_number(spark):
    inputs = ["7", " 7 ", "7.5", "1e3", "1.e3", "1_000", "nan", "N/A", "-", "tbd", "", None, "-3", ".5", ".", "inf", "1.5.2"]
    assert values(spark, T.parse_number, inputs) == [7, 7, 7.5, None, 1000, 1000, None, None, None, None, None, None, -3, 0.5, None, None, None]


def test_numeric_like(spark):
    inputs = ["nan", "inf", "1e3", " 4 ", "", "x", None, "1_0", "5.", "-.5"]

    def plain(x):
        try:
            return x is not None and float(x.strip()) is not None
        except ValueError:
            return False

    assert values(spark, T.is_numeric_like, inputs) == [plain(x) for x in inputs]


def test_embeddable(spark):
    assert values(spark, T.is_embeddable, [None, " ", "-", "TBD", "To be defined", "none", "pump"]) == [False] * 6 + [True]


def test_prefix_and_discipline(spark):
    inputs = ["[S01F01] X", "[S01 - HW] Encoder noise", "[A][B] y", "no prefix", None]
    assert values(spark, T.strip_prefix, inputs) == ["X", "Encoder noise", "[B] y", "no prefix", ""]
    assert [tuple(x) for x in values(spark, T.discipline_and_cause, inputs)] == [("", "X"), ("HW", "Encoder noise"), ("", "[B] y"), ("", "no prefix"), ("", "")]


def test_ids_and_json(spark):
    assert values(spark, lambda x: T.find_8d_id(x, F.lit("file")), ["see 8D123 and 8D4", "none", None]) == ["8D123", "file", "file"]
    assert values(spark, T.prefix_8d, ["12-345 678 90"]) == ["8D12345678"]
    assert values(spark, T.json_slice, ['```json\n{"a": {"b": 1}}\n```', "prose", 'x {"a"} y']) == ['{"a": {"b": 1}}', None, '{"a"}']


def test_failure_types(spark):
    inputs = ["Electronics / General", "Motor/ Connectors", "Pump / Power board", "Software / Timing", "Pump / Impeller", "Mechanics", "a/b/c", "  ", None, "x / DC"]
    want = [("HW", None), (None, "motor / connectors"), (None, "pump / power board"), ("ESW", None), (None, "pump / impeller"), ("MCH", None), (None, "a / b c"), (None, None), (None, None), (None, "x / dc")]
    assert [tuple(x) for x in values(spark, classify.failure_type_parts, inputs)] == want
    assert values(spark, classify.discipline, ["embedded software unit", "embedded", "Soldering process", "system", "zzz"]) == ["ESW", None, "process", "other", None]


def test_rules(spark):
    assert values(spark, classify.is_atomic, ["a and b", "a, b and c, d", "a; b", "a, b, c"]) == [True, False, True, True]
    assert values(spark, classify.fmea_level, ["Operator error", "noise", None]) == ["process", "non-process", "non-process"]
    assert values(spark, lambda x: classify.entity_rule(F.lit("symptom"), x), ["High VOLTAGE", "noise"]) == [False, True]
    assert values(spark, lambda x: classify.assertion_rule(x, F.lit("it was verified")), ["observed", "confirmed", "suspected", None, "odd"]) == [True, True, False, False, False]


def test_coverages(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a"]), ([], ["a"]), ([], [])], "a array<string>, b array<string>")
    got = df.select(T.set_coverage(F.col("a"), F.col("b")), T.bag_coverage(F.col("a"), F.col("b")), T.jaccard(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.5, pytest.approx(2 / 3), 0.5), (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)]


def slow_ratio(a, b):
    """From the definition: three strings, a table for each longest common subsequence."""
    def lcs(p, q):
        row = [0] * (len(q) + 1)
        for c in p:
            new = [0]
            for j, e in enumerate(q):
                new.append(row[j] + 1 if c == e else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    ratio = lambda p, q: 200 * lcs(p, q) / (len(p) + len(q)) if p or q else 100.0
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    i, l, r = sorted(x & y), sorted(x - y), sorted(y - x)
    if i and (not l or not r):
        return 100.0
    t0, t1, t2 = " ".join(i), " ".join(i + l), " ".join(i + r)
    return max([ratio(t1, t2)] + ([ratio(t0, t1), ratio(t0, t2)] if i else []))


@settings(max_examples=200, deadline=None)
@given(*[st.text("ab c", max_size=25)] * 2)
def test_token_set_ratio(a, b):
    assert T.token_set_ratio_of(a, b) == pytest.approx(slow_ratio(a, b))


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_best_likeness(a, b):
    mine, known = a.split(), b.split()
    share = sum(t in known for t in mine) / len(mine) if mine else 0.0
    assert T.best_likeness_of(a, b) == max(share, T.token_set_ratio_of(a, b) / 100)


def test_best_likeness_of_nulls(spark):
    df = spark.createDataFrame([("a b a", "a"), (None, "a"), ("a", None), ("", "a")], "a string, b string")
    got = [x[0] for x in df.select(T.best_likeness("a", "b")).collect()]
    assert got == [1.0, None, None, 0.0]


def test_token_set_ratio_bounds_change_nothing():
    import random

    from faultline.functions.text import best_likeness_of, lcs, token_set_ratio_of

    def plain(a, b):
        x, y = set(a.split()), set(b.split())
        if not x or not y:
            return 0.0
        both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        if both and (not left or not right):
            return 100.0
        texts = [both, f"{both} {left}".strip(), f"{both} {right}".strip()]
        pairs = [(1, 2)] + ([(0, 1), (0, 2)] if both else [])
        return max(200.0 * lcs(texts[i], texts[j]) / (len(texts[i]) + len(texts[j])) for i, j in pairs)

    draw = random.Random(2)
    words = ["pump", "pumps", "stuck", "valve", "a", "bb", "rotor", "motor", "dust", "dusty"]
    for _ in range(3000):
        a, b = (" ".join(draw.choices(words, k=draw.randrange(0, 8))) for _ in range(2))
        want = plain(a, b)
        assert abs(token_set_ratio_of(a, b) - want) < 1e-9
        for low in (0.0, 40.0, 70.0, 95.0):
            got = token_set_ratio_of(a, b, low)
            assert abs(got - want) < 1e-9 if want > low else got <= low + 1e-9
        mine = a.split()
        share = sum(t in set(b.split()) for t in mine) / len(mine) if mine else 0.0
        assert abs(best_likeness_of(a, b) - max(share, want / 100)) < 1e-9


def test_sentences_of_normalised_text_in_one_split(spark):
    odd = ["", None, " . ", "..a", "A b.  C!d ?", " x .　 y\x1c", "On 01-02-2020. Motor 7!\tstops", "a . b. . c", "no end", "é.\u0085Ö ", "1.5 mm. 2"]
    both = lambda x: F.struct(T.valuable_sentences(x).alias("a"), T.sentences(T.normalize_valuable(x)).alias("b"))
    assert all(r.a == r.b for r in values(spark, both, odd))
    many = lambda x: F.struct(T.has_words(x, 3).alias("a"), (F.size(F.split(x, " ")) >= 3).alias("b"))
    assert all(r.a == r.b for r in values(spark, many, ["a", "a b", "a b c", "a b c d", "", "é é é"]))
    distinct = lambda x: F.struct(T.content_words(x).alias("a"), F.array_distinct(T.content_tokens(x)).alias("b"))
    assert all(r.a == r.b for r in values(spark, distinct, [*odd, "Pump pump the ab ÄÖÜ x1y äöü"]))
    assert values(spark, T.strip, [" a ", " a ", " \ta\n ", "  ", "", None, "é ", " a\x85"]) == ["a", "a", "a", "", "", None, "é", "a"]
