import hashlib

import duckdb
import pytest

from faultline.llm import langid, merkle, mixing, queries

SF = "/root/testdata/sf0.01"


def test_mixing_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(mixing.ORACLE).fetchall())
    got = sorted(tuple(r) for r in queries.op9_water_filling_mix(spark, SF).collect())
    assert got == want
    assert all(r[4] <= 3 * r[1] for r in got)


def test_water_filling_reshares_until_feasible(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 10), ("b", 2, 2.0, 500), ("c", 3, 3.0, 1000), ("d", 4, 1.0, 0)], "source string, rank int, weight double, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(df).collect()}
    # by hand: a and d fill up at 30 and 0; what is left goes 2 : 3
    assert got == {"a": 30.0, "b": pytest.approx(592.0), "c": pytest.approx(888.0), "d": 0.0}


def test_mixing_cases(spark):
    df = spark.createDataFrame([(1, "a b", None, 1), (1, "a b", None, 1), (2, None, "x", 1), (None, "q w e", "y", 1)], "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(df).collect()
    assert len(got) == 4 and sum(r.taken for r in got) <= 21 and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert mixing.repeat_documents(df).columns == df.columns


def test_merkle_against_plain_version(spark):
    texts = {5: "One, two.\nThree; four", 4: "One, two.\nThree; five", 9: "", 2: None, 7: "日本語。x" * 40, 1: "One, two.\nThree; four"}
    df = spark.createDataFrame([(i, t, "e") for i, t in texts.items()], "doc_id long, text string, edited string")
    for buckets in (1, 3, 64):
        got = {r.doc_id: r for r in merkle.fingerprint_edits(df, buckets=buckets).collect()}
        ids = sorted(texts, reverse=True)
        for i, j in zip(ids, [*ids[1:], ids[0]]):
            own, nxt = texts[i] or "", texts[j] or ""
            half = len(own) // 2
            edited = own[: len(own) - half] + nxt[:half]
            assert got[i].n_chars == len(own) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert (got[i].fingerprint == got[i].edited_fingerprint) == (own == edited)
            assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert got[5].fingerprint == got[1].fingerprint != got[4].fingerprint
        assert got[5].near_next == 0.8  # of five leaves each (one, the end of the first line, is empty), all but the last are shared
    assert merkle.fingerprint_edits(df.limit(0)).count() == 0


def test_likeness_and_edits_from_fingerprints(spark):
    long = "\n".join(f"line {i}, part" for i in range(30))
    df = spark.createDataFrame([(long, long.replace("line 20,", "row 20,"))], "a string, b string")
    x, y = merkle.fingerprint("a"), merkle.fingerprint("b")
    from pyspark.sql import functions as F

    x, y = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    r = df.select(merkle.likeness(x, y).alias("n"), merkle.differing(x, y).alias("d"), merkle.likeness(x, x).alias("s")).first()
    assert 0.9 < r.n < 1 and r.d == [20] and r.s == 1.0


def test_language_cases(spark):
    texts = [(1, "the cat and the dog in the house", "en"), (3, "der hund und die katze im haus", "de"), (4, "Привет мир это текст", "ru"), (5, None, "en"), (6, "12 34 !", "de"), (7, "", None), (8, "the dog and the cat in the house " * 6 + "die katze und der hund im haus " * 6, None), (4, "мир", None)]
    df = spark.createDataFrame([(*t, 1.0) for t in texts], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, r.score): r for r in langid.identify(df, switch=3.0).collect()}
    pred = {r.doc_id: r for r in got.values()}
    assert pred[5].lang_pred == pred[6].lang_pred == pred[7].lang_pred == "und" and pred[6].score == 0
    assert pred[1].lang_pred == "en" and pred[4].lang_pred == "ru"
    assert [s.lang for s in pred[8].spans] == ["en", "de"] and pred[8].spans[1].start == len(texts[6][1]) // 1 - len("die katze und der hund im haus " * 6)
    assert langid.identify(df.limit(0)).count() == 0


@pytest.mark.parametrize("name, column, truth", [("op7_viterbi_language", "lang_pred", "lang"), ("op3_bradley_terry_quality", "predicted", "quality")])
def test_held_out_accuracy(spark, name, column, truth):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = queries.QUERIES[name](spark, SF).join(docs, "doc_id").join(labels, "doc_id", "left").where(f"held_out AND {truth} IS NOT NULL").collect()
    right = sum(r[column] == r[truth] for r in rows) / len(rows)
    assert right > 0.95


def test_quality_cases(spark):
    from faultline.llm import quality

    df = spark.createDataFrame([(1, "good words here", 5), (2, None, 5), (3, "", 5), (2, "x" * 200_000, 5)], "doc_id long, text string, score int")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(df, quality.fit(df, empty)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(df, quality.fit(df, labels)).collect()
    assert all(0 <= r.score <= 1 for r in got) and got[1].score == got[2].score
    assert quality.score(df.limit(0), quality.fit(df, labels)).count() == 0


def test_merkle_without_marks(spark):
    import random

    r = random.Random(4)
    texts = ["same " * 60, "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(400)), " ".join(f"w{r.randrange(10**5)}" for _ in range(90)), "x" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in merkle.fingerprint_edits(df, buckets=1).collect():
        assert row.near_edited > 0 and row.near_edited > row.near_next
