import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from faultline.llm import mixing, ngram_join, pii, quality
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_id = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ranker = quality.fit(docs, labels)
    good = {i for i, r in by_id.items() if ranker.score(quality.features([r.text]))[0] >= quality.CUT}
    one = corpus_pipeline.keep_good(spark, docs, SF)
    assert one.schema == docs.schema and {r.doc_id for r in one.collect()} == good
    two = corpus_pipeline.keep_one_of_each_group(spark, one, SF)
    want = {root for _, _, root in brute([(i, by_id[i].text) for i in good])}
    assert two.schema == docs.schema and sorted(r.doc_id for r in two.collect()) == sorted(want)
    three = corpus_pipeline.hide_personal_values(spark, two, SF)
    new = {r.doc_id: r.text for r in three.collect()}
    for i, t in new.items():
        assert re.sub(r"[0-9]", "", re.sub(r"\S+@", "@", t)) == re.sub(r"[0-9]", "", re.sub(r"\S+@", "@", by_id[i].text))
        assert not {m for m in re.findall(r"[\w.+-]+@[\w.]+\w", by_id[i].text)} & set(re.findall(r"[\w.+-]+@[\w.]+\w", t))
    four = corpus_pipeline.mix(spark, three, SF)
    times = Counter(r.doc_id for r in four.collect())
    for r in mixing.mix_sources(three).collect():
        assert r.whole_epochs <= times[r.doc_id] <= r.whole_epochs + (r.share > 0)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == times
    assert all(r.n_tokens == len(r.ids) for r in rows)


def test_keep_one_with_odd_ids(spark):
    df = spark.createDataFrame([(None, "a b c", "x"), (4, "a b c", "y"), (4, "q r", "z"), (4, "q r", "z"), (5, None, "w")], "doc_id long, text string, _kept string")
    got = sorted((r.doc_id or 0, r.text or "") for r in ngram_join.keep_one(df).collect())
    assert got == [(0, "a b c"), (4, "q r"), (5, "")]
    df = spark.createDataFrame([(1, "a b c", 7), (2, "a b c", 8), (3, "q r", 9)], "doc_id long, text string, doc int")
    assert sorted(tuple(r) for r in ngram_join.keep_one(df).collect()) == [(1, "a b c", 7), (3, "q r", 9)]


def test_pii_is_a_permutation_that_validates(spark):

    n = spark.range(73049).select("id", pii.permute(F.col("id"), 17, 4297, "k", F.lit("date")).alias("x"))
    assert n.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()[:] == (73049, 0, 73048)
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    texts = ["4785380592391139 4785-3805-9239-1139, 4785380592391138", "GB82WEST12345698765432", "a@b.com A.z9@b.com", "10.0.0.1. 300.1.1.1", "2024-02-29 2023-02-30 31/12/1999", "078-05-1120 666-05-1120", "+1 (743) 555-3824", "", None, "1" * 5000 + "x" * 100_000 + "@"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_replaced string")
    got = {r.doc_id: r for r in pii.pseudonymize(df, key="k", counted="n_replaced").collect()}
    a, b, c = got[0].text.replace(",", "").split()
    assert luhn(a) and b.replace("-", "") == a and a != texts[0][:16] and c == "4785380592391138"
    iban = got[1].text
    assert int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1 and re.fullmatch(r"GB\d{2}[A-Z]{4}\d{14}", iban)
    assert re.fullmatch(r"[a-z]@b\.com [A-Z]\.[a-z]\d@b\.com", got[2].text)
    assert re.fullmatch(r"\d+\.\d+\.\d+\.\d+\. 300\.1\.1\.1", got[3].text) and "10.0.0.1." not in got[3].text
    assert re.fullmatch(r"\d{4}-\d{2}-\d{2} 2023-02-30 \d{2}/\d{2}/\d{4}", got[4].text) and got[4].n_replaced == 2
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4} 666-05-1120", got[5].text)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[6].text)
    assert (got[7].text, got[8].text, got[9].text, got[9].n_replaced) == ("", None, texts[9], 0)
    assert pii.pseudonymize(df.limit(0), key="k").count() == 0


def plain_permute(x, a, b, key, tweak, undo=False):
    """The Feistel network in plain Python."""
    l, r = divmod(x, b)
    for i in range(pii.ROUNDS, 0, -1) if undo else range(1, pii.ROUNDS + 1):
        other, size = (r, a) if i % 2 == 0 else (l, b)
        add = int(hashlib.sha256(f"{key}|{tweak}|{i}|{other}|{key}".encode()).hexdigest()[:14], 16) % size
        add = -add if undo else add
        l, r = ((l + add) % a, r) if i % 2 == 0 else (l, (r + add) % b)
    return l * b + r


def test_permutation_against_plain_version_and_its_inverse(spark):
    for a, b in ((17, 4297), (10**4, 10**5), (1, 7), (65536, 65536)):
        n = spark.range(0, a * b, max(1, a * b // 50)).withColumn("y", pii.permute(F.col("id"), a, b, "key", F.lit("kind")))
        for r in n.withColumn("z", pii.permute(F.col("y"), a, b, "key", F.lit("kind"), undo=True)).collect():
            assert r.y == plain_permute(r.id, a, b, "key", "kind") and r.z == r.id == plain_permute(r.y, a, b, "key", "kind", undo=True)


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_values_beside_others_and_in_groups(spark):
    card = "4111 1111 1111 1111"
    texts = {
        1: f"{card} 123", 2: f"2 {card}", 3: f"12345 {card}", 4: f"pay {card}.", 5: "GB82 WEST 1234 5698 7654 32 ABCD x", 6: "GB82WEST12345698765432", 7: "call +44 20 7946 0958 or +49 30 901820",
        8: "a" * 90 + "@example.org", 9: "13 45 33 11 10 20 30 40 50 60 70 80", 10: "+5 10 20", 11: "GB82 WEST 1234 5698 7654 33", 12: "3782 822463 10005",
    }
    got = {r.id: r.text for r in pii.pseudonymize(spark.createDataFrame(list(texts.items()), "id long, text string"), key="k").collect()}
    number = re.search(r"\d{4} \d{4} \d{4} \d{4}(?=\.)", got[4])[0]
    assert number != card and luhn(number.replace(" ", ""))
    assert got[1] == f"{number} 123" and got[2] == f"2 {number}" and got[3] == f"12345 {number}"
    iban = got[5].removesuffix(" ABCD x")
    assert iban != "GB82 WEST 1234 5698 7654 32" and iban.replace(" ", "") == got[6] and mod97(got[6]) == 1 and [len(w) for w in iban.split()] == [4, 4, 4, 4, 4, 2]
    assert re.fullmatch(r"call \+44 \d\d \d{4} \d{4} or \+49 \d\d \d{6}", got[7]) and got[7] != texts[7]
    assert got[8] != texts[8] and re.fullmatch("[a-z]{90}@example.org", got[8])
    assert all(got[i] == texts[i] for i in (9, 10, 11))
    assert got[12] != texts[12] and luhn(got[12].replace(" ", "")) and re.fullmatch(r"\d{4} \d{6} \d{5}", got[12])
