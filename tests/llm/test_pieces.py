"""Queries 11 and 12 against plain versions that call the tokenizers' own libraries on whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from faultline.llm import alignment, chunks, pieces, queries

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "a \n b", "x\n\n  y\t z ", "▁", "a▁ b", "▁▁ a", "tab\there", "a\x1c b", "né naïve – 日本語 テスト", "🙂🙂 \U0010ffff", "\x00 \x01",
    "<s> </s> <unk> <0x0A> <|endoftext|>", "don't can't 123 4567", "　wide  nbsp", "ﬁ ligature", "é", "a" * 5000, " " * 300, "word " * 3000, "日本" * 3000,
]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    letters = ["a", "b", " ", " ", "\n", "\t", "é", "▁", "日", "1", "'", "s", ".", " ", "\x85", "x"]
    return ODD + ["".join(draw.choice(letters) for _ in range(draw.randrange(40))) for _ in range(400)]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_words_are_cut_where_no_piece_crosses(model, texts):
    for t in filter(None, texts):
        assert " ".join(chunks.marked(t)) == t
        assert sum((model.encode(w) for w in chunks.marked(t)), []) == model.encode(t)


def test_tables_segment_each_word_once_and_begin_anew(model):
    table = chunks.ChunkTable([lambda c: model.encode(c)], most=3)
    for text in ("one two one two one", "three four one", "one two five six seven"):
        ((flat, offsets),) = table.ids([text, None, ""])
        assert flat.tolist() == model.encode(text) and offsets.tolist() == [0, len(flat), len(flat), len(flat)]
    assert table.segmented == 2 + 2 + 5
    assert chunks.piece_cut(model.serialized_model_proto()) is chunks.marked


def test_pieces_and_decoded_texts_are_the_librarys(spark, model, texts):
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)] + [(None, "a null id", "y", None)], "doc_id long, text string, ids string, decoded array<int>")
    rows = pieces.decode(pieces.encode(docs, PIECES), PIECES).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = ("a null id" if r.doc_id is None else texts[r.doc_id]) or ""
        assert r.ids == model.encode(text) and r.decoded == model.decode(model.encode(text))
    assert pieces.digests(docs.limit(0), PIECES).collect() == []


def test_query_12_on_whole_texts(spark, model):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12_piece_table(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = model.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), _sha(",".join(map(str, ids))), _sha(model.decode(ids)))


def plain_alignment(rows, model):
    """Every pair of tokens of a group is held against its byte ranges."""
    byte = Tokenizer.from_file(BYTES)
    byte.encode_special_tokens = True
    name, of = {v: k for k, v in byte.get_vocab().items()}, alignment._byte_of()
    found, df = [], Counter()
    for text in rows:
        want = (" " + (text or "")).encode()
        a, b = byte.encode(want.decode(), add_special_tokens=False).ids, model.encode(text or "")
        parts = [bytes(of[c] for c in name[x]) for x in a], [bytes([int(model.id_to_piece(x)[3:5], 16)]) if model.is_byte(x) else model.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or any(b"".join(p) != want for p in parts):
            found.append((0, 0, [], []))
            continue
        ends = [[sum(map(len, p[: i + 1])) for i in range(len(p))] if len(p) < 300 else list(__import__("itertools").accumulate(map(len, p))) for p in parts]
        groups, links, i, k = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[k:y])))
            for p in range(i, x):
                for q in range(k, y):
                    if max(ends[0][p] - len(parts[0][p]), ends[1][q] - len(parts[1][q])) < min(ends[0][p], ends[1][q]):
                        links.append((a[p], b[q]))
            i, k = x, y
        found.append((len(a), len(b), groups, links))
        df.update(set(links))
    top = {}
    for (x, _), n in df.items():
        top[x] = max(top.get(x, 0), n)
    return [(na, nb, len(g), len(ls), sum(df[p] == top[p[0]] for p in ls), sum(df[p] for p in ls), _sha(";".join(g)) if na else "") for na, nb, g, ls in found]


def _numbers(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


def test_alignment_of_odd_texts(spark, model, texts):
    some = texts[:220]
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in enumerate(some)], "doc_id long, text string, row int, pair string")
    got = {r.doc_id: _numbers(r) for r in alignment.align(docs, BYTES, PIECES).collect()}
    assert [got[i] for i in range(len(some))] == plain_alignment(some, model)


def test_alignment_joins_rare_pairs_and_counts_repeated_rows(spark, model, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_PAIRS", 30)
    some = ["the cat sat on the mat"] * 30 + ["the cat", None, "zyzzyva qwxz the", "the cat"]
    docs = spark.createDataFrame([(None, t) for t in some], "doc_id long, text string")
    got = sorted(_numbers(r) for r in alignment.align(docs, BYTES, PIECES).collect())
    assert got == sorted(plain_alignment(some, model))
    assert alignment.align(docs.limit(0), BYTES, PIECES).collect() == []


def test_query_11_on_whole_texts(spark, model):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = sorted((r.doc_id, *_numbers(r)) for r in queries.op11_token_alignment(spark, SF).collect())
    assert got == [(r.doc_id, *x) for r, x in zip(rows, plain_alignment([r.text for r in rows], model))]


def test_byte_model_gives_the_librarys_ids_either_way():
    raw = open(BYTES, "rb").read()
    ranked, table = alignment.byte_model(raw)
    slow, _ = alignment.byte_model(raw.replace(b'"use_regex"', b'"use_other"') if b'"use_regex"' in raw else raw)
    words = [w for t in ODD if t for w in chunks.marked(t)]
    assert [list(x) for x in ranked(words)] == [list(x) for x in slow(words)]
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    assert [list(x) for x in ranked(words)] == [library.encode(" " + w, add_special_tokens=False).ids for w in words]
    assert len(table) == 50_256 and all(table)


def test_links_are_made_in_one_pass_over_the_words(spark):
    blocks = spark.createDataFrame([([(1, [0, 1, 0], 5, 4)], [([7, 8], [2, 5], [9], [5]), ([3], [4], [6, 5], [1, 4])])], f"docs array<struct<doc_id: long, words: array<int>, n_a: long, n_b: long>>, chunks {alignment._TOKENS}")
    found = alignment.align_blocks(blocks)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("AS chunks#") == 1  # one step, so that no words wait in the form of another one
    (row,) = found.collect()
    pair = lambda a, b: a * 2**32 + b
    assert row.groups == "7,8|9;3|6,5;7,8|9" and sorted(row.links) == sorted([pair(7, 9), pair(8, 9)] * 2 + [pair(3, 6), pair(3, 5)])


def test_words_of_a_block_are_aligned_at_once(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a null id")], "doc_id long, text string").coalesce(1)
    names = ["doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256"]
    for block in (alignment.BLOCK, 200):
        twin = alignment.align_blocks(alignment.tokenise(docs, BYTES, PIECES, block=block)).collect()
        want = [(r.doc_id, r.n_a, r.n_b, r.n_groups, sorted(r.links), _sha(r.groups) if r.n_a else "") for r in twin]
        assert [(*r[:4], sorted(r.links), r.groups_sha256) for r in alignment.aligned(docs, BYTES, PIECES, block=block).select(*names).collect()] == want
    # The query's links and groups are made by arrays of all words, no lambda runs over each token.
    plans, write = [], alignment.written
    monkeypatch.setattr(alignment, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().analyzed().toString())) or write(df, name))
    alignment.align(docs.limit(3), BYTES, PIECES).collect()
    assert [name for name, plan in plans if "lambdafunction" in plan] == [] and plans[0][0] == "aligned"
