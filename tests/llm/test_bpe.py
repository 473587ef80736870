import base64
import hashlib

import public_tokenizers
import regex

from faultline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}


def brute(text):
    """Plain BPE: of each pre-token's parts, join the pair of least rank, leftmost first, until none has a rank."""
    out = []
    for piece in regex.findall(public_tokenizers.PATTERN, text):
        parts = [bytes([x]) for x in piece.encode()]
        while len(parts) > 1:
            ranked = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [RANKS[p] for p in parts]
    return out


def test_chunks_are_stitched_as_a_whole(spark):
    texts = ["", None, "It's  a test,\n\n  don't!! 123 éß 漢字 🙂", "ab " * 90, "x" * 300, "a  b\n " * 60 + "z" * 200 + " end's" * 40, " " * 250 + "q", "!?" * 150, "wörter und mehr, " * 30]
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)] + [(3, texts[3], "again")], "doc_id long, text string, ids string")
    for chunk, overlap in ((40, 12), (16, 5), (10_000, 100)):
        got = sorted((r.doc_id, tuple(r.ids)) for r in bpe.encode(df, PATH, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect())
        want = sorted([(i, tuple(brute(t or ""))) for i, t in enumerate(texts)] + [(3, tuple(brute(texts[3])))])
        assert got == want


def test_digests_and_round_trip(spark):
    df = spark.createDataFrame([(1, "hé llo"), (2, None)], "doc_id long, text string")
    for r in bpe.digests(df, PATH, public_tokenizers.PATTERN).collect():
        text = "hé llo" if r.doc_id == 1 else ""
        ids = brute(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
