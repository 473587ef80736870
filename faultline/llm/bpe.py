"""Byte-level BPE: overlapping chunks, stitched where pre-token borders meet, encoded piece by piece."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points a chunk advances by, and how far it reaches into the next one.
CHUNK, OVERLAP = 32_768, 2_048


def vocabulary(path: str) -> bytes:
    """The rank file's bytes, read on the driver: base64 token and rank a line, under 1 MB."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def _ranks(vocab: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocab.splitlines()) if token}


@lru_cache(maxsize=4)
def encoder(vocab: bytes, pattern: str):
    """A merge engine for the ranks; one a worker process."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(vocab), special_tokens={})


@lru_cache(maxsize=4)
def byte_table(vocab: bytes) -> list[bytes]:
    """The bytes of each id; ids that no token has are empty."""
    table = [b""] * (max(_ranks(vocab).values()) + 1)
    for token, rank in _ranks(vocab).items():
        table[rank] = token
    return table


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def borders(chunk: str, pattern: str, at: int, last: bool) -> list[int]:
    """Starts of the pre-tokens of a chunk that begins at `at`, those only that the chunk's end can't have changed.

    A match depends on the text up to one code point behind it; so matches that end before the chunk's last
    code point are those of the whole text, given the same start. What follows the last sure match is a border too.
    """
    out, sure = [at], len(chunk) - 1
    for m in _splitter(pattern).finditer(chunk):
        if not last and m.end() >= sure:
            break
        out.append(at + m.end())
    return out


def _long_pieces(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc, part, piece) of texts over `chunk` code points: cut at true pre-token borders near multiples of `chunk`."""
    starts = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / chunk).cast("int"))
    chunks = long.select("doc", F.char_length("text").alias("n"), "text", F.explode(starts).alias("k"))
    chunks = chunks.select("doc", "k", "n", F.substring(F.col("text"), F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("chunk"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            head, tail = [], []
            for k, n, text in zip(b["k"], b["n"], b["chunk"]):
                at = int(k) * chunk
                found = borders(text, pattern, at, at + len(text) >= n)
                head.append([x for x in found if x < at + overlap])
                tail.append([x for x in found if x >= at + chunk])
            yield pd.DataFrame({"doc": b["doc"], "k": b["k"], "head": head, "tail": tail})

    scanned = chunks.repartition("doc", "k").mapInPandas(scan, "doc string, k int, head array<int>, tail array<int>")

    def stitch(one: pd.DataFrame) -> pd.DataFrame:
        """One row a piece of a document; its chunks' borders are a small part of the document itself."""
        one = one.sort_values("k")
        cuts, before = [0], None
        for head, tail in zip(one["head"], one["tail"]):
            if before is not None:
                both = sorted(set(before.tolist()) & set(head.tolist()))
                both = [x for x in both if x > cuts[-1]]
                if not both:  # a run longer than the overlap: all that follows is one piece
                    break
                cuts.append(both[0])
            before = tail
        return pd.DataFrame({"doc": one["doc"].iloc[0], "part": range(len(cuts)), "start": cuts, "stop": [*cuts[1:], -1]})

    cuts = scanned.groupBy("doc").applyInPandas(stitch, "doc string, part int, start int, stop int")
    stop = F.when(F.col("stop") < 0, F.char_length("text")).otherwise(F.col("stop"))
    return cuts.join(long, "doc").select("doc", "part", F.substring(F.col("text"), F.col("start") + 1, stop - F.col("start")).alias("piece")).repartition("doc", "part")


def _encoded(df: DataFrame, column: str, vocab, pattern: str) -> DataFrame:
    """df with `column`, a text, replaced by `ids`."""
    keep = [c for c in df.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocab.value, pattern).encode_ordinary
        for b in batches:
            offsets, flat = [0], []
            for text in b.column(column).to_pylist():
                flat += encode(text or "")
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), ids], names=[*keep, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != column)
    return df.mapInArrow(run, f"{schema}, ids array<int>")


def encode(docs: DataFrame, vocab_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids array<int>) of each row of docs: byte-level BPE of the whole text, no special tokens.

    Texts of up to `chunk` code points are encoded where they are read. Longer ones are cut into overlapping
    chunks that are pre-tokenised in parallel; where a border of a chunk's overlap is also a border of the next
    chunk, both agree from there on, and the text is cut there. The pieces are encoded in parallel and joined.
    Where an overlap has no common border (one run of letters or spaces through all of it), the rest of the
    text is one piece, so ids are always those of the text as a whole.
    Defined cases: null and empty texts have no ids; repeated rows each have a row; an empty table gives no
    rows; other columns are ignored, whatever their names; doc_id may be null.
    """
    spark: SparkSession = docs.sparkSession
    vocab = spark.sparkContext.broadcast(vocabulary(vocab_path))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.char_length("text"), F.lit(0)) > chunk
    short = _encoded(rows.where(~is_long), "text", vocab, pattern)
    # Repeated long rows are encoded once; `times` brings them back.
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256))
    long = rows.where(is_long).groupBy("doc_id", "text").agg(F.count("*").cast("int").alias("times")).withColumn("doc", key)
    parts = _encoded(_long_pieces(long.select("doc", "text"), pattern, chunk, overlap), "piece", vocab, pattern)
    joined = parts.groupBy("doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "ids"))), lambda p: p["ids"])).alias("ids"))
    joined = joined.join(long.select("doc", "doc_id", "times"), "doc").select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return short.unionByName(joined.select("doc_id", "ids"))


def decode(encoded: DataFrame, vocab_path: str, ids: str = "ids") -> DataFrame:
    """`encoded` with a column `decoded` (binary): the tokens' bytes, concatenated. Null ids give null."""
    vocab = encoded.sparkSession.sparkContext.broadcast(vocabulary(vocab_path))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(vocab.value)
        for b in batches:
            raw = [None if x is None else b"".join(map(table.__getitem__, x)) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def digests(docs: DataFrame, vocab_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; both digests of the real outputs of encode and decode."""
    out = decode(encode(docs, vocab_path, pattern, doc_id, text), vocab_path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
