"""SentencePiece encoding and decoding through tables of distinct marked words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .chunks import ChunkTable, piece_cut, piece_model


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row of docs: the pieces of the whole text, without begin and end ids, without sampling.

    No piece of the model crosses the mark of a word, so a task keeps a table of the distinct marked words of its
    documents (of bounded size), segments each word of it once, and joins the ids back to the documents by
    the words' positions. Where a model's pieces may cross marks, or it normalises texts, a chunk is a whole text.
    Nothing is shuffled; a lost task is run again by itself.
    Defined cases: null and empty texts have no ids; a space is a token as any other; a text without spaces is one
    word, however long; marks (U+2581) in a text stay with the word before them; repeated rows each have a row; an empty
    table gives no rows; other columns are ignored, whatever their names; doc_id may be null.
    """
    proto = docs.sparkSession.sparkContext.broadcast(vocabulary(model_path))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(proto.value)
        table = ChunkTable([lambda chunks: model.encode(chunks, num_threads=1)], piece_cut(proto.value))
        for b in batches:
            ((flat, offsets),) = table.ids(b.column("text").to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """`encoded` with a column `decoded`, the text of its ids as the model's decode gives it. Null ids give null, no ids an empty text."""
    proto = encoded.sparkSession.sparkContext.broadcast(vocabulary(model_path))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(proto.value)
        for b in batches:
            found = b.column(ids).to_pylist()
            texts = iter(model.decode([x for x in found if x]) if any(found) else [])
            out = [next(texts) if x else (None if x is None else "") for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, f"{schema}, decoded string")


def digests(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; both digests of the real outputs of encode and decode."""
    out = decode(encode(docs, model_path, doc_id, text), model_path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
