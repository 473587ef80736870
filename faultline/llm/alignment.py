"""Alignment of two tokenizers: byte ends of their tokens cut a text into groups and link the tokens that overlap."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .chunks import MARK, Codes, marked, piece_cut, piece_model
from .common import written

#: Code points of a block of documents, if it has more than one.
BLOCK = 1 << 22
#: Words that are encoded as one text.
JOINED = 4_096
#: Pairs with more than one in HOT_PAIRS of all (document, pair) rows are looked up in a broadcast table: it has fewer rows than this.
HOT_PAIRS = 1 << 17
#: Two numbers below 2**31 in a long; the bit that tells an end of B from one of A.
_HIGH, _B = 1 << 32, 1 << 31


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=4)
def byte_model(raw: bytes):
    """(encode, bytes of each id) of a byte-level BPE file of the tokenizers library, without special tokens.

    If merges have the order of the ids and pre-tokens are those of the byte-level rule, the ids are ranks, and a faster library gives the same ids.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    spec = json.loads(raw)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    of = _byte_of()
    table = {i: bytes(map(of.__getitem__, token)) for token, i in vocab.items() if token not in special}
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
    first = spec.get("pre_tokenizer") or {}
    ranked = made == sorted(made) and len(made) + 256 == len(table) and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True) and not spec.get("normalizer")
    by_id = [table.get(i, b"") for i in range(max(table) + 1)]
    if ranked:
        engine = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in table.items()}, special_tokens={})
        return lambda chunks: [engine.encode_ordinary(" " + c) for c in chunks], by_id
    library = Tokenizer.from_str(raw.decode())
    library.encode_special_tokens = True
    return lambda chunks: [x.ids for x in library.encode_batch([" " + c for c in chunks], add_special_tokens=False)], by_id


@lru_cache(maxsize=4)
def piece_bytes(proto: bytes) -> list[bytes]:
    """The bytes of each piece, marks as spaces; byte pieces are that byte."""
    model = piece_model(proto)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]


@lru_cache(maxsize=4)
def _decimals(bits: int) -> pa.Array:
    """The numbers of at most so many bits as strings."""
    return pa.array(map(str, range(1 << bits)), pa.string())


_TOKENS = "array<struct<a: array<int>, a_end: array<int>, b: array<int>, b_end: array<int>>>"


def _nested(flat: np.ndarray, edges: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, kind or pa.int32()))


def _edges(lengths: np.ndarray) -> np.ndarray:
    """Where runs of these lengths begin and end in a row."""
    return np.concatenate([[0], np.cumsum(lengths)])


def _spread(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """All members of the lists in a row, and where each list begins and ends."""
    edges = _edges(np.fromiter(map(len, lists), np.int64, len(lists)))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(edges[-1])), edges


class Side(NamedTuple):
    """One tokenizer's ids of all words in a row, the byte length of each, and where each word begins and ends in them."""

    ids: np.ndarray
    sizes: np.ndarray
    edges: np.ndarray


def _ids_of(chunks: list[str], want: list[bytes], stops: np.ndarray, encode, table: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, set[int]]:
    """The ids of all words in a row, where each word begins and ends in them, and the words whose joined bytes are not those wanted.

    One text of many words is encoded at once: its borders are where the words' bytes end. Should they not be, each word is encoded by itself.
    """
    flat = np.array(encode([" ".join(chunks)])[0], np.int32)
    at = np.cumsum(sizes[flat])
    edges = np.searchsorted(at, stops) + 1
    if len(at) and edges[-1] == len(at) and (at[edges - 1] == stops).all() and b"".join(map(table.__getitem__, flat.tolist())) == b"".join(want):
        return flat, np.concatenate([[0], edges]), set()
    each = encode(chunks)
    wrong = {k for k, (x, w) in enumerate(zip(each, want)) if b"".join(map(table.__getitem__, x)) != w}
    return *_spread(each), wrong


def _tokens(texts: list[str | None], byte_raw: bytes, proto: bytes) -> tuple[Side, Side, np.ndarray, np.ndarray]:
    """Both sides of the distinct marked words of some texts; the words of all texts in a row, and where each text begins and ends in them."""
    (encode_a, bytes_a), (model, bytes_b) = byte_model(byte_raw), (piece_model(proto), piece_bytes(proto))
    sides = ((encode_a, bytes_a), (lambda chunks: model.encode(chunks, num_threads=1), bytes_b))
    cut, found = piece_cut(proto), Codes()
    look = found.__getitem__
    words = [list(map(look, cut(t))) if t else [] for t in texts]
    # Words that end in white space, or hold a mark, or are whole texts, can't stand before others in one text.
    chunks = list(found)
    single = np.array([cut is not marked or c[-1].isspace() or MARK in c for c in chunks], bool)
    groups = [g for g in np.array_split(np.flatnonzero(~single), max(1, int((~single).sum()) // JOINED)) if len(g)] + [[k] for k in np.flatnonzero(single)]
    rank = np.empty(len(chunks), np.int32)
    rank[[k for g in groups for k in g]] = np.arange(len(chunks))
    sizes = [np.array([len(t) for t in table]) for _, table in sides]
    parts, lengths, wrong = [[np.zeros(0, np.int32)] for _ in sides], [[np.zeros(0, np.int64)] for _ in sides], set()
    for g in groups:
        some = [chunks[k] for k in g]
        want = [(" " + w).encode() for w in some]
        stops = np.cumsum(np.fromiter(map(len, want), np.int64, len(want)))
        for k, (encode, table) in enumerate(sides):
            flat, edges, bad = _ids_of(some, want, stops, encode, table, sizes[k])
            wrong |= {int(rank[g[i]]) for i in bad}
            parts[k].append(flat)
            lengths[k].append(np.diff(edges))
    out = []
    for k in range(2):
        flat, n = np.concatenate(parts[k]), np.concatenate(lengths[k])
        if wrong:  # such words have no tokens, and their texts no words
            right = ~np.isin(np.arange(len(n)), list(wrong))
            flat, n = flat[np.repeat(right, n)], n * right
        out.append(Side(flat, sizes[k][flat], _edges(n)))
    flat, edges = _spread(words)
    flat = rank[flat]
    if wrong:
        gone = np.add.reduceat(np.append(np.isin(flat, list(wrong)), False), edges[:-1]) * (np.diff(edges) > 0) > 0
        flat, edges = flat[~np.repeat(gone, np.diff(edges))], _edges(np.diff(edges) * ~gone)
    return *out, flat, edges


def _by_block(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str, text: str, block: int, made: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """`made` of the ids and the tokens of each block of documents; {key} in the schema is the type of the ids."""
    context = docs.sparkSession.sparkContext
    raw, proto = context.broadcast(vocabulary(byte_path)), context.broadcast(vocabulary(piece_path))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in enumerate(batch.column("text").to_pylist()):
                if texts and size + len(t or "") > block:
                    yield made(pa.concat_arrays(ids), *_tokens(texts, raw.value, proto.value))
                    ids, texts, size = [], [], 0
                ids.append(batch.column("doc_id").slice(i, 1))
                texts.append(t)
                size += len(t or "")
        if texts:
            yield made(pa.concat_arrays(ids), *_tokens(texts, raw.value, proto.value))

    return rows.mapInArrow(run, schema.format(key=rows.schema["doc_id"].dataType.simpleString()))


def _token_block(ids: pa.Array, a: Side, b: Side, words: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    fields = []
    for side in (a, b):
        total = _edges(side.sizes)
        fields += [_nested(side.ids, side.edges), _nested(total[1:] - np.repeat(total[side.edges[:-1]], np.diff(side.edges)), side.edges)]
    tokens = pa.StructArray.from_arrays(fields, names=["a", "a_end", "b", "b_end"])
    counts = [pa.array(np.diff(_edges(np.diff(side.edges)[words])[edges]), pa.int64()) for side in (a, b)]
    each = pa.StructArray.from_arrays([ids, _nested(words, edges), *counts], names=["doc_id", "words", "n_a", "n_b"])
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays([one(each), one(tokens)], names=["docs", "chunks"])


def tokenise(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Blocks of documents: `chunks`, the tokens and their byte ends of the distinct marked words, and `docs`, each with its words in order.

    Tokens of neither side cross the border of a word, so that words align by themselves. Documents whose joined bytes differ
    from a space and the text have no words.
    """
    return _by_block(docs, byte_path, piece_path, doc_id, text, block, _token_block, f"docs array<struct<doc_id: {{key}}, words: array<int>, n_a: long, n_b: long>>, chunks {_TOKENS}")


def _aligned_block(ids: pa.Array, a: Side, b: Side, words: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    """Links and groups of each word by marks at the bytes where tokens end; then those of each text's words in a row.

    A byte at which a token of either side ends makes one link, of the two tokens that hold it; one at which both end closes a group.
    """
    ends = [np.cumsum(side.sizes) - 1 for side in (a, b)]
    at = [np.zeros(int(side.sizes.sum()), bool) for side in (a, b)]
    for mark, end in zip(at, ends):
        mark[end] = True
    either, both = np.flatnonzero(at[0] | at[1]), np.flatnonzero(at[0] & at[1])
    place = [np.cumsum(mark) for mark in at]
    of_a, of_b = (side.ids[n[either] - mark[either]].astype(np.int64) for side, n, mark in zip((a, b), place, at))
    links = of_a * _HIGH + of_b
    stops = _edges(a.sizes)[a.edges]
    # The words' groups as texts: ids with commas, sides with bars, groups with semicolons.
    names = [_decimals(int(side.ids.max(initial=0)).bit_length()).take(pa.array(side.ids)) for side in (a, b)]
    sides = [pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, n[both]), pa.int32()), name), ",") for n, name in zip(place, names)]
    groups = pa.ListArray.from_arrays(pa.array(np.searchsorted(both, stops), pa.int32()), pc.binary_join_element_wise(*sides, "|"))
    said = pc.binary_join(groups, ";").cast(pa.binary()).to_pylist()

    first = np.searchsorted(either, stops)
    n = np.diff(first)[words]
    total = _edges(n)
    links = links[np.repeat(first[words] - total[:-1], n) + np.arange(total[-1])]
    n_a, n_b = (np.diff(_edges(np.diff(side.edges)[words])[edges]) for side in (a, b))
    texts = [said[w] for w in words.tolist()]
    shas = [hashlib.sha256(b";".join(texts[i:j])).hexdigest() if j > i else "" for i, j in zip(edges, edges[1:])]
    links = _nested(links, total[edges], pa.int64())
    n_groups = n_a + n_b - np.diff(total[edges])
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups)), links, pa.array(shas, pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256"])


def aligned(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, links array<long>, groups_sha256) of each document; a link is the number a * 2**32 + b of its ids.

    Each distinct marked word of a block is tokenised and aligned once, all words of a block by the same array operations. `align_blocks`
    gives the same of tokenise's blocks by Spark's array functions.
    """
    return _by_block(docs, byte_path, piece_path, doc_id, text, block, _aligned_block, "doc_id {key}, n_a long, n_b long, n_groups long, links array<long>, groups_sha256 string")


def _pair(a: Column, b: Column) -> Column:
    return a.cast("long") * F.lit(_HIGH) + b


def align_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, links array<long>, groups string) of each document of tokenise's blocks; array functions only.

    All ends of a word are sorted as one array of numbers (end, side, place). At place j of it, an end of A with place i
    has j - i ends of B before it, which names the token of B that overlaps; likewise the other way round. An end of B that
    is an end of A too is a common end: it closes a group, and makes no link of its own. So each link comes once, in time linear in the tokens but for the sort.
    A link is the number a * 2**32 + b of its ids.
    """
    at = lambda e, i, side: e.cast("long") * F.lit(_HIGH) + (i + F.lit(side))
    merged = lambda c: F.sort_array(F.concat(F.transform(c["a_end"], lambda e, i: at(e, i, 0)), F.transform(c["b_end"], lambda e, i: at(e, i, _B))))
    keep = lambda c, *names: [c[n].alias(n) for n in names]

    def step(c: Column, x: Column, j: Column) -> Column:
        place = x.bitwiseAND(F.lit(_B - 1)).cast("int")
        of_a = F.get(c["a_end"], j - place - 1) == F.shiftright(x, 32)
        return (
            F.when(x.bitwiseAND(F.lit(_B)) == 0, _pair(F.get(c["a"], place), F.get(c["b"], j - place)))
            .when(of_a, -1 - _pair(j - place - 1, place))
            .otherwise(_pair(F.get(c["a"], j - place), F.get(c["b"], place)))
        )

    def group(c: Column, cuts: Column, v: Column, g: Column) -> Column:
        """The ids of the tokens between the common end before and this one."""
        before = F.coalesce(-1 - F.get(cuts, g - 1), F.lit(-_HIGH - 1))
        from_a, from_b = F.shiftright(before, 32), before.bitwiseAND(F.lit(_HIGH - 1))
        first_a, first_b = F.when(g == 0, 0).otherwise(from_a + 1).cast("int"), F.when(g == 0, 0).otherwise(from_b + 1).cast("int")
        last_a, last_b = F.shiftright(-1 - v, 32).cast("int"), (-1 - v).bitwiseAND(F.lit(_HIGH - 1)).cast("int")
        ids = lambda side, low, high: F.array_join(F.transform(F.sequence(low, high), lambda i: F.get(c[side], i).cast("string")), ",")
        return F.concat(ids("a", first_a, last_a), F.lit("|"), ids("b", first_b, last_b))

    # A lambda's variable holds what would else be found anew at each use.
    let = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    # Where all ends are common, as in most words, tokens pair one by one and that is all; only the other words' tokens are merged.
    pairs = lambda c: F.zip_with(c["a"], c["b"], _pair)
    strings = lambda x: x.cast("array<string>")
    said = lambda c: F.array_join(F.zip_with(strings(c["a"]), strings(c["b"]), lambda x, y: F.concat(x, F.lit("|"), y)), ";")
    made = lambda links, text: F.struct(links.alias("links"), text.alias("text"))

    def uneven(c: Column, s: Column) -> Column:
        text = let(F.filter(s, lambda x: x < 0), lambda cuts: F.array_join(F.transform(cuts, lambda v, g: group(c, cuts, v, g)), ";"))
        return made(F.filter(s, lambda x: x >= 0), text)

    def links_of(c: Column, common: Column) -> Column:
        even = F.size(common) >= F.greatest(F.size(c["a"]), F.size(c["b"]))
        return F.when(even, made(pairs(c), said(c))).otherwise(let(F.transform(merged(c), lambda x, j: step(c, x, j)), lambda s: uneven(c, s)))

    # One pass over the words, each of which is done with before the next begins: steps of all words side by side fill the heap.
    d = blocks.withColumn("chunks", F.transform("chunks", lambda c: let(F.array_intersect(c["a_end"], c["b_end"]), lambda common: links_of(c, common))))
    word = lambda w, name: F.get(F.col("chunks"), w)[name]
    out = F.transform(
        "docs",
        lambda x: F.struct(
            *keep(x, "doc_id", "n_a", "n_b"),
            F.flatten(F.transform(x["words"], lambda w: word(w, "links"))).alias("links"), F.array_join(F.transform(x["words"], lambda w: word(w, "text")), ";").alias("groups"),
        ),
    )
    # A link for each end of either side, common ones once; a group for each common one.
    return d.select(F.inline(out)).withColumn("n_groups", F.col("n_a") + F.col("n_b") - F.size("links"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n documents that hold it linked, best: n is the highest of its A id), a written table."""
    n = written(aligned.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    a = F.shiftright("pair", 32)
    top = n.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return written(n.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best")), "counts")


def align(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A: space and text by a byte-level BPE file; B: the text by a piece model that adds the space. Each distinct marked word of a block of
    documents is tokenised and aligned once (`aligned`). Counts of id pairs are sums that are partial before the shuffle. Most links are of few pairs: those of pairs that have more than one in HOT_PAIRS of all rows are looked up in a broadcast of
    fewer rows than that, the other pairs, none of them hot, meet their counts in a join.
    Defined cases: null and empty texts, and texts whose joined bytes differ from space and text on either side (a mark U+2581 in it), have
    zeros and an empty digest; each row counts as a document, repeated rows and null ids too; an empty table gives no
    rows; other columns are ignored. A document's links are one array: texts of some 100 million tokens are beyond it.
    """
    rows = aligned(docs, byte_path, piece_path, doc_id, text)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows)
    bound = (counts.agg(F.sum("n")).first()[0] or 0) // HOT_PAIRS
    hot = counts.where(F.col("n") > bound)
    links = rows.select("row", F.explode("links").alias("pair")).join(F.broadcast(hot), "pair", "left")
    sums = [F.sum("n").alias("count_sum"), F.sum("best").alias("n_best"), F.count("*").alias("times")]
    found = written(links.groupBy("row", F.when(F.col("n").isNull(), F.col("pair")).alias("pair")).agg(*sums), "linked")
    rare = found.where("pair IS NOT NULL").select("row", "pair", "times").join(counts.where(F.col("n") <= bound), "pair")
    rare = rare.select("row", (F.col("n") * F.col("times")).alias("count_sum"), (F.col("best") * F.col("times")).alias("n_best"))
    total = found.where("pair IS NULL").select("row", "count_sum", "n_best").unionByName(rare).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(total, "row", "left")
    known = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), known("n_best"), known("count_sum"), "groups_sha256")
