"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels the spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import Batch

#: Hash buckets of letter trigrams; documents of each language that a model is fitted on, at most (about); cost of a switch in nats.
BUCKETS, SAMPLE, SWITCH = 1 << 16, 2_000, 12.0
#: First code points of script ranges and the script from there on (Unicode blocks, coarse).
SCRIPT_STARTS = np.array([0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0780, 0x0900, 0x0E00, 0x0E80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3130, 0x3190, 0x31F0, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000])
SCRIPTS = np.array("Latin Greek Cyrillic Armenian Hebrew Arabic Other Indic Thai Other Georgian Hangul Other Latin Greek Other Kana Other Hangul Other Kana Han Other Hangul Other Han Other Han".split())
_CODES = {s: i for i, s in enumerate(sorted(set(SCRIPTS)))}
_SCRIPT = np.array([_CODES[s] for s in SCRIPTS])


def held_out(doc_id: Column) -> Column:
    """True for documents that nothing is learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """langs; weight[bucket, lang]: log probabilities of trigrams; allowed[script, lang]: is the script that language's."""

    langs: list[str]
    weight: np.ndarray
    allowed: np.ndarray


def words_of(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of runs of letters, the text each is in, and the script of each one's first letter."""
    start, stop = batch.runs(batch.letter)
    script = _SCRIPT[np.searchsorted(SCRIPT_STARTS, batch.cp[start], "right") - 1]
    return start, stop, batch.of(start), script


def fit(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from about `sample` rows of each language (all, if there are fewer), chosen by a hash of doc_id and text.

    Counts of trigrams and of scripts are summed by Spark; the driver gets at most BUCKETS + scripts rows a language.
    """
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    share = rows.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    # One row a language, as the model has one column a language.
    rows = rows.join(F.broadcast(share), "lang").where(draw).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, group in b.groupby("lang"):
                batch = Batch(group["text"].tolist())
                grams = np.bincount(batch.trigrams(np.flatnonzero(batch.letter), BUCKETS), minlength=BUCKETS)
                scripts = np.bincount(words_of(batch)[3], minlength=len(_CODES))
                n = np.concatenate([grams, scripts])
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": name, "at": at, "n": n[at]})

    counts = rows.mapInPandas(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    n = np.zeros((BUCKETS + len(_CODES), len(langs)))
    n[counts["at"], counts["lang"].map({x: i for i, x in enumerate(langs)}).astype(int)] = counts["n"]
    grams, scripts = n[:BUCKETS] + 0.5, n[BUCKETS:]
    weight = np.log(grams / grams.sum(0)) if langs else grams
    allowed = scripts >= 0.01 * np.maximum(scripts.sum(0), 1)
    return Model(langs, weight.astype(np.float32), allowed | ~allowed.any(1, keepdims=True))


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The labels of words (rows) that maximise the sum of their scores less `switch` a change of label.

    A path leaves the overall best label in runs of words, each of which costs a switch at least, or never has it and switches
    among the others, or is one other label, which has a lesser sum. So if no run of words gains more than one switch by the best other label of each word,
    the overall best is all of the path. Only other texts take the step-by-step recursion.
    """
    n, k = scores.shape
    best = int(scores.sum(0, dtype=np.float64).argmax())
    if k == 1 or n == 1:
        return np.full(n, best)
    gain = np.cumsum(np.delete(scores, best, axis=1).max(1) - scores[:, best], dtype=np.float64)
    low = np.minimum.accumulate(np.append(0.0, gain[:-1]))
    if (gain - low).max() <= switch:
        return np.full(n, best)
    back, at = np.empty((n, k), np.int8 if k < 128 else np.int32), scores[0].astype(np.float64)
    every = np.arange(k)
    for i in range(1, n):
        top = int(at.argmax())
        stay = at >= at[top] - switch
        back[i] = np.where(stay, every, top)
        at = np.where(stay, at, at[top] - switch) + scores[i]
    path = np.empty(n, np.int64)
    path[-1] = at.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def label(docs: DataFrame, model: Model, switch: float = SWITCH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans) of each row: spans of (start, stop, lang) in code points.

    lang_pred is the language of most letters, score its share of the letters. Null texts, texts without a
    letter, and any text if no language was learnt, are `und` with score 0 and no spans. Repeated rows each
    have a row; ties go to the first language by name; an empty table gives no rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 floats a language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for b in batches:
            batch = Batch(b["text"].tolist())
            lang, score, spans = ["und"] * batch.n, [0.0] * batch.n, [[] for _ in range(batch.n)]
            start, stop, doc, script = words_of(batch)
            if len(start) and model.langs:
                letters = np.flatnonzero(batch.letter)
                of_word = np.add.reduceat(model.weight[batch.trigrams(letters, BUCKETS)], np.searchsorted(letters, start), axis=0)
                of_word = np.where(model.allowed[script], of_word, of_word - 1e4)
                first = np.searchsorted(doc, np.arange(batch.n + 1))
                for i in np.flatnonzero(np.diff(first)):
                    own = slice(first[i], first[i + 1])
                    path = viterbi(of_word[own], switch)
                    weight = np.bincount(path, stop[own] - start[own], len(model.langs))
                    lang[i], score[i] = model.langs[int(weight.argmax())], float(weight.max() / weight.sum())
                    cut = np.flatnonzero(np.diff(path, prepend=-1))
                    ends = stop[own][np.append(cut[1:], len(path)) - 1] - batch.start[i]
                    spans[i] = [{"start": int(s), "stop": int(e), "lang": model.langs[p]} for s, e, p in zip(start[own][cut] - batch.start[i], ends, path[cut])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": lang, "score": score, "spans": spans})

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, spans array<struct<start:int,stop:int,lang:string>>")


def identify(docs: DataFrame, sample: int = SAMPLE, switch: float = SWITCH, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the rows of docs that are not held out, then label all rows."""
    return label(docs, fit(docs.where(~held_out(F.col(doc_id))), sample, doc_id, text, lang), switch, doc_id, text)
