"""Quality classifier: Bradley-Terry scores learnt from preference pairs, cut at a quantile of the scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import Batch, tables
from .common import Rolling
from .langid import held_out

#: Labelled rows learnt from, at most (about); preference pairs drawn from them; score at the threshold.
SAMPLE, PAIRS, CUT = 12_000, 40_000, 0.7
#: Characters counted one by one.
MARKS = ".,!?;:|$%&#*@-_=<>(){}[]/\\\"'"


def features(texts: list[str | None]) -> np.ndarray:
    """One row of numbers a text, from the text alone; null counts as empty.

    Shares of kinds of characters, lengths and shapes of words, and how much repeats: words equal to the one
    before or to any earlier one, lines equal to an earlier one, words that end in the same kind of mark.
    """
    b = Batch(texts)
    n, cp = b.n, b.cp
    size = np.maximum(b.size, 1)
    of_all = np.repeat(np.arange(n), b.size + 1)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of_all[mask], minlength=n)[:n].astype(float)

    space = (cp == 32) | ((cp >= 9) & (cp <= 13))
    upper, digit = tables()[1][cp], (cp >= 48) & (cp <= 57)
    out = [count(b.letter) / size, count(upper) / size, count(digit) / size, count(space) / size, count(cp == 10) / size]
    out += [count(cp == ord(m)) / size for m in MARKS]
    out += [count(~b.letter & ~space & ~digit & (cp != 0)) / size, np.log1p(b.size)]

    start, stop = b.runs(~space & (cp != 0))
    doc = b.of(start)
    words = np.maximum(np.bincount(doc, minlength=n)[:n], 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n)[:n] / words

    length = stop - start
    mean = np.bincount(doc, length, n)[:n] / words
    out += [np.log1p(words), mean / 10, np.sqrt(np.maximum(np.bincount(doc, length**2, n)[:n] / words - mean**2, 0)) / 10]
    out += [share(length > 15), share(length == 1), share(~b.letter[stop - 1]), share(upper[start] & upper[stop - 1] & (length > 1))]
    last = cp[stop - 1] if len(stop) else np.zeros(0, np.uint32)
    out += [share(np.isin(last, [ord(c) for c in "$%&#*!|"]))]

    rolling = Rolling(0x9E3779B97F4A7C15)
    low = tables()[2][cp].astype(np.uint64) + np.uint64(1)
    word = rolling.ranges(rolling.prefix(low), start, stop) if len(start) else np.zeros(0, np.uint64)
    again = np.zeros(len(word), bool)
    if len(word):
        again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        order = np.lexsort((word, doc))
        seen = np.zeros(len(word), bool)
        seen[order[1:]] = (word[order][1:] == word[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    else:
        seen = again
    # Long texts repeat words by nature: the share of distinct words is taken against its usual fall with length.
    out += [share(again), share(seen), share(seen) / np.log(words + 2)]
    line_start, line_stop = b.runs((cp != 10) & (cp != 0))
    line_doc = b.of(line_start)
    lines = np.maximum(np.bincount(line_doc, minlength=n)[:n], 1)
    if len(line_start):
        key = rolling.ranges(rolling.prefix(low), line_start, line_stop)
        order = np.lexsort((key, line_doc))
        same = (key[order][1:] == key[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
        out += [np.bincount(line_doc[order][1:][same], minlength=n)[:n] / lines]
    else:
        out += [np.zeros(n)]
    out += [np.log1p(size / lines) / 10]
    x = np.stack(out, 1)
    # Small shares tell as much as large ones: each feature also by its square root, and whether it is there at all.
    return np.hstack([x, np.sqrt(np.abs(x)), x > 1e-9])


@dataclass
class Ranker:
    """Utility w . (x - mean) / scale; score = logistic(slope * (utility - cut) + logit(CUT))."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    cut: float
    slope: float

    def utility(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.utility(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def learn(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 5, ridge: float = 1e-2, rounds: int = 25) -> Ranker:
    """Bradley-Terry: a text of label 1 beats one of label 0 with probability logistic(u1 - u0), u linear.

    Newton steps on the logistic loss of feature differences over seeded random pairs, with a ridge. The cut
    is the quantile of the utilities that parts the labels best (in balanced accuracy; the middle of ties).
    With rows of one label only, or none, there are no pairs: all utilities are 0 and every text scores CUT.
    """
    if len(x) == 0:
        k = features([""]).shape[1]
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1e9  # a feature that never varies has no weight
    z, rng = (x - mean) / scale, np.random.default_rng(seed)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return Ranker(mean, scale, w, 0.0, 1.0)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))  # probability of the wrong order
        grad = -(d * p[:, None]).mean(0) + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    u = z @ w
    grid = np.quantile(u, np.linspace(0, 1, 2001))
    grid = np.concatenate([grid, (grid[1:] + grid[:-1]) / 2])
    right = np.array([(u[good] >= c).mean() + (u[bad] < c).mean() for c in grid])
    cut = float(np.median(grid[right >= right.max() - 1e-12]))
    return Ranker(mean, scale, w, cut, float(min(1.0, 20 / max(1e-9, np.abs(u - cut).max()))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Ranker:
    """Learn from the labelled rows of docs whose ids are not held out, at most about `sample` of them, chosen by a hash of the id.

    The chosen labels (a few hundred KB at most) are broadcast to the scan of docs; the driver gets `sample` rows of features.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(quality).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label"))
    share = min(1.0, sample / max(1, labels.count()))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(F.lit(3), "label_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    rows = docs.select(F.col(doc_id).alias("label_id"), F.col(text).alias("text")).join(F.broadcast(known), "label_id").select("label_id", "text", "label")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label_id": b["label_id"], "label": b["label"], "x": list(features(b["text"].tolist()))})

    got = rows.mapInPandas(run, "label_id long, label int, x array<double>").toPandas().sort_values("label_id", kind="stable")
    return learn(np.stack(got["x"].to_list()) if len(got) else np.zeros((0, 0)), got["label"].to_numpy())


def score(docs: DataFrame, ranker: Ranker, text: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (1 from CUT on) of each text; null texts score as empty ones.

    Only the text is looked at. All rows and columns stay (a column of one of the two names is replaced);
    repeated rows score alike; an empty table gives an empty table. No shuffle.
    """
    docs = docs.drop(score, predicted)
    sent = docs.sparkSession.sparkContext.broadcast(ranker)  # a few hundred floats

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(sent.value.score(features(t.tolist())) if len(t) else np.zeros(0))

    return docs.withColumn(score, scored(F.col(text))).withColumn(predicted, (F.col(score) >= CUT).cast("int"))
