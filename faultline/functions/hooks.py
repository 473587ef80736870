"""Places for models: embedding and extraction, each a callable on batches, with a deterministic stand-in."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T


def hashed_tokens(texts: list[str], size: int = 64) -> list[list[float]]:
    """Unit vectors of hashed token counts: a stand-in where no model is at hand."""
    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % size] += 1 if h & 1 << 20 else -1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


def embed(rows: DataFrame, text: str = "text", model: Callable[[list[str]], list[list[float]]] = hashed_tokens, prefix: str = "") -> DataFrame:
    """rows with `embedding` of the text behind a prefix such as "Failure cause: "."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model([prefix + (t or "") for t in b]))

    return rows.withColumn("embedding", run(F.col(text)))


def extract(docs: DataFrame, model: Callable[[list[str]], list[str]] | None, schema: str, text: str = "text") -> DataFrame:
    """docs with `answer`, a model's JSON parsed by a schema (null where it does not parse), or null without a model."""
    if model is None:
        return docs.withColumn("answer", F.lit(None).cast(schema))

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model(["" if t is None else t for t in b]))

    return docs.withColumn("answer", F.from_json(T.json_slice(ask(F.col(text))), schema))


def first_sentences(prompts: list[str], k: int = 3) -> list[str]:
    """The stand-in of a model that picks sentences from a section: the first k, its name left out."""
    out = []
    for p in prompts:
        # Sentences are cut off one by one, as the rest of a long text isn't picked.
        found = (re.sub(r"[ \t\n\r\f\v]+", " ", s[0]).strip(" ") for s in re.finditer("[^.!?]+", p.split("\n", 1)[1]))
        out.append("Here they are: " + json.dumps({"sentences": list(islice(filter(None, found), k))}))
    return out


def signals_as_case(prompts: list[str]) -> list[str]:
    """The stand-in of a model that makes a case of signals: the first of D2 and of D3, and those of D4 as causes, every other one with a discipline."""
    out = []
    for p in prompts:
        blocks: dict[str, list[str]] = {}
        for line in p.split("\n"):
            if head := re.fullmatch(r"(D\d):", line):
                lines = blocks.setdefault(head[1], [])
            elif said := re.match(r"- \[id:[^\]]*\] (.*) \(status=", line):
                lines.append(said[1])
        first = lambda name: next(iter(blocks.get(name, ())), None)
        causes = [{"failure_cause": c} | ({"discipline_type": "MCH"} if i % 2 else {}) for i, c in enumerate(blocks.get("D4", ()))]
        out.append(json.dumps({"failure_mode": first("D2"), "failure_effect": first("D3"), "root_causes": causes}))
    return out
