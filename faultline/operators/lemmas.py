"""Lemmas by rules that a corpus teaches: endings that its own words take on and off are rewritten, the longest first.

Two words that share a stem, one with a longer ending than the other, are evidence for rewriting the first ending to the second ("bearings", "bearing":
"s" to nothing). An ending becomes a rule if enough stems show it and if they are a fair share of all words that end so. There is no dictionary: irregular forms stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

STEM, ENDING, BASE = 3, 4, 2  # least letters of a stem, most of an ending, most of what takes its place
SUPPORT, SHARE, RULES = 5, 0.3, 256
DOCS = 2


def vocabulary(docs: DataFrame, text: str = "text", least: int = DOCS) -> DataFrame:
    """(word): content words (letters only, longer than two, no stop words) of at least so many rows; what stands in one alone is mostly noise."""
    words = docs.select(F.explode(F.array_distinct(T.content_tokens(F.col(text)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")


def rules(words: DataFrame, support: int = SUPPORT, share: float = SHARE, most: int = RULES) -> DataFrame:
    """(ending, base, support, total): at most one base an ending, that with most stems, then the shorter, then the first by its letters.

    `words` (word) are distinct; nulls drop out. All words count; at most `most` rules are kept, those with most stems, so that they go into an expression.
    Work: five rows a word, joined by stem.
    """
    cut = words.where("word IS NOT NULL").select("word", F.explode(F.sequence(F.lit(0), F.lit(ENDING))).alias("n")).where(F.length("word") - F.col("n") >= STEM)
    ends = cut.select(F.left("word", F.length("word") - F.col("n")).alias("stem"), F.right("word", F.col("n")).alias("end"))
    long, short = ends.where("end <> ''").withColumnRenamed("end", "ending"), ends.where(F.length("end") <= BASE).withColumnRenamed("end", "base")
    found = long.join(short, "stem").where(F.length("base") < F.length("ending")).groupBy("ending", "base").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    best = found.groupBy("ending").agg(F.min(F.struct((-F.col("support")).alias("less"), F.length("base").alias("size"), "base")).alias("b")).select("ending", "b.base", (-F.col("b.less")).alias("support"))
    total = long.groupBy("ending").agg(F.count("*").alias("total"))
    return best.join(total, "ending").where(F.col("support") >= share * F.col("total")).orderBy(F.desc("support"), "ending").limit(most)


def learnt(docs: DataFrame, text: str = "text") -> dict[str, str]:
    """{ending: base} of a corpus: at most RULES come to the driver."""
    return {r["ending"]: r["base"] for r in rules(vocabulary(docs, text)).collect()}


def lemma(word: Column, known: dict[str, str]) -> Column:
    """The word with its longest known ending rewritten once, where at least STEM letters stay; null is null."""
    if not known:
        return word
    table = F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])
    out = F.when(F.lit(False), word)
    for n in range(max(map(len, known)), 0, -1):
        base = F.element_at(table, F.right(word, F.lit(n)))
        out = out.when((F.length(word) - n >= STEM) & base.isNotNull(), F.concat(F.left(word, F.length(word) - n), base))
    return out.otherwise(word)


def lemma_tokens(text: Column, known: dict[str, str]) -> Column:
    """Lemmas of the content words of a text, in order, repeats kept."""
    return F.transform(T.content_tokens(text), lambda t: lemma(t, known))


def joined(text: Column, known: dict[str, str]) -> Column:
    """The lemmas of a text with one space between; empty if it has none, null if it is null."""
    return F.array_join(lemma_tokens(text, known), " ")
