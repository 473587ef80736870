"""Scalar text functions as Column expressions; Python only where no built-in exists (token_set_ratio, NFKC)."""

from __future__ import annotations

import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and \s see it, for Java regular expressions; spelled out, as classes by property are slow.
_ODD_WS = "\\t-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WS = f"[ {_ODD_WS}]"

# Texts that stand for "nothing".
NOT_EMBEDDED = ("", "-", "n/a", "na", "null", "none", "tbd", "to be defined")
NOT_A_NUMBER = ("", "n/a", "na", "null", "none", "-")

# Words that mark a valuable sentence. Fused words are as they have to be.
FAIL_WORDS = (
    "fail", "failure", "error", "issue", "problem", "falsestopped", "non-functional", "no-start", "restart", "start-up",
    "broken", "break", "destroyed", "burnt", "damaged", "overstressed", "degraded", "blown", "blow uploop", "blocked",
    "latched", "trip", "shutdown", "inrush", "overcurrent", "short", "leakage", "overvoltage", "undervoltage",
    "exceeded", "dip", "oscillation", "resonance", "explosion", "crater", "overshoot",
)
CAUSE_WORDS = (
    "because", "due", "caused", "lead", "leads", "when", "while", "after", "during", "if", "therefore", "however",
    "thus", "since", "result", "exceed", "limit", "rating",
)
#: Words that carry no meaning of their own; stands in for a language model's stop list.
STOP_WORDS = tuple("the and for are was were with that this from have has had not but you all any can her his its our out she they their them then there these those will would been being than too very which who whom what when where why how into over under again once only own same such more most some each few both between during before after above below off down about against through because until while does did doing just should now".split())


def _seen(c: Column) -> Column:
    """Is a character a printable ASCII one, so that there is nothing to strip."""
    return c.between("!", "~")


def strip(x: Column) -> Column:
    # Most texts, but for plain spaces, begin and end with such a character: they pass without a regular expression.
    y = F.trim(x)
    return F.when(_seen(F.substring(y, 1, 1)) & _seen(F.substring(y, -1, 1)), y).otherwise(F.regexp_replace(x, f"^{WS}+|{WS}+$", ""))


_WS_SIGNS = " " + "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip_short(x: Column) -> Column:
    """strip() as one expression that names x once: nested or side by side, many of strip() make methods that are too long to be compiled. For short texts."""
    return F.btrim(x, F.lit(_WS_SIGNS))


def collapse(x: Column) -> Column:
    """Runs of white space as one space; single spaces, the usual case, are not touched."""
    return F.regexp_replace(x, f"[{_ODD_WS}]{WS}*| {WS}+", " ")


def normalize_key(x: Column) -> Column:
    """Deduplication key: null is empty; trimmed before punctuation turns into spaces, so "fails." keeps a space at its end."""
    return F.regexp_replace(strip(F.lower(F.coalesce(x, F.lit("")))), "[^a-z0-9]+", " ")


def normalize_plain(x: Column) -> Column:
    """Letters a-z, digits and single spaces; trimmed last."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def normalize_spaces(x: Column) -> Column:
    """Lower case, trimmed, single spaces; punctuation stays."""
    # Collapsed white space is plain spaces: trimming them is strip(), without its conditions, which would make the text up to five times.
    return F.trim(collapse(F.lower(x)))


def normalize_valuable(x: Column) -> Column:
    """Lower case without dd-mm-yyyy dates and motor numbers."""
    x = F.regexp_replace(F.lower(x), r"(?U)\b\d{1,2}-\d{1,2}-\d{4}\b", "")
    return F.trim(collapse(F.regexp_replace(x, r"(?U)motor\s*\d+", "motor")))


def _nfkc(x: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(run, "string")(x)


def normalize_document(x: Column) -> Column:
    """Paragraph text of reports: NFKC, LF line ends, bullets as dashes, single blanks, two line ends at most."""
    x = F.regexp_replace(F.regexp_replace(_nfkc(x), "\r\n?", "\n"), "[•●▪▫–—]", "-")
    return strip(F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "\n{3,}", "\n\n"))


def is_blank(x: Column) -> Column:
    return strip(x) == ""


def is_embeddable(x: Column) -> Column:
    return F.coalesce(~strip(F.lower(x)).isin(*NOT_EMBEDDED), F.lit(False))


def parse_number(x: Column) -> Column:
    """Text to double: integers, or decimals if a dot is there (then with exponent too); place-holders and all else are null."""
    t = strip(x.cast("string"))
    whole = t.rlike(r"^[+-]?\d+(_\d+)*$")
    decimal = t.rlike(r"^[+-]?(\d+(_\d+)*)?\.(\d+(_\d+)*)?([eE][+-]?\d+)?$") & t.rlike(r"\d\.|\.\d")
    number = F.regexp_replace(t, "_", "").try_cast("double")
    return F.when(F.lower(t).isin(*NOT_A_NUMBER), None).when(whole | decimal, number)


def is_numeric_like(x: Column) -> Column:
    t = strip(x.cast("string"))
    return F.coalesce(t.rlike(r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$|^[+-]?(nan|inf|infinity)$"), F.lit(False))


def strip_prefix(x: Column) -> Column:
    """Without one leading [..]; null is empty."""
    return strip_short(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), f"(?U)^\\[[^\\]]+\\]{WS}*", ""))


def discipline_and_cause(x: Column) -> Column:
    """struct(discipline, cause) of "[S01 - HW] text"; without such a prefix no discipline."""
    pattern = f"(?U)^\\[[^\\]-]*-{WS}*([A-Za-z]+)\\]{WS}*(.*)"
    x = F.coalesce(x.cast("string"), F.lit(""))
    # Only the first line behind the prefix counts, as a dot stops at line ends.
    hit = x.rlike(pattern)
    cause = F.when(hit, strip_short(F.regexp_extract(x, pattern, 2))).otherwise(strip_prefix(x))
    return F.struct(F.when(hit, F.regexp_extract(x, pattern, 1)).otherwise(F.lit("")).alias("discipline"), cause.alias("cause"))


def header_name(x: Column) -> Column:
    return strip_short(collapse(F.lower(x.cast("string"))))


def find_8d_id(text: Column, file_name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"8D\d+", 0), F.lit("")), file_name)


def prefix_8d(number: Column) -> Column:
    """"8D" and the first eight digits of a series number."""
    return F.concat(F.lit("8D"), F.substring(F.regexp_replace(number.cast("string"), r"\D", ""), 1, 8))


def json_slice(x: Column) -> Column:
    """The text from the first { to the last }, where a model's answer wraps its JSON; null if there is none."""
    return F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "[.!?]", -1), strip), lambda s: s != "")


def valuable_sentences(x: Column) -> Column:
    """sentences(normalize_valuable(x)) in one split: what is normalised has single spaces only, which go with the marks beside them."""
    return F.array_remove(F.split(normalize_valuable(x), " ?[.!?][ .!?]*", -1), "")


def has_words(x: Column, n: int) -> Column:
    """Has a text of single spaces at least n words; it is read up to the n-th word only."""
    return F.substring_index(x, " ", n - 1) != x


def tokens(x: Column) -> Column:
    return F.filter(F.split(normalize_plain(x), " ", -1), lambda t: t != "")


def repeated_size(a: Column, known: Column) -> Column:
    """How many of a's elements, repeats counted, are known."""
    return F.size(F.filter(a, lambda t: F.array_contains(known, t)))


def content_tokens(x: Column) -> Column:
    """Words of letters only, longer than two, that are no stop words: what lemmas are compared by, without lemmatising."""
    return _content(_words(x))


def _words(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _content(words: Column) -> Column:
    return F.filter(words, lambda t: t.rlike(r"^\p{L}{3,}$") & ~t.isin(*STOP_WORDS))


def content_words(x: Column) -> Column:
    """The distinct content_tokens, in the order of their first places."""
    return _content(F.array_distinct(_words(x)))


def set_coverage(a: Column, b: Column) -> Column:
    """Share of a's distinct tokens that b has; 0 if a is empty."""
    n = F.size(F.array_distinct(a))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def bag_coverage(a: Column, b: Column) -> Column:
    """Share of a's tokens, repeats counted, that b has; 0 if a is empty."""
    # The lambda's variable holds the common tokens, which would else be found anew for each token of a.
    share = F.element_at(F.transform(F.array(F.array_intersect(a, b)), lambda known: repeated_size(a, known)), 1) / F.size(a)
    return F.when(F.size(a) > 0, share).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def sentence_value(s: Column) -> Column:
    """Twice the distinct failure words, the distinct causal words, and up to 1 for length."""
    words = F.array_distinct(F.regexp_extract_all(s, F.lit(r"[a-z0-9]+(?:-[a-z0-9]+)*"), F.lit(0)))
    has = lambda known: F.size(F.array_intersect(words, F.array(*map(F.lit, known))))
    return has(FAIL_WORDS) * 2 + has(CAUSE_WORDS) + F.least(F.size(words) / 20.0, F.lit(1.0))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word of bits a character of a (bit-parallel)."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask = (1 << len(a)) - 1
    v = mask
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & mask
    return len(a) - v.bit_count()


def _common_letters(a: str, b: str) -> int:
    """How many characters both have, repeats counted: no common subsequence is longer."""
    mine, other = Counter(a), Counter(b)
    return sum(min(n, other[c]) for c, n in mine.items())


def token_set_ratio_of(a: str, b: str, low: float = -1.0) -> float:
    """0-100: likeness of two texts as sets of tokens; a set inside the other is 100, an empty text 0.

    The greatest of three ratios 2 * LCS / (lengths) between the sorted common tokens, and those followed by
    either text's own. As the common tokens stand first in all three, only the rests need an LCS, and no LCS is made
    where the shorter rest, or the letters that both rests have, can't lift the ratio over the other two or over `low`: what is
    returned then is no more than the greater of `low` and the true ratio, and the true ratio if that is above `low`.
    """
    return _ratio_of(set(a.split()), set(b.split()), low)


def _joined_size(tokens: set[str]) -> int:
    return sum(map(len, tokens)) + max(len(tokens) - 1, 0)


def _ratio_of(x: set[str], y: set[str], low: float, size: int | None = None) -> float:
    """token_set_ratio_of two sets of tokens; `size`: of y's joined tokens, if it is known. Neither is sorted nor joined where no LCS is made."""
    if not x or not y:
        return 0.0
    both, left = x & y, x - y
    if both and (not left or len(both) == len(y)):
        return 100.0
    common, space = _joined_size(both), " " if both else ""
    one = len(space) + _joined_size(left)
    two = len(space) + (_joined_size(y) if size is None else size) - common - len(space)
    ratio = lambda same, n: 200.0 * same / n
    best = max(ratio(common, 2 * common + n) for n in (one, two)) if both else 0.0
    total, bar = 2 * common + one + two, max(best, low)
    if ratio(common + min(one, two), total) <= bar:
        return best
    mine, other = space + " ".join(sorted(left)), space + " ".join(sorted(y - x))
    if ratio(common + _common_letters(mine, other), total) <= bar:
        return best
    return max(best, ratio(common + lcs(mine, other), total))


def token_set_ratio(a: Column | str, b: Column | str, low: Column | None = None) -> Column:
    """token_set_ratio_of as an Arrow-batched UDF; exact above `low`, at or under it maybe less."""

    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else token_set_ratio_of(p, q, r) for p, q, r in zip(x, y, z)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b, F.lit(-1.0) if low is None else low)


def token_set_ratios(texts: Column, source: Column, low: Column) -> Column:
    """token_set_ratio of each of an array of texts to one source, whose tokens are found once; `low` has a bound for each."""

    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        out = []
        for many, one, bars in zip(x, y, z):
            known = set(one.split())
            size = _joined_size(known)
            out.append([_ratio_of(set(t.split()), known, bar, size) for t, bar in zip(many, bars)])
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")(texts, source, low)


def best_likeness_of(a: str, b: str) -> float:
    """0-1: the greater of token_set_ratio_of / 100 and the share of a's tokens, repeats counted, that b has."""
    mine, known = [t for t in a.split(" ") if t], set(b.split(" "))
    share = sum(t in known for t in mine) / len(mine) if mine else 0.0
    return share if share == 1.0 else max(share, token_set_ratio_of(a, b, 100.0 * share) / 100.0)


def best_likeness(a: Column | str, b: Column | str) -> Column:
    """best_likeness_of as an Arrow-batched UDF."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else best_likeness_of(p, q) for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def node_id(label: str, key: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}::{key}::"), F.coalesce(value.cast("string"), F.lit("None")))
