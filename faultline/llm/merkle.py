"""Document fingerprints: a Merkle tree over the pieces, paragraphs and sections of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Paragraphs to a section.
SECTION = 8
#: Digits of a section's or paragraph's digest in the printed tree; the root has all 64.
DIGITS = 16
#: Rows of a range of ids, about, that one task orders; parts of a range at most, which bounds what is broadcast.
ROWS, PARTS = 4_000, 1_024
#: Marks at which a paragraph falls into pieces, the leaves: sentences, clauses and table cells.
PIECE = r"[.!?,;:|]"
#: Characters from which a piece is cut further; of a cut piece about, and at most; of words that are cut inside.
LONG, MEAN, MOST, WORD = 80, 16, 64, 32
#: Words of a cut piece, about.
WORDS = 4


def _digest(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, DIGITS)


def pieces(p: Column) -> Column:
    """The pieces of a paragraph. A long one is cut at places that its content names, so that an edit leaves the other cuts where they are.

    That is behind words that hash to 0, or, inside long runs without blank (scripts that have none), behind
    three characters that do; and after MOST characters without such a place.
    """
    parts = lambda marked: F.regexp_extract_all(marked, F.lit(rf"[^\n]{{1,{MOST}}}"), F.lit(0))

    def in_word(chars: Column) -> Column:
        ends = lambda c, i: F.pmod(F.xxhash64(F.get(chars, i - 2), F.get(chars, i - 1), c), F.lit(MEAN)) == 0
        return F.array_join(F.transform(chars, lambda c, i: F.when(ends(c, i), F.concat(c, F.lit("\n"))).otherwise(c)), "")

    def word(w: Column) -> Column:
        behind = F.when(F.pmod(F.xxhash64(w), F.lit(WORDS)) == 0, F.concat(w, F.lit("\n"))).otherwise(w)
        return F.when(F.char_length(w) <= WORD, behind).otherwise(F.element_at(F.transform(F.array(F.split(w, "")), in_word), 1))

    def one(x: Column) -> Column:
        marked = F.array_join(F.transform(F.split(x, " ", -1), word), " ")
        return F.when(F.char_length(x) <= LONG, F.array(x)).otherwise(F.regexp_extract_all(marked, F.lit(rf"[^\n]{{1,{MOST}}}"), F.lit(0)))

    return F.flatten(F.transform(F.split(p, PIECE, -1), one))


def hashed(text: Column) -> Column:
    """The lowest levels of the tree: of each paragraph (line) its digest, and the 64-bit hashes of its pieces in order; marks between pieces belong to no piece."""
    return F.transform(F.split(text, "\n", -1), lambda p: F.struct(_digest(p).alias("digest"), F.transform(pieces(p), lambda x: F.xxhash64(x)).alias("leaves")))


def leaves(tree: Column) -> Column:
    """The distinct leaves of hashed()."""
    return F.array_distinct(F.flatten(tree["leaves"]))


def fingerprint(text: Column, section: int = SECTION) -> Column:
    """The tree as a string: `root:section=paragraph.leaf.leaf,paragraph.leaf;section=...`, digests in hexadecimal.

    A paragraph's digest covers its text with all marks, a section's its paragraphs, the root its sections:
    equal roots mean equal texts, and where roots differ, `differing` walks down to the edits. Empty text has
    one section with one empty paragraph; null gives null.
    """
    return printed(hashed(text), section)


def printed(tree: Column, section: int = SECTION) -> Column:
    """fingerprint() where hashed() is at hand."""
    nodes = F.transform(tree, lambda p: F.concat_ws(".", p["digest"], F.transform(p["leaves"], lambda x: F.hex(x))))
    starts = F.sequence(F.lit(0), F.floor((F.size(tree) - 1) / F.lit(section)).cast("int"))

    def sections(nodes: Column) -> Column:
        parts = F.transform(starts, lambda i: F.slice(nodes, i * F.lit(section) + 1, F.lit(section)))
        return F.transform(parts, lambda ps: F.concat(_digest(F.array_join(F.transform(ps, lambda p: F.substring(p, 1, DIGITS)), ",")), F.lit("="), F.array_join(ps, ",")))

    # Arrays of one element hold what is used more than once, so that it is built once.
    whole = lambda ss: F.concat(F.sha2(F.array_join(F.transform(ss, lambda s: F.substring(s, 1, DIGITS)), ","), 256), F.lit(":"), F.array_join(ss, ";"))
    return F.when(tree.isNotNull(), F.element_at(F.transform(F.transform(F.array(nodes), sections), whole), 1))


def leaves_of(print_: Column) -> Column:
    """The distinct leaves that a fingerprint prints."""
    paragraphs = F.split(F.substring_index(print_, ":", -1), "[,;]", -1)
    return F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: F.slice(F.split(F.substring_index(p, "=", -1), "[.]", -1), 2, 1 << 30))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the distinct leaves that two fingerprints share, over the sum of both; 1 for equal roots."""
    return likeness_of(a, b, leaves_of(a), leaves_of(b))


def likeness_of(a: Column, b: Column, x: Column, y: Column) -> Column:
    """likeness() where the distinct leaves x of a and y of b are at hand."""
    shared = F.size(F.array_intersect(x, y))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(2.0 * shared / (F.size(x) + F.size(y)))


def differing(a: Column, b: Column) -> Column:
    """Numbers, from 0, of a's paragraphs under the sections whose digests b lacks and whose own digests b lacks too: where the edits are."""
    def sections(p: Column) -> Column:
        return F.split(F.substring_index(p, ":", -1), ";", -1)

    others = F.transform(sections(b), lambda s: F.substring_index(s, "=", 1))
    theirs = F.flatten(F.transform(sections(b), lambda s: F.split(F.substring_index(s, "=", -1), ",", -1)))
    found = F.transform(sections(a), lambda s, i: F.when(F.array_contains(others, F.substring_index(s, "=", 1)), F.array().cast("array<int>")).otherwise(
        F.filter(F.transform(F.split(F.substring_index(s, "=", -1), ",", -1), lambda p, j: F.when(~F.array_contains(theirs, p), i * F.lit(SECTION) + j)), lambda n: n.isNotNull())))
    return F.flatten(found)


def with_next(docs: DataFrame, doc_id: str, text: str, buckets: int, more: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, text, next_text): the text of the next row in descending doc_id; after the last comes the first.

    `more`: columns made of `text` behind the shuffle, a later one may use those before it; each comes with its
    next_ twin, made once a row.

    One shuffle of the texts: rows go to ranges of doc_id (approximate quantiles, `buckets` of them, each cut
    evenly into parts of about ROWS rows), and the first row of each is sent once more, to the end of the range
    above. What is broadcast is a few numbers a range, of buckets * PARTS ranges at most. Rows of equal doc_id are
    ordered by text; rows without doc_id come last.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    more = more or {}
    got = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 10_000).alias("cuts"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
    cuts = sorted(set(got["cuts"] or [])) if buckets > 1 else []
    # Ranges between quantiles are cut evenly into as many parts as keep a part near ROWS rows, at any size of the table.
    parts = min(PARTS, max(1, -(-got["n"] // (buckets * ROWS))))
    low, high = (F.array(*[F.lit(int(x)).cast("long") for x in xs]) for xs in ([got["low"] or 0, *cuts], [*cuts, (got["high"] or 0) + 1]))
    at = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("range", F.coalesce(F.when(F.col("doc_id").isNotNull(), at), F.lit(-1)))
    start, stop = F.get(low, F.col("range")), F.get(high, F.col("range"))
    part = F.least(F.lit(parts - 1), F.floor((F.col("doc_id") - start) / F.greatest(stop - start, F.lit(1)) * F.lit(parts))).cast("int")
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("range") * parts + F.greatest(F.lit(0), part))).drop("range")
    # One row a bucket: its first document, and the bucket above (above the highest comes the lowest, as after the last document comes the first).
    heads = rows.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    every = Window.orderBy("bucket")
    around = F.first("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("bucket", "head", F.coalesce(F.lead("bucket").over(every), around).alias("above"))
    first = rows.alias("r").join(F.broadcast(heads).alias("h"), (F.col("r.bucket") == F.col("h.bucket")) & F.col("r.doc_id").eqNullSafe(F.col("h.head")))
    # A tie on the head's doc_id: the greatest text is its first row.
    first = first.groupBy(F.col("h.above").alias("bucket"), F.col("r.doc_id").alias("doc_id")).agg(F.max("r.text").alias("text"))
    first = first.select("doc_id", "text", "bucket", F.lit(True).alias("sent"))
    order = Window.partitionBy("bucket").orderBy(F.col("sent").asc(), F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    both = rows.withColumn("sent", F.lit(False)).unionByName(first).repartition("bucket")
    for name, column in more.items():
        both = both.withColumn(name, column)
    both = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *more)})
    return both.where(~F.col("sent")).drop("sent", "bucket")


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = 64) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is replaced from the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Defined cases: null text is empty; empty texts are equal to each other (likeness 1) and unlike any other;
    one row alone is its own next; ties of doc_id are ordered by text, descending; repeated rows are each
    fingerprinted; an empty table gives no rows; other columns are ignored.
    """
    trees = {"tree": hashed(F.col("text")), "fingerprint": printed(F.col("tree")), "leaves": leaves(F.col("tree"))}
    d = with_next(docs, doc_id, text, buckets, trees).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    edited = F.col("edited")
    d = d.withColumns({"edited_sha256": F.sha2(edited, 256), "edited_tree": hashed(edited)})
    d = d.withColumns({"edited_fingerprint": printed(F.col("edited_tree")), "edited_leaves": leaves(F.col("edited_tree"))})
    near = lambda other: likeness_of(F.col("fingerprint"), F.col(f"{other}_fingerprint"), F.col("leaves"), F.col(f"{other}_leaves"))
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited").alias("near_edited"), near("next").alias("near_next"))
