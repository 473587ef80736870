"""N-gram Jaccard join: prefix-tree join over globally ordered shingle sets, and the groups it links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, drop_written, mix64, split_join, tune, written
from .prefix_tree import walk
from .substring import Words
from .windows import keyed

#: Words of a shingle; similarity in hundredths.
SHINGLE, SIMILARITY = 5, 80
#: Frequent shingles that the global order puts last (8 bytes each are broadcast), and from which count on.
FREQUENT, FREQUENT_FROM = 100_000, 16
#: Shingles a task gathers before it reports the repeated ones among them.
GATHER = 2_000_000
#: Rounds of links to one partner a set before the rest is enumerated, at most; earlier if there are few pairs a set and token,
#: or if fewer than one in so many tests found a link.
STAR_ROUNDS, PAIRS, YIELD = 4, 16, 50

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = Words()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words, A-Z in lower case; fewer words make one run."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(_WORDS.grams(_WORDS.hashes(words), min(size, len(words))))


def in_order(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Tokens in the global order: by hash, the frequent ones behind all others, the most frequent last.

    `frequent` is sorted; rank holds the place of each of them, from 1. Any order that is the same for all sets
    is right; this one keeps common passages out of the prefixes.
    """
    if not len(frequent):
        return tokens
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    return tokens[np.lexsort((tokens, np.where(frequent[at] == tokens, rank[at], 0)))]


#: A set's prefix is longer by one in so many of its tokens, and as many more shared ones are asked for.
PER_VOTE = 20


def prefix_length(n: int, similarity: int) -> int:
    """Of n tokens in global order, the first ones of which any set this similar shares 1 + n // PER_VOTE at least.

    Similar sets share similarity * n / 100 tokens at least; the v-th of these, in order, has all others behind it.
    """
    return min(n, n - -(-similarity * n // 100) + 1 + n // PER_VOTE)


def _scan(d: DataFrame, size: int) -> DataFrame:
    """Rows (kind, a, b, c, e): kind 0 a document (doc, n, two sums that name its set); kind 1 a token repeated in a task (token, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0

        def repeated() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(gathered), return_counts=True)
            token, times = token[times > 1], times[times > 1]
            return out(np.full(len(token), 1), token.view(np.int64), times, np.zeros(len(token)), np.zeros(len(token)))

        def out(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int64)) for c in columns], names=list("kabce"))

        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                s = shingles(text, size)
                first, second = (int(mix64(s ^ np.uint64(c)).sum(dtype=np.uint64)) for c in (0, 0x5851F42D4C957F2D))
                rows.append((0, doc, len(s), first, second))
                gathered.append(s)
                held += len(s)
            if rows:
                table = np.array(rows, dtype=object)
                yield out(table[:, 0], table[:, 1], table[:, 2], *(table[:, i].astype(np.uint64).view(np.int64) for i in (3, 4)))
            if held > GATHER:
                yield repeated()
                gathered, held = [], 0
        if gathered:
            yield repeated()

    return d.select("doc", "text").mapInArrow(run, "k long, a long, b long, c long, e long")


def _prefixes(d: DataFrame, size: int, similarity: int, order) -> DataFrame:
    """(t, s, n, pos): the prefix tokens of each set, s the first of its two sums, pos the token's place in the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                s = shingles(text, size)
                if len(s):
                    t = in_order(s, *order.value)[: prefix_length(len(s), similarity)]
                    out.append((t.view(np.int64), np.full(len(t), int(mix64(s).sum(dtype=np.uint64)), np.uint64).view(np.int64), np.full(len(t), len(s), np.int32), np.arange(len(t), dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["t", "s", "n", "pos"])

    return d.select("text").mapInArrow(run, "t long, s long, n int, pos int")


def _sets(d: DataFrame, reps: DataFrame, size: int, order) -> DataFrame:
    """(rep, n, set): the whole set, in global order, of each document in reps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [in_order(shingles(t, size), *order.value) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "n", "set"])

    return d.join(reps.select(F.col("rep").alias("doc")), "doc").select("doc", "text").mapInArrow(run, "rep long, n int, set binary")


def _sizes_allow(m: str, n: str, similarity: int) -> Column:
    return 100 * F.least(m, n) >= similarity * F.greatest(m, n)


def _places_allow(a: dict[str, str], b: dict[str, str], similarity: int) -> Column:
    """Can a token shared by two sets be among the first ones that are asked for: either has the overlap that is open behind it.

    a and b name the columns n and pos of the sets: size, and the token's place. Tokens that no other prefix holds
    say nothing here: they may lie behind the prefix of the other set and still be in the overlap.
    """
    need = F.ceil(F.lit(similarity) * (F.col(a["n"]) + F.col(b["n"])) / F.lit(100 + similarity))
    behind = need - F.floor(F.least(a["n"], b["n"]) / PER_VOTE)
    return reduce(and_, (F.col(x["n"]) - F.col(x["pos"]) >= behind for x in (a, b)))


def _votes_allow(m: str, n: str, votes: str) -> Column:
    """As many shared prefix tokens as the smaller demand of two similar sets."""
    return F.col(votes) >= F.floor(F.least(m, n) / PER_VOTE) + 1


def _found(d: DataFrame, rows: DataFrame, size: int, similarity: int, order) -> DataFrame:
    """Links (a, b) found by walking the trees of rows (host, probe, rep, n, comp), written; texts of their sets are read again."""
    sets = written(_sets(d, rows.select("rep").distinct(), size, order), "sets")
    out = written(walk(rows, sets, similarity), "links")
    drop_written(sets)
    return out


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) after more links: components of components, so that old links are not walked again."""
    if comps is None:
        return components(links)
    of = lambda end: comps.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(between)
    new = merged.select(F.col("id").alias("component"), F.col("component").alias("root"))
    sizes = comps.groupBy("component").agg(F.count("*").alias("rows"))
    new = written(new.join(sizes, "component", "left").select("component", "root", F.coalesce("rows", F.lit(0)).alias("rows")), "roots")
    old = split_join(comps, new, ["component"], "rows", "left").select("id", F.coalesce("root", "component").alias("component"))
    drop_written(merged)
    added = new.select(F.col("component").alias("id"), F.col("root").alias("component")).join(comps.select("id"), "id", "left_anti")
    return written(old.unionByName(added), "groups")


def _star_rows(live: DataFrame, similarity: int) -> DataFrame:
    """Walks of one round: each set is in the tree of the center that most of its tokens name, and the center walks it."""
    sides = {c: c for c in ("n", "pos")}, {c: f"c.{c}" for c in ("n", "pos")}
    asked = live.where("comp <> c.comp").where(_sizes_allow("n", "c.n", similarity) & _places_allow(*sides, similarity))
    votes = asked.groupBy("rep", "n", "comp", F.col("c.rep").alias("host"), F.col("c.n").alias("cn"), F.col("c.comp").alias("cc")).count().where(_votes_allow("n", "cn", "count"))
    best = votes.groupBy("rep", "n", "comp").agg(F.max_by(F.struct("host", "cn", "cc"), F.struct("count", F.xxhash64("host"))).alias("b"))
    tree = best.select(F.col("b.host").alias("host"), F.lit(False).alias("probe"), "rep", "n", "comp")
    walker = best.select(F.col("b.host").alias("host"), F.lit(True).alias("probe"), F.col("b.host").alias("rep"), F.col("b.cn").alias("n"), F.col("b.cc").alias("comp")).distinct()
    return tree.unionByName(walker)


def _rest_rows(live: DataFrame, similarity: int) -> tuple[DataFrame, list[DataFrame]]:
    """Walks that test all pairs across groups that can still link, and the written tables they come from.

    Groups around one hub (the group of the center that most of a group's tokens name, if they are as many as similar sets share) are a
    system. In a system the trees hold all sets, and the sets of all groups but its largest walk them; so
    groups that are alike, but not similar, make no rows for their pairs. Pairs of groups of different systems
    are found by the tokens they share, each group with one row a token, and bounds that no pair of their sets
    can miss; the smaller group of a pair then walks the trees of the larger one.
    """
    members = written(live.groupBy("rep", "n", "comp").agg(F.lit(1).alias("one")).drop("one"), "members")
    by_group = live.groupBy("t", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("pos")).alias("behind"), F.first("c.comp").alias("hub"))
    by_group = written(by_group, "tokens")
    size = members.groupBy("comp").agg(F.count("*").alias("rows"))
    named = by_group.where("hub <> comp").groupBy("comp", "hub").agg(F.count("*").alias("votes"), F.min("lo").alias("lo")).where(_votes_allow("lo", "lo", "votes"))
    named = written(named.groupBy("comp").agg(F.max_by("hub", F.struct("votes", F.xxhash64("hub"))).alias("hub")), "named")
    hubs = named.select(F.col("hub").alias("comp")).distinct()
    # A group that others name is the hub of its own system.
    system = size.join(named.join(hubs, "comp", "left_anti"), "comp", "left").select("comp", "rows", F.coalesce("hub", "comp").alias("system"))
    system = written(system, "systems")
    core = system.groupBy("system").agg(F.count("*").alias("groups"), F.sum("rows").alias("rows"), F.max_by("comp", F.struct("rows", "comp")).alias("core")).where("groups > 1").drop("groups")
    core = written(core, "cores")

    placed = split_join(members, system.select("comp", "system", "rows"), ["comp"], "rows")
    inside = split_join(placed, core, ["system"], "rows").withColumn("host", F.struct(F.lit("system").alias("kind"), F.col("system").alias("id")))
    inside = inside.withColumn("probe", F.explode(F.when(F.col("comp") == F.col("core"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))

    tokens = by_group.join(system.select("comp", "system"), "comp").select("t", "comp", "system", "lo", "hi", "behind")
    x, y = (tokens.select("t", *[F.col(c).alias(f"{c}_{k}") for c in ("comp", "system", "lo", "hi", "behind")]) for k in "ab")
    able = (F.col("comp_a") < F.col("comp_b")) & (F.col("system_a") != F.col("system_b")) & (100 * F.col("hi_a") >= similarity * F.col("lo_b")) & (100 * F.col("hi_b") >= similarity * F.col("lo_a"))
    open_ = F.ceil(F.lit(similarity) * (F.col("lo_a") + F.col("lo_b")) / F.lit(100 + similarity)) - F.floor(F.least("hi_a", "hi_b") / PER_VOTE)
    able = able & (F.col("behind_a") >= open_) & (F.col("behind_b") >= open_)
    pairs = x.join(y, "t").where(able).groupBy("comp_a", "comp_b").agg(F.count("*").alias("votes"), F.min("lo_a").alias("lo_a"), F.min("lo_b").alias("lo_b")).where(_votes_allow("lo_a", "lo_b", "votes"))
    sized = lambda k: system.select(F.col("comp").alias(f"comp_{k}"), F.col("rows").alias(f"rows_{k}"))
    pairs = pairs.select("comp_a", "comp_b").join(sized("a"), "comp_a").join(sized("b"), "comp_b")
    first = F.col("rows_a") >= F.col("rows_b")
    pairs = written(pairs.select(F.when(first, F.col("comp_a")).otherwise(F.col("comp_b")).alias("larger"), F.when(first, F.col("comp_b")).otherwise(F.col("comp_a")).alias("comp")), "pairs")
    host = F.struct(F.lit("group").alias("kind"), F.col("larger").alias("id"))
    hosts = written(pairs.select(F.col("larger").alias("comp")).distinct().join(size, "comp"), "hosts")
    trees = split_join(members, hosts, ["comp"], "rows").select(F.struct(F.lit("group").alias("kind"), F.col("comp").alias("id")).alias("host"), F.lit(False).alias("probe"), "rep", "n", "comp")
    probes = pairs.join(members, "comp").select(host.alias("host"), F.lit(True).alias("probe"), "rep", "n", "comp")
    rows = inside.select("host", "probe", "rep", "n", "comp").unionByName(trees).unionByName(probes)
    return rows, [members, by_group, named, system, core, pairs, hosts]


def labelled(docs: DataFrame, similarity: int = SIMILARITY, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The numbered documents (see keyed), and (doc, n, component) of each: documents link when 100 |A and B| >= similarity |A or B|.

    1. Equal sets are taken together. Tokens that tasks meet again and again get a place at the end of the
       global order (a bounded, broadcast list); all others are ordered by hash.
    2. Sets send their prefix tokens; tokens of one set only end there. Similar sets share a prefix token.
    3. Each token names as its center the set whose tokens are shared the most; each set joins the tree of the
       center that most of its tokens name, and the center walks that tree; what links joins a group. A token
       whose sets are all in one group has nothing more to tell. This repeats, with other centers, while pairs
       are many and rounds find links.
    4. All pairs across groups that can still link are tested on trees, too (`_rest_rows`).
    Trees are prefix trees of whole sets in blocks of bounded size (`prefix_tree.walk`). Groups are the connected
    components of the links. So every link between different groups is found; pairs are never rows, but for
    groups of different systems that share as many prefix tokens as similar sets must.
    """
    spark: SparkSession = docs.sparkSession
    tune(spark)
    d = keyed(docs, doc_id, text)
    scanned = written(_scan(d, size), "scan")
    known = scanned.where("k = 0").select(F.col("a").alias("doc"), F.col("b").cast("int").alias("n"), F.col("c").alias("s"), F.col("e").alias("s2"))
    reps = written(known.where("n > 0").groupBy("n", "s", "s2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "reps")
    often = scanned.where("k = 1").groupBy("a").agg(F.sum("b").alias("times")).where(F.col("times") >= FREQUENT_FROM).orderBy(F.desc("times"), "a").limit(FREQUENT).toPandas()
    token = often["a"].to_numpy(np.int64).view(np.uint64)
    by_token = np.argsort(token)
    order = spark.sparkContext.broadcast((token[by_token], (len(token) - np.arange(len(token)))[by_token]))

    prefixes = written(_prefixes(d, size, similarity, order), "prefixes")
    shared = written(prefixes.groupBy("t").agg(F.min("s").alias("least"), F.max("s").alias("most"), F.count("*").alias("among")).where("least <> most").select("t", "among", F.col("among").alias("rows")), "shared")
    posts = split_join(prefixes, shared, ["t"], "rows").distinct().join(reps.select("n", "s", "rep"), ["n", "s"]).select("t", "rep", "n", "pos", "among")
    posts = written(posts, "posts")
    drop_written(prefixes, shared)
    # A set whose tokens many sets share is in the middle of its group; unlike ones lie around it.
    middle = posts.groupBy("rep", "n").agg(F.sum("among").alias("sum")).select("rep", (F.col("sum") / F.col("n")).alias("middle"))
    bare, posts = posts, written(posts.drop("among").join(middle, "rep"), "posts")
    drop_written(bare)

    comps: DataFrame | None = None
    few = False
    for turn in range(STAR_ROUNDS + 1):
        state = posts.withColumn("comp", F.col("rep")) if comps is None else posts.join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").select(*posts.columns, F.coalesce("component", "rep").alias("comp"))
        # The first round asks the sets in the middle, later ones others in turn, those near it more often.
        place = F.col("middle") if turn == 0 else F.col("middle") * F.pmod(F.xxhash64(F.lit(turn), "rep"), F.lit(1000))
        center = F.max(F.struct(place.alias("p"), "rep", "n", "pos", "comp")).alias("c")
        # Tokens of one group have nothing more to tell; for the others, how many pairs there are at most.
        mixed = written(state.groupBy("t").agg(F.count("*").alias("rows"), F.min("comp").alias("least"), F.max("comp").alias("most"), center).where("least <> most").select("t", "c", "rows"), "mixed")
        pairs, left = mixed.agg(F.sum(F.col("rows") * (F.col("rows") - 1) / 2), F.sum("rows")).first()
        if not left:
            drop_written(mixed)
            break
        last = turn == STAR_ROUNDS or few or (turn > 0 and pairs <= PAIRS * left)
        live = split_join(state, mixed, ["t"], "rows")
        rows, tables = _rest_rows(live, similarity) if last else (_star_rows(live, similarity), [])
        rows = written(rows, "walks")
        links = _found(d, rows, size, similarity, order)
        few = YIELD * links.count() < rows.count()
        before, comps = comps, _joined(comps, links)
        drop_written(links, rows, mixed, *tables, *[c for c in [before] if c is not None])
        if last:
            break
    drop_written(posts)
    label = reps
    if comps is not None:
        label = label.join(comps, F.col("rep") == F.col("id"), "left").withColumn("component", F.coalesce("component", "rep"))
    else:
        label = label.withColumn("component", F.col("rep"))
    label = written(label.select("n", "s", "s2", "component", "copies"), "labels")
    named = split_join(known, label, ["n", "s", "s2"], "copies", "left")
    return d, named.select("doc", "n", F.coalesce("component", "doc").alias("component"))


def groups(docs: DataFrame, similarity: int = SIMILARITY, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row, by `labelled`; one row of each group is kept.

    Defined cases: null texts and texts without words have no shingles and link with nothing; rows of equal id
    are documents of their own (component_id is then the smallest id); null ids come before all others and
    name components as null; an empty table gives no rows; other columns are ignored.
    """
    d, named = labelled(docs, similarity, size, doc_id, text)
    rows = d.select("doc", "doc_id", "times").join(named, "doc")
    # Where documents were numbered, the component's number goes back to its document's id.
    if _numbered(d):
        ids = named.groupBy("component").agg(F.count("*").alias("rows")).join(d.select(F.col("doc").alias("component"), F.col("doc_id").alias("component_id")), "component")
        rows = split_join(rows, written(ids, "ids"), ["component"], "rows")
    else:
        rows = rows.withColumn("component_id", F.col("component"))
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", (F.col("doc") == F.col("component")).alias("kept"), F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    return out.withColumn("kept", F.col("kept") & (F.col("copy") == 1)).drop("copy")


def keep_one(docs: DataFrame, similarity: int = SIMILARITY, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, of one document of each group: the first by id (and text)."""
    d, named = labelled(docs, similarity, size, doc_id, text)
    kept = named.where(F.col("doc") == F.col("component")).select("doc")
    rows = docs.alias("row")
    if not _numbered(d):
        return rows.join(kept.alias("kept"), F.col(f"row.{doc_id}") == F.col("kept.doc"), "left_semi")
    kept = d.join(kept, "doc", "left_semi").select("doc_id", "text").alias("kept")
    rows = docs.dropDuplicates([doc_id, text]).alias("row")
    same = F.col(f"row.{doc_id}").eqNullSafe(F.col("kept.doc_id")) & (F.coalesce(F.col(f"row.{text}"), F.lit("")) == F.col("kept.text"))
    return rows.join(kept, same, "left_semi")


def _numbered(d: DataFrame) -> bool:
    return d.where("doc_id IS NULL OR doc <> doc_id").limit(1).count() > 0
