"""Property graph of failures, elements, modes, effects and causes as two DataFrames: nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import node_id

# Labels with their key property.
KEYS = {"Failure": "failure_id", "FailureElement": "name", "FailureMode": "text", "FailureEffect": "text", "FailureCause": "cause_id"}
# Properties that name a node, the first that is there wins.
NAMES = ("text", "name", "failure_id", "cause_id", "system")


def _props(**columns: Column) -> Column:
    return F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))])


def compact_props(props: Column) -> Column:
    return F.map_filter(props, lambda k, v: v.isNotNull() & (F.trim(v) != ""))


def build(causes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of causes: five nodes and six edges a cause, each kept once; the pass is one scan and one aggregation each."""
    f, e, m, x, c = (node_id(label, key, F.col(col)) for (label, key), col in zip(KEYS.items(), ("failure_id", "failure_element", "failure_mode", "failure_effect", "cause_id")))
    nodes = F.array(
        F.struct(f.alias("id"), F.lit("Failure").alias("label"), _props(failure_id=F.col("failure_id")).alias("props")),
        F.struct(e.alias("id"), F.lit("FailureElement").alias("label"), _props(name=F.col("failure_element")).alias("props")),
        F.struct(m.alias("id"), F.lit("FailureMode").alias("label"), _props(text=F.col("failure_mode")).alias("props")),
        F.struct(x.alias("id"), F.lit("FailureEffect").alias("label"), _props(text=F.col("failure_effect")).alias("props")),
        F.struct(c.alias("id"), F.lit("FailureCause").alias("label"), _props(cause_id=F.col("cause_id"), text=F.col("failure_cause"), discipline=F.col("discipline"), occurrence=F.col("occurrence"), detection=F.col("detection"), recommended_action=F.col("recommended_action")).alias("props")),
    )
    ends = ((f, "HAS_ELEMENT", e), (f, "HAS_MODE", m), (e, "HAS_MODE", m), (f, "HAS_EFFECT", x), (m, "LEADS_TO", x), (c, "CAUSES", m))
    edges = F.array(*[F.struct(s.alias("src"), F.lit(rel).alias("rel"), d.alias("dst")) for s, rel, d in ends])
    # A node's id holds its key, so equal ids of all but causes have equal properties; cause ids are unique.
    return causes.select(F.inline(nodes)).dropDuplicates(["id"]), causes.select(F.inline(edges)).distinct()


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of both: new properties go over old ones, a new label over the old unless it is empty."""
    rows = old.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1))).select("id", "turn", "label", F.explode_outer(F.map_entries("props")).alias("e"))
    last = rows.groupBy("id", F.col("e.key").alias("k")).agg(F.max_by("e.value", "turn").alias("v"), F.max_by("label", F.when(F.col("label") != "", F.col("turn"))).alias("label"), F.max(F.when(F.col("label") != "", F.col("turn"))).alias("turn"))
    return last.groupBy("id").agg(F.max_by("label", "turn").alias("label"), F.map_from_entries(F.filter(F.collect_list(F.struct("k", "v")), lambda s: s["k"].isNotNull())).alias("props"))


def find(nodes: DataFrame, label: str, key: str, value: str) -> DataFrame:
    return nodes.where((F.col("label") == label) & (F.col("props")[key] == str(value)))


def edges_of(edges: DataFrame, ids: DataFrame, rel: str | None = None, direction: str = "out") -> DataFrame:
    """Edges that leave (or enter) the nodes of `ids` (column id)."""
    if direction not in ("out", "in"):
        raise ValueError(f"direction must be 'out' or 'in', not {direction!r}")
    if rel is not None:
        edges = edges.where(F.col("rel") == rel)
    end = "src" if direction == "out" else "dst"
    return edges.join(ids.select(F.col("id").alias(end)).distinct(), end, "left_semi")


def neighbours(edges: DataFrame, ids: DataFrame, rel: str | None = None, direction: str = "out") -> DataFrame:
    """(id) of the nodes at the other ends, each once."""
    return edges_of(edges, ids, rel, direction).select(F.col("dst" if direction == "out" else "src").alias("id")).distinct()


def node_text(props: Column, id_: Column) -> Column:
    return F.coalesce(*[F.nullif(props[k], F.lit("")) for k in NAMES], id_)


#: The label of what a traversal returns, by kind: other labels are not read.
LABELS = {"failure_element": "FailureElement", "failure_mode": "FailureMode", "failure_effect": "FailureEffect", "failure_cause": "FailureCause"}


def _named(nodes: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("label") == LABELS[kind]).join(ids, "id", "left_semi").select(F.lit(kind).alias("kind"), node_text(F.col("props"), F.col("id")).alias("value"))


def chain(nodes: DataFrame, edges: DataFrame, failure_id: str) -> DataFrame:
    """(kind, value) around a failure: its elements, modes and effects, and the causes of its modes, whoever shares them."""
    # A node's id holds its key, so the first hops are filters that reach the scan.
    start = F.col("src") == f"Failure::failure_id::{failure_id}"
    hop = lambda rel: edges.where((F.col("rel") == rel) & start).select(F.col("dst").alias("id")).distinct()
    hops = {"failure_element": hop("HAS_ELEMENT"), "failure_mode": hop("HAS_MODE"), "failure_effect": hop("HAS_EFFECT"), "failure_cause": neighbours(edges, hop("HAS_MODE"), "CAUSES", "in")}
    return reduce(DataFrame.unionByName, [_named(nodes, ids, kind) for kind, ids in hops.items()])


def modes_under_element(nodes: DataFrame, edges: DataFrame, element: str) -> DataFrame:
    return _named(nodes, neighbours(edges, find(nodes, "FailureElement", "name", element), "HAS_MODE"), "failure_mode")


def causes_for_mode(nodes: DataFrame, edges: DataFrame, mode: str) -> DataFrame:
    return _named(nodes, neighbours(edges, find(nodes, "FailureMode", "text", mode), "CAUSES", "in"), "failure_cause")


def valid_links(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """links (cause_id, mode) with `valid`: both nodes are there and the cause's edge leads to the mode."""
    ends = links.withColumns({"src": node_id("FailureCause", "cause_id", F.col("cause_id")), "dst": node_id("FailureMode", "text", F.col("mode"))})
    known = edges.where("rel = 'CAUSES'").select("src", "dst", F.lit(True).alias("found"))
    return ends.join(known, ["src", "dst"], "left").select("cause_id", "mode", F.coalesce("found", F.lit(False)).alias("valid"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    by = lambda d, c, kind: d.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return by(nodes, "label", "node").unionByName(by(edges, "rel", "edge"))


class Graph:
    """nodes and edges with the traversals as methods."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    @classmethod
    def from_causes(cls, causes: DataFrame) -> "Graph":
        return cls(*build(causes))

    def node(self, id_: str) -> DataFrame:
        return self.nodes.where(F.col("id") == id_)

    def find(self, label: str, key: str, value: str) -> DataFrame:
        return find(self.nodes, label, key, value)

    def neighbours(self, id_: str, rel: str | None = None, direction: str = "out") -> DataFrame:
        return neighbours(self.edges, self.node(id_), rel, direction)

    def edges_of(self, id_: str, rel: str | None = None, direction: str = "out") -> DataFrame:
        return edges_of(self.edges, self.node(id_), rel, direction)

    def chain(self, failure_id: str) -> DataFrame:
        return chain(self.nodes, self.edges, failure_id)

    def save(self, path: str) -> None:
        """A folder a label and a relation, so that traversals read those they ask for."""
        self.nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark, path: str) -> "Graph":
        return cls(spark.read.parquet(f"{path}/nodes").select("id", "label", "props"), spark.read.parquet(f"{path}/edges").select("src", "rel", "dst"))
