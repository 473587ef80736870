"""A knowledge base kept in a store: batches of files are merged by their own keys, ids stay those of one ingest of all files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store
from . import graph, ingest

#: The keys that tables are dealt by: a batch looks up its own keys in their parts only.
TABLES = {"records": ["file_name"], "files": ["file_name"], "failures": ["key"], "causes": ["failure_id"], "sentences": ["sentence_id"], "nodes": ["id"], "edges": ["src"]}
#: Columns that tables have a folder a value for.
BY = {"nodes": ["label"], "edges": ["rel"]}


def failure_key() -> Column:
    """A digest of what makes two groups one failure."""
    return F.md5(F.concat_ws("|", "k_failure_mode", "k_failure_effect", "k_element", "k_system"))


class KnowledgeBase:
    """Records, failures, causes, sentences and the graph of FMEA files, under one version.

    `add` merges files that are new: it reads the parts of the store that hold the batch's own keys, the failures that are known and their causes, and adds rows;
    no row that is there is written again. Files keep the number of their arrival, so ids equal those of one
    ingest of all files in that order. `rebuild` makes all tables anew from the kept records, for files that have changed or gone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    # --- Reading ------------------------------------------------------------------------------------------------

    def failures(self, version: int | None = None) -> DataFrame:
        version = self.store.version() if version is None else version
        return ingest.with_cause_ids(self.store.read("failures", version).drop("key"), self.store.read("causes", version))

    def causes(self, version: int | None = None) -> DataFrame:
        return self.store.read("causes", version).drop("n", "cause_key")

    def sentences(self, version: int | None = None) -> DataFrame:
        return self.store.read("sentences", version)

    def files(self, version: int | None = None) -> DataFrame:
        """(file_name, file_ord, digest) of the files in it; digests are null where files were added without."""
        return self.store.read("files", version)

    def graph(self, version: int | None = None) -> graph.Graph:
        version = self.store.version() if version is None else version
        return graph.Graph(self.store.read("nodes", version), self.store.read("edges", version))

    # --- Writing ------------------------------------------------------------------------------------------------

    def _kept(self, table: str, keys: DataFrame) -> DataFrame | None:
        """The parts of a table that hold these keys."""
        return self.store.read(table, only=self.store.touched(table, keys)) if self.store.table(table) is not None else None

    def _file_rows(self, rows: DataFrame, digests: DataFrame | None) -> DataFrame:
        files = rows.groupBy("file_name").agg(F.min("file_ord").cast("int").alias("file_ord"))
        return files.withColumn("digest", F.lit(None).cast("string")) if digests is None else files.join(digests, "file_name", "outer").select("file_name", "file_ord", "digest")

    def add(self, rows: DataFrame, digests: DataFrame | None = None, notes: Mapping[str, object] | None = None) -> int:
        """Merge the records of new files; the new version. A file that the base has, or two of one name, are an error.

        `rows` has file_ord, file_name and row_ord as for `ingest`; files of later batches count as later ones. `digests`
        (file_name, digest) are kept with the files.
        """
        start = int(self.store.state()["notes"].get("next_file", 0))
        with self.store.staged(ingest.complete(rows)) as batch:
            if (clash := ingest.clashing_files(batch).first()) is not None:
                raise ValueError(f"{clash['files']} files are named {clash['file_name']}: their failures would share ids")
            known_files = self._kept("files", batch.select("file_name").distinct())
            if known_files is not None and (again := known_files.join(batch.select("file_name").distinct(), "file_name").first()) is not None:
                raise ValueError(f"the base has a file {again['file_name']}")
            low, high = batch.agg(F.min("file_ord"), F.max("file_ord")).first()
            shift = start - (low or 0)
            batch = batch.withColumn("file_ord", (F.col("file_ord") + shift).cast("int"))
            with self.store.staged(ingest.keyed(ingest.distinct_records(batch))) as keyed, self.store.staged(ingest.groups_of(keyed).withColumn("key", failure_key())) as groups:
                known = self._kept("failures", groups)
                if known is not None:
                    groups = groups.join(known.select("key", F.col("failure_id").alias("known_id")), "key", "left")
                with self.store.staged(ingest.identified(groups)) as named:
                    taken = self._kept("causes", named.where("known_id IS NOT NULL").select("failure_id")) if known is not None else None
                    causes = ingest.causes(keyed, named, None if taken is None else taken.select("failure_id", "cause_key", "n"))
                    with self.store.staged(causes) as new_causes:
                        added, replaced = self._graph_changes(*graph.build(new_causes))
                        after = start if high is None else high + shift + 1
                        tables = self._tables(batch, named, new_causes, digests)
                        return self.store.commit(tables | added, replaced, TABLES, BY, {**(notes or {}), "next_file": after})

    def merge(self, rows: DataFrame, notes: Mapping[str, object] | None = None) -> int:
        """`add`; but where files go on that the base has begun, `rebuild` from the kept records and these, as their numbers may all change."""
        with self.store.staged(ingest.complete(rows)) as batch:
            known = self._kept("files", batch.select("file_name").distinct())
            begun = None if known is None else known.join(batch.select("file_name").distinct(), "file_name", "left_semi").select("file_name", F.col("file_ord").alias("old_ord"))
            if begun is None or begun.isEmpty():
                return self.add(batch, notes=notes)
            low = batch.agg(F.min("file_ord")).first()[0]
            shift = int(self.store.state()["notes"].get("next_file", 0)) - low
            numbered = batch.join(begun, "file_name", "left").withColumn("file_ord", F.coalesce("old_ord", F.col("file_ord") + shift).cast("int")).drop("old_ord")
            return self.rebuild(self.store.read("records").unionByName(numbered), self.files().select("file_name", "digest"), notes)

    def _tables(self, batch: DataFrame, named: DataFrame, causes: DataFrame, digests: DataFrame | None) -> dict[str, DataFrame]:
        fresh = ingest.failures(named).join(named.where("wins").select("failure_id", "key"), "failure_id")
        return {"records": batch, "files": self._file_rows(batch, digests), "failures": fresh, "causes": causes, "sentences": ingest.sentences_of(batch)}

    def _graph_changes(self, nodes: DataFrame, edges: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """What to add to the graph's tables, and what to put in the place of the partitions that hold nodes with other properties now."""
        kept_edges = self._kept("edges", edges)
        added = {"edges": edges if kept_edges is None else edges.join(kept_edges, ["src", "rel", "dst"], "left_anti")}
        kept = self._kept("nodes", nodes)
        if kept is None:
            return added | {"nodes": nodes}, {}
        merged = graph.upsert_nodes(kept.join(nodes.select("id"), "id", "left_semi"), nodes)
        flat = lambda d: d.select("id", "label", F.array_sort(F.map_entries("props")).alias("entries"))
        changed = flat(merged).join(flat(kept).select("id", F.col("label").alias("l"), F.col("entries").alias("e")), "id").where("label <> l OR entries <> e")
        if changed.isEmpty():
            return added | {"nodes": nodes.join(kept.select("id"), "id", "left_anti")}, {}
        return added, {"nodes": graph.upsert_nodes(kept, nodes)}

    def upsert_graph(self, nodes: DataFrame, edges: DataFrame) -> int:
        """Merge nodes (id, label, props) and edges (src, rel, dst) that come from elsewhere: new properties go over old ones, edges are kept once.

        A node keeps the folder of its label, so a node is looked up under the label that it comes with.
        """
        added, replaced = self._graph_changes(nodes, edges.distinct())
        return self.store.commit(added, replaced, TABLES, BY)

    def rebuild(self, rows: DataFrame, digests: DataFrame | None = None, notes: Mapping[str, object] | None = None) -> int:
        """Put the ingest of these records in the place of all tables; files keep their numbers."""
        with self.store.staged(ingest.complete(rows)) as batch:
            if (clash := ingest.clashing_files(batch).first()) is not None:
                raise ValueError(f"{clash['files']} files are named {clash['file_name']}: their failures would share ids")
            with self.store.staged(ingest.keyed(ingest.distinct_records(batch))) as keyed, self.store.staged(ingest.identified(ingest.groups_of(keyed).withColumn("key", failure_key()))) as named:
                with self.store.staged(ingest.causes(keyed, named)) as causes:
                    nodes, edges = graph.build(causes)
                    tables = self._tables(batch, named, causes, digests) | {"nodes": nodes, "edges": edges}
                    high = batch.agg(F.max("file_ord")).first()[0]
                    after = max(int(self.store.state()["notes"].get("next_file", 0)), 0 if high is None else high + 1)
                    return self.store.commit(tables, None, TABLES, BY, {**(notes or {}), "next_file": after}, whole=list(tables))
