"""Versioned tables in one folder: commits of several tables at once, readers pinned to a version, untouched partitions keep their files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Rows of a part that are worth a part of their own: parts grow in number with a table, so that a look-up reads no more of a larger one.
PART_ROWS = 100_000
#: Parts of a table that is new.
FIRST_PARTS = 4
#: Batches that a part may lie in before a commit writes it anew as one.
MOST_BATCHES = 16


def part_of(key: Sequence[str], parts: int) -> Column:
    """The part of a row by its key: a hash modulo a power of two."""
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class Table:
    """Where a table is at a version: its schema, key, number of parts, the columns it is dealt by, and the batches of each partition."""

    schema: str
    key: list[str]
    by: list[str]
    parts: int
    rows: int
    live: dict[str, list[str]]


class Store:
    """A folder of tables; its versions are small files, each naming the batches that belong to it, so a version is there as a whole or not at all.

    A table is dealt into folders by `by` (if any) and `part`, a hash of its key. A commit adds rows to partitions or replaces partitions; it writes new
    folders only and names them in the next version's file, which is made by a rename. A crash before it leaves the version before.
    Two writers can't make the same version: the second one's rename fails. The driver reads the version's file: one entry a partition and batch.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(f"{self.path}/_versions").getFileSystem(spark._jsc.hadoopConfiguration())

    # --- Versions ---------------------------------------------------------------------------------------------

    def _versions(self) -> list[int]:
        folder = self._fs_path(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max(self._versions(), default=0)

    def state(self, version: int | None = None) -> dict:
        """{version, tables, notes} of a version, the newest if None."""
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}, "notes": {}}
        text = self.spark.read.text(f"{self.path}/_versions/{version:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def table(self, name: str, version: int | None = None) -> Table | None:
        found = self.state(version)["tables"].get(name)
        return Table(**found) if found else None

    # --- Reading ------------------------------------------------------------------------------------------------

    def read(self, name: str, version: int | None = None, only: Sequence[str] | None = None) -> DataFrame:
        """The rows of a table at a version; of the partitions `only`, if given (folders such as part=3 or label=x/part=3)."""
        t = self.table(name, version)
        if t is None:
            raise ValueError(f"{self.path} has no table {name}")
        schema = StructType.fromJson(json.loads(t.schema))
        paths = [f"{self.path}/{name}/batch={b}/{p}" for p, batches in t.live.items() if only is None or p in only for b in batches]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self._load(name, schema, paths)

    def _load(self, name: str, schema: StructType, paths: list[str]) -> DataFrame:
        whole = StructType([*schema.fields, StructField("batch", StringType()), StructField("part", IntegerType())])
        return self.spark.read.option("basePath", f"{self.path}/{name}").schema(whole).parquet(*paths).select(*schema.names)

    # --- Writing ------------------------------------------------------------------------------------------------

    def _write(self, name: str, rows: DataFrame, key: Sequence[str], by: Sequence[str], parts: int) -> tuple[str, list[str]]:
        """The new batch and its partitions; rows are dealt by partition, so that each is written by one task."""
        batch = uuid.uuid4().hex
        folder = f"{self.path}/{name}/batch={batch}"
        dealt = rows.withColumn("part", part_of(key, parts))
        dealt.repartition(*by, "part").write.partitionBy(*by, "part").parquet(folder)
        at = self._fs_path(folder)
        return batch, self._folders(at, 1 + len(by)) if self._fs.exists(at) else []

    @contextmanager
    def staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """rows written beside the tables and read again, for what a commit reads more than once; gone afterwards."""
        folder = f"{self.path}/_staged/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        try:
            yield self.spark.read.schema(rows.schema).parquet(folder)
        finally:
            self._fs.delete(self._fs_path(folder), True)

    def _folders(self, at, depth: int) -> list[str]:
        """Partition folders below a batch, as relative paths."""
        found = [f.getPath() for f in self._fs.listStatus(at) if f.isDirectory() and "=" in f.getPath().getName()]
        if depth == 1:
            return [p.getName() for p in found]
        return [f"{p.getName()}/{rest}" for p in found for rest in self._folders(p, depth - 1)]

    def touched(self, name: str, rows: DataFrame) -> list[str]:
        """The partitions of a table that hold the keys of rows (which have the key's and the dealing columns)."""
        t = self.table(name)
        if t is None:
            return []
        # One row a partition at most.
        found = rows.select(*t.by, part_of(t.key, t.parts).alias("part")).distinct().collect()
        names = {"/".join([*(f"{c}={r[c]}" for c in t.by), f"part={r['part']}"]) for r in found}
        return [p for p in t.live if p in names]

    def commit(self, added: Mapping[str, DataFrame] | None = None, replaced: Mapping[str, DataFrame] | None = None, keys: Mapping[str, Sequence[str]] | None = None, by: Mapping[str, Sequence[str]] | None = None, notes: Mapping[str, object] | None = None, whole: Sequence[str] = ()) -> int:
        """Add rows to tables and replace partitions of others, as one new version; its number.

        `keys` and `by` name the key and the dealing columns of tables that are new. A replaced partition holds what the frame has for it; tables in
        `whole` are replaced altogether. A table that has outgrown its parts is dealt anew into twice as many as it needs, so seldom; one
        with a part in too many batches is written as one batch. `notes` are kept in the version and go over those before.
        """
        state = self.state()
        tables = {n: Table(**t) for n, t in state["tables"].items()}
        todo = [(name, rows, False) for name, rows in (added or {}).items()] + [(name, rows, True) for name, rows in (replaced or {}).items()]

        def written(job: tuple[str, DataFrame, bool]) -> Table:
            name, rows, replaces = job
            old = tables.get(name)
            new = old is None or name in whole
            key = list((keys or {}).get(name) or (old.key if old else rows.columns[:1]))
            dealt = list((by or {}).get(name) or (old.by if old else []))
            parts = FIRST_PARTS if new else old.parts
            batch, found = self._write(name, rows, key, dealt, parts)
            live = {} if new else {p: list(b) for p, b in old.live.items()}
            for p in found:
                live[p] = [batch] if new or replaces else [*live.get(p, []), batch]
            # Counted from the footers of what was written.
            wrote = self._load(name, rows.schema, [f"{self.path}/{name}/batch={batch}/{p}" for p in found]).count() if found else 0
            total = wrote if new else old.rows + wrote * (not replaces)
            made = Table(rows.schema.json(), key, dealt, parts, total, live)
            want = 1 << max(0, (total // PART_ROWS)).bit_length()
            if want > parts:
                return self._dealt_anew(name, made, 2 * want)
            return self._dealt_anew(name, made, parts) if max((len(b) for b in live.values()), default=0) > MOST_BATCHES else made

        # Tables are written beside each other; a failure of one ends the commit.
        with ThreadPoolExecutor(max_workers=4) as pool:
            tables |= dict(zip([name for name, *_ in todo], list(pool.map(written, todo))))
        return self._publish(state["version"] + 1, tables, {**state["notes"], **(notes or {})})

    def _dealt_anew(self, name: str, t: Table, parts: int) -> Table:
        paths = [f"{self.path}/{name}/batch={b}/{p}" for p, batches in t.live.items() for b in batches]
        schema = StructType.fromJson(json.loads(t.schema))
        batch, found = self._write(name, self._load(name, schema, paths), t.key, t.by, parts)
        return Table(t.schema, t.key, t.by, parts, t.rows, {p: [batch] for p in found})

    def _publish(self, version: int, tables: Mapping[str, Table], notes: Mapping[str, object]) -> int:
        text = json.dumps({"version": version, "tables": {n: vars(t) for n, t in tables.items()}, "notes": notes})
        folder = f"{self.path}/_versions"
        self._fs.mkdirs(self._fs_path(folder))
        draft, final = self._fs_path(f"{folder}/_{uuid.uuid4().hex}"), self._fs_path(f"{folder}/{version:012d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was made by another writer")
        return version

    def vacuum(self, keep: int = 2) -> int:
        """Delete version files but for the newest `keep`, and the batches that no kept version names (crashed commits' too); the number of batches."""
        versions = self._versions()
        kept = versions[-keep:]
        states = [self.state(v) for v in kept]
        gone = 0
        for name in {n for s in states for n in s["tables"]}:
            used = {b for s in states if name in s["tables"] for batches in s["tables"][name]["live"].values() for b in batches}
            for f in self._fs.listStatus(self._fs_path(f"{self.path}/{name}")):
                if f.getPath().getName().removeprefix("batch=") not in used:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
        for v in versions[:-keep]:
            self._fs.delete(self._fs_path(f"{self.path}/_versions/{v:012d}.json"), False)
        return gone

