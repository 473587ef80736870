"""Word reports (.docx) as paragraphs and table rows, read from their zipped XML."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARTS = "path string, file string, kind string, ord int, style string, text string, second string, error string"


def parse(content: bytes) -> Iterator[tuple[str, int, str | None, str, str | None]]:
    """(kind, ord, style, text, second): paragraphs outside of tables, and table rows with their first two cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join("\n" if t.tag == f"{_W}br" else "\t" if t.tag == f"{_W}tab" else t.text or "" for t in node.iter() if t.tag in (f"{_W}t", f"{_W}br", f"{_W}tab"))
    n = 0
    for node in body:
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = styles.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else "Normal"
            yield "paragraph", n, name[:1].upper() + name[1:], text(node), None
            n += 1
        elif node.tag == f"{_W}tbl":
            for row in node.iter(f"{_W}tr"):
                cells = ["\n".join(text(p) for p in c.iter(f"{_W}p")) for c in row.findall(f"{_W}tc")]
                yield "row", n, None, cells[0] if cells else "", cells[1] if len(cells) > 1 else None
                n += 1


def parts(files: DataFrame) -> DataFrame:
    """PARTS of binaryFile rows; a file that can't be read is one row with `error`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARTS.split(", ")]
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                file = path.rsplit("/", 1)[-1]
                try:
                    rows = [(path, file, *x, None) for x in parse(bytes(content))]
                except Exception as e:  # noqa: BLE001
                    rows = [(path, file, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=names).astype({"ord": "Int32"})

    return files.select("path", "content").mapInPandas(run, PARTS)


def only_reports(files: DataFrame) -> DataFrame:
    """The .docx files without lock and hidden ones."""
    name = F.substring_index("path", "/", -1)
    return files.where(F.lower("path").endswith(".docx") & ~name.startswith("~$") & ~name.startswith("."))


def read_reports(spark: SparkSession, path: str, done: DataFrame | None = None) -> DataFrame:
    """PARTS of the .docx files of a folder, lock and hidden files and those in `done` (file) left out."""
    files = only_reports(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)).withColumn("file", F.substring_index("path", "/", -1))
    return parts(files.join(done.select("file"), "file", "left_anti") if done is not None else files)


def products(parts_: DataFrame, word: str = "product", prefix: bool = False) -> DataFrame:
    """(file, product): second cell of the first table row whose first cell has the word."""
    first = F.lower(F.trim("text"))
    hit = first.startswith(word) if prefix else F.contains(first, F.lit(word))
    return parts_.where((F.col("kind") == "row") & hit & F.col("second").isNotNull()).groupBy("file").agg(F.min_by(F.trim("second"), "ord").alias("product"))
