"""Answers of a model, kept by their content: what was answered once is never asked again, whatever becomes of a task, a job or a session.

Below the folder `kept` lie `answers` (key, answer), a Parquet table, and `calls`, the log of the run that goes on: one small file of JSON lines for each
batch that a model answered, written by the task that asked and given its name only when it is whole. The next run takes a log that was
left behind into the table before it looks for what is still to be asked. The key is a digest of the model's version and the prompt.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import shared_folder
from . import eightd

Model = Callable[[list[str]], list[str]]
KEPT = "key string, answer string"
SENTENCES = "struct<sentences:array<string>>"
CASE = "struct<failure_mode:string,failure_effect:string,root_causes:array<struct<failure_cause:string,cause_level:string,discipline_type:string,confidence:string>>>"


def _there(path: str) -> bool:
    system, at = fs.FileSystem.from_uri(path)
    return system.get_file_info(at).type == fs.FileType.Directory


def _drop(path: str) -> None:
    system, at = fs.FileSystem.from_uri(path)
    if system.get_file_info(at).type == fs.FileType.Directory:
        system.delete_dir(at)


def kept_answers(spark: SparkSession, kept: str) -> DataFrame:
    """(key, answer) of all that was answered in runs that ended or were taken in since."""
    path = f"{kept}/answers"
    return spark.read.schema(KEPT).parquet(path) if _there(path) else spark.range(0).select(F.lit("").alias("key"), F.lit("").alias("answer"))


def take_in(spark: SparkSession, kept: str) -> None:
    """The log of calls becomes part of the table. Cut short and begun again it adds no answer twice."""
    calls = f"{kept}/calls"
    if not _there(calls):
        return
    loose = spark.read.schema(KEPT).json(calls).dropDuplicates(["key"])
    loose.join(kept_answers(spark, kept).select("key"), "key", "left_anti").write.mode("append").parquet(f"{kept}/answers")
    _drop(calls)


def _asking(model: Model, calls: str, batch: int, pending: str | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Asks a task's prompts by batches; no more of them once `pending` is gone, as the run that the task belongs to has ended then."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = fs.FileSystem.from_uri(calls)
        system.create_dir(at, recursive=True)
        rows = (row for f in frames for row in zip(f["key"], f["prompt"]))
        while some := list(islice(rows, batch)):
            # The same rows in the same order in each attempt: a batch that an earlier one asked is found by its name.
            name = hashlib.sha256("".join(k for k, _ in some).encode()).hexdigest()
            if system.get_file_info(f"{at}/{name}.json").type != fs.FileType.File:
                if pending and not _there(pending):
                    raise RuntimeError("the run of this task has ended")
                answers = model([p for _, p in some])
                if len(answers) != len(some):
                    raise ValueError(f"{len(answers)} answers to {len(some)} prompts")
                draft = f"{at}/_{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as f:
                    f.write("".join(json.dumps({"key": k, "answer": a}) + "\n" for (k, _), a in zip(some, answers)).encode())
                system.move(draft, f"{at}/{name}.json")
            yield pd.DataFrame({"asked": [len(some)]})

    return run


def answered(rows: DataFrame, model: Model, kept: str, text: str = "text", version: str = "", batch: int = 32, tasks: int | None = None, name: str = "answer") -> DataFrame:
    """rows with `name`: the model's answer to the text, from the table where it is there, else asked for and kept.

    Equal texts are asked once. A null text is not asked and has a null answer; an answer of null is kept like others. Batches are answered by `tasks` tasks (those
    that run at once, if none is given). A task that is run again asks the batches that have no file yet; two attempts at once (speculation) may both ask the batch that they meet at.
    Failing models end the job; what others answered stays. One run at a time writes to a folder. Another version asks everything anew.
    """
    spark = rows.sparkSession
    take_in(spark, kept)
    keyed = rows.withColumn("_key", F.sha2(F.concat(F.lit(version), F.lit("\x1f"), F.col(text)), 256))
    asked = keyed.where("_key IS NOT NULL").select(F.col("_key").alias("key"), F.col(text).alias("prompt"))
    if _there(f"{kept}/answers"):
        asked = asked.join(kept_answers(spark, kept).select("key"), "key", "left_anti")
    pending = f"{kept}/pending/{uuid.uuid4().hex}"
    # Dealt to the tasks that ask before equal ones are told, so that prompts are shuffled once. Written, so that a task run again gets the same rows in the same order.
    asked.repartition(tasks or spark.sparkContext.defaultParallelism, "key").dropDuplicates(["key"]).sortWithinPartitions("key").write.parquet(pending)
    try:
        todo = spark.read.schema("key string, prompt string").parquet(pending)
        todo.mapInPandas(_asking(model, f"{kept}/calls", batch, pending), "asked int").write.format("noop").mode("overwrite").save()
    finally:
        _drop(pending)
    take_in(spark, kept)
    known = kept_answers(spark, kept).select(F.col("key").alias("_key"), F.col("answer").alias(name))
    return keyed.drop(name).join(known, "_key", "left").drop("_key")


def parsed(rows: DataFrame, schema: str, name: str = "answer") -> DataFrame:
    """rows with the answer's JSON in this schema, without what a model wraps it in; null where it does not parse."""
    return rows.withColumn(name, F.from_json(T.json_slice(F.col(name)), schema))


def selected(sections: DataFrame, model: Model, kept: str, version: str = "") -> DataFrame:
    """(file, source_section, place, sentence, sentence_id) that a model picks from each section (file, source_section, text).

    It answers a section's name, a line end and its text by {"sentences": [...]}. Blank sentences drop out; what does not parse picks none.
    """
    prompts = sections.select("file", "source_section", F.concat_ws("\n", "source_section", F.coalesce("text", F.lit(""))).alias("prompt"))
    found = parsed(answered(prompts, model, kept, "prompt", version), SENTENCES)
    said = F.filter(F.transform("answer.sentences", lambda s: F.trim(s)), lambda s: s != "")
    rows = found.select("file", "source_section", F.posexplode(said).alias("place", "sentence")).withColumn("place", F.col("place") + 1)
    return eightd.sentence_ids(rows, "file", "source_section", "place")


def consolidated(sentences: DataFrame, sections: DataFrame, model: Model, kept: str, version: str = "") -> DataFrame:
    """(file, failure_mode, failure_effect, root_causes) of each case, made by a model from the selected sentences, once they are held against the case's own text.

    It sees a block of signals for each of D2, D3 and D4 and answers in CASE; causes are made whole by `eightd.root_cause_defaults`. A case whose answer does not parse has
    nulls and no causes, as has one without sentences, which is asked all the same.
    """
    held = eightd.annotated(sentences, sections)
    lines = held.select("file", F.col("place").alias("ord"), "sentence_id", F.col("sentence").alias("text"), "source_section", F.lit(None).cast("string").alias("status"), "faithful_score", "faithful_type", F.lit(None).cast("string").alias("subject"))
    names = ("D2", "D3", "D4")
    every = sections.select("file").distinct().join(eightd.signals(lines, "file", names), "file", "left")
    prompt = F.concat_ws("\n", *[F.concat(F.lit(f"{n}:\n"), F.coalesce(n, F.lit("- (none)"))) for n in names])
    # Written, as prompts are read twice: to ask and to join the answers.
    path = shared_folder(sections.sparkSession)
    every.select("file", prompt.alias("prompt")).write.parquet(path)
    found = parsed(answered(sections.sparkSession.read.parquet(path), model, kept, "prompt", version), CASE)
    made = eightd.root_cause_defaults(F.concat(F.lit("report_"), F.col("file").cast("string")), F.col("answer.root_causes"))
    return found.select("file", "answer.failure_mode", "answer.failure_effect", made.alias("root_causes"))
