"""Extraction of records from reports by passes: context is gathered natively, the model that reads it is an interface."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orelode.operators import gather, merge

# Seconds before another try after a full quota (doubled each time) and after a stalled connection, and parts of
# the messages that tell them.
QUOTA_WAIT, STALL_WAIT, TRIES = 60, 15, 6
QUOTA_PARTS, STALL_PARTS = ("rate_limit", "429", "rate limit"), ("read timeout", "timed out")


def patiently(call: Callable[[], object], tries: int = TRIES, sleep: Callable[[float], None] = time.sleep):
    """What call() returns; full quotas and stalls are waited for, other errors and the last one are raised."""
    for turn in range(tries):
        try:
            return call()
        except Exception as error:
            told = str(error).lower()
            wait = QUOTA_WAIT * 2**turn if any(p in told for p in QUOTA_PARTS) else STALL_WAIT if any(p in told for p in STALL_PARTS) else None
            if wait is None or turn == tries - 1:
                raise
            sleep(wait)


@dataclass
class Pass:
    """One reading of a report: what to look for, and the catalogue of queries that finds its context."""

    focus: str
    catalogue: DataFrame


def contexts(chunks: DataFrame, passes: list[Pass], k: int = 12) -> DataFrame:
    """source_file, pass, prompt for every source and pass that has any context."""
    parts = []
    for number, p in enumerate(passes):
        found = gather.for_topics(chunks, p.catalogue, k)
        payload = F.to_json(F.struct(F.col("file").alias("source_file"), "context"), {"pretty": "true"})
        prompt = F.concat(F.lit(f"FOCUS FOR THIS PASS: {p.focus}\n\nExtract the fields from the context below. Set source_file to '"), "file", F.lit("'.\n\n"), payload)
        parts.append(found.where("trim(context) <> ''").select(F.col("file").alias("source_file"), F.lit(number).alias("pass"), prompt.alias("prompt")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_by(prompts: DataFrame, model: Callable[[str], str], schema: StructType, tries: int = TRIES) -> DataFrame:
    """source_file, pass, error and the fields of schema that the model's JSON answer has; one that fails is an error, not the end of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for prompt in batch.column("prompt").to_pylist():
                try:
                    answers.append(patiently(lambda: model(prompt), tries))  # noqa: B023
                    errors.append(None)
                except Exception as error:  # told in its own row
                    answers.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([batch.column("source_file"), batch.column("pass"), pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=["source_file", "pass", "answer", "error"])

    rows = prompts.select("source_file", "pass", "prompt").mapInArrow(run, "source_file string, pass int, answer string, error string")
    fields = [f.name for f in schema.fields if f.name != "source_file"]
    return rows.withColumn("r", F.from_json("answer", schema)).select("source_file", "pass", "error", *(F.col(f"r.{c}").alias(c) for c in fields))


def records(sources: DataFrame, parts: DataFrame) -> DataFrame:
    """One record for each source (source_file): of each field the first known value in the order of passes; none read gives nulls."""
    return sources.select("source_file").distinct().join(merge.first_known(parts.where("error is null").drop("error")), "source_file", "left")


def spatial_records(sources: DataFrame, parts: DataFrame, lists: list[str], scalars: list[str]) -> DataFrame:
    """As records(), but lists are joined over the passes, notes too, and nothing is confirmed."""
    joined = merge.concatenated(parts.where("error is null").drop("error", "confirmed"), lists, scalars)
    return sources.select("source_file").distinct().join(joined, "source_file", "left").withColumn("confirmed", F.lit(False))


def not_yet(sources: DataFrame, done: DataFrame) -> DataFrame:
    """Sources (source_file) whose stem no document in `done` (stem) has."""
    return sources.withColumn("stem", F.regexp_replace("source_file", r"\.[^.]+$", "")).join(done.select("stem").distinct(), "stem", "left_anti").drop("stem")
