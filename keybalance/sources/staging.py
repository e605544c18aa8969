"""Copies of a table in the form a source expects, in the shared working folder."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.ipc as ipc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from keybalance.workdir import fresh_dir, qualified


def stage_parquet(df: DataFrame, files: int) -> str:
    """``df`` as about ``files`` Parquet files: input for a stream of several batches."""
    path = fresh_dir(df.sparkSession, "parquet")
    df.repartition(files).write.parquet(path)
    return path


def stage_csv(df: DataFrame, sep: str = ",") -> str:
    path = fresh_dir(df.sparkSession, "csv")
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


def stage_arrow_ipc(df: DataFrame) -> str:
    """``df`` as one Arrow IPC file per task, in the file and the stream format by turns.

    The folder's address names its file system, so tasks write where Spark reads. A
    task writes under a name of its own attempt first, so repeated and speculative tasks do no harm.
    """
    path = qualified(df.sparkSession, fresh_dir(df.sparkSession, "arrow"))
    address = re.sub("^file:/+", "file:///", path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        context, rows = TaskContext.get(), 0
        part = context.partitionId()
        opener = ipc.new_stream if part % 2 else ipc.new_file
        system, folder = fs.FileSystem.from_uri(address)
        system.create_dir(folder, recursive=True)
        own = f"{folder}/_attempt-{context.taskAttemptId()}"
        with system.open_output_stream(own) as sink, opener(sink, first.schema) as writer:
            for batch in chain([first], batches):
                writer.write_batch(batch)
                rows += batch.num_rows
        system.move(own, f"{folder}/part-{part:05d}.arrow")
        yield pa.RecordBatch.from_pydict({"rows": [rows]})

    df.mapInArrow(write, "rows bigint").agg({"rows": "sum"}).collect()
    return path
