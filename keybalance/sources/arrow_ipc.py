"""Arrow IPC files, read on the executors batch by batch.

A file in the file format ends with an index of its record batches. Tasks read the indexes first, and
the batches are then dealt out: a task opens the file, and reads the bytes of its own batches only. So
one large file loads in parallel, and memory holds one batch at a time. A file in the stream
format has no index; one task reads it from front to back, also batch by batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.ipc as ipc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

#: What a file of the IPC file format starts with; anything else is taken as a stream.
MAGIC = b"ARROW1"
#: No task is made for less than this.
LEAST_SPLIT = 1 << 12
_LOCATION = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(/.*)", re.DOTALL)


# ------------------------------------------------------------ opening


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark lists it, and the path within."""
    scheme, host, inner = _LOCATION.fullmatch(path).groups()
    if scheme == "file":
        return fs.LocalFileSystem(), inner
    system, root = fs.FileSystem.from_uri(f"{re.sub('^s3[an]$', 's3', scheme)}:{host or '//'}/")
    return system, root.rstrip("/") + inner


def _reachable(path: str) -> bool:
    """Whether Arrow has a file system for this path; Spark may know more of them."""
    try:
        system, inner = located(path)
        return system.get_file_info(inner).type == fs.FileType.File
    except (pa.ArrowException, OSError):
        return False


def _reader(source):
    """Reader of an open file: by batch number for the file format, else a stream."""
    start = source.read(len(MAGIC))
    source.seek(0)
    return ipc.open_file(source) if start == MAGIC else ipc.open_stream(source)


def _opened(path: str):
    system, inner = located(path)
    return _reader(system.open_input_file(inner))


# ------------------------------------------------------------ what tasks do


def _pieces(split: int):
    """For ``mapInArrow``: file rows in, ranges of batches out; a stream is one range without numbers."""

    def index(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in files:
            out = []
            for path, length in zip(rows.column("path").to_pylist(), rows.column("length").to_pylist()):
                reader = _opened(path)
                if isinstance(reader, ipc.RecordBatchFileReader):
                    n = reader.num_record_batches
                    step = max(1, split * n // max(length, 1))
                    out += [(path, a, min(a + step, n)) for a in range(0, n, step)]
                else:
                    out.append((path, None, None))
            paths, firsts, ends = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(firsts, pa.int32()), pa.array(ends, pa.int32())],
                names=["path", "first", "end"],
            )

    return index


def _conform(names: list[str], target: pa.Schema):
    """Rows of a file's batch as rows of the declared schema; a column that it lacks is null."""

    def conform(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [
            batch.column(n).cast(t) if n in batch.schema.names else pa.nulls(batch.num_rows, t)
            for n, t in zip(names, target.types)
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return conform


def _batches(names: list[str], target: pa.Schema):
    """For ``mapInArrow``: ranges of batches in, their rows out."""
    conform = _conform(names, target)

    def decode(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces:
            for piece in rows.to_pylist():
                reader = _opened(piece["path"])
                if piece["first"] is None:
                    yield from map(conform, reader)
                else:
                    for i in range(piece["first"], piece["end"]):
                        yield conform(reader.get_batch(i))

    return decode


def _whole_files(names: list[str], target: pa.Schema):
    """For ``mapInArrow``: file contents in, their rows out."""
    conform = _conform(names, target)

    def decode(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in files:
            for content in rows.column("content"):
                reader = _reader(pa.BufferReader(content.as_py()))
                if isinstance(reader, ipc.RecordBatchFileReader):
                    yield from (conform(reader.get_batch(i)) for i in range(reader.num_record_batches))
                else:
                    yield from map(conform, reader)

    return decode


# ------------------------------------------------------------ schema and splits


def _schema_of_all(files: DataFrame, reachable: bool) -> T.StructType:
    """Columns of all files, in the order of their first mention by name of file.

    Tasks read the files' schemas; the driver gets the distinct ones. A column with
    different types in different files is an error.
    """

    def describe(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if reachable:
                readers = [_opened(p) for p in batch.column("path").to_pylist()]
            else:
                readers = [_reader(pa.BufferReader(c.as_py())) for c in batch.column("content")]
            found = [from_arrow_schema(r.schema, prefer_timestamp_ntz=True).json() for r in readers]
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "s": found})

    columns = ["path"] if reachable else ["path", "content"]
    schemas = files.select(*columns).mapInArrow(describe, "path string, s string")
    distinct = schemas.groupBy("s").agg({"path": "min"}).orderBy("min(path)").collect()
    fields: dict[str, T.StructField] = {}
    for row in distinct:
        for field in T.StructType.fromJson(json.loads(row["s"])).fields:
            known = fields.setdefault(field.name, field)
            if known.dataType != field.dataType:
                raise ValueError(
                    f"column {field.name!r} is {known.dataType.simpleString()} in one file and "
                    f"{field.dataType.simpleString()} in another; give a schema"
                )
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields.values()])


def _split_bytes(spark: SparkSession, total: int) -> int:
    """As for Spark's own files: the session's bytes per partition, or less if cores would be idle."""
    most = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    ))
    return min(most, -(-total // spark.sparkContext.defaultParallelism))


def read_arrow_ipc(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    split_bytes: int | None = None,
) -> DataFrame:
    """Rows of all Arrow IPC files under ``path``, in the file or the stream format.

    Spark lists the files, and its tasks read them through Arrow's file systems, ``split_bytes`` or at
    least one record batch a task. Where Arrow has no file system for the address, files come whole through
    Spark's instead, one task each and 2 GiB at most. With no ``schema`` it is the
    union of all files' schemas, which tasks read first; a column that a file lacks is null.
    """
    files = spark.read.format("binaryFile").load(path)
    listed = files.select("path", "length")
    some = listed.first()
    if some is None and schema is None:
        raise ValueError("no Arrow IPC file to infer a schema from; give one")
    reachable = some is not None and _reachable(some["path"])
    if schema is None:
        schema = _schema_of_all(files, reachable)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if not reachable:
        return files.select("content").mapInArrow(
            _whole_files(schema.names, to_arrow_schema(schema)), schema
        )
    total = listed.agg(F.sum("length")).first()[0]
    split = max(LEAST_SPLIT, split_bytes or _split_bytes(spark, total))
    pieces = listed.mapInArrow(_pieces(split), "path string, first int, end int")
    dealt = pieces.repartition(max(1, -(-total // split)))
    return dealt.mapInArrow(_batches(schema.names, to_arrow_schema(schema)), schema)
