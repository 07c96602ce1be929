"""Binary formats, all big-endian: edge files of twelve bytes a record (i, j, dist), merge logs and sequence stores.

A merge log has a byte 1 and (cluster, sequence) for each single sequence, and a byte 0 and (a, b, merged, distance) for
each merge, so its records can only be read in order, a file at a time; files are read in parallel. A store has the
number of sequences, their common width, and then (id, bases) of fixed size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = 12


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns], axis=1).astype(">i4")
        yield pa.record_batch([pa.array([rows.tobytes()], pa.binary())], names=["value"])


def packed_edges(edges: DataFrame) -> DataFrame:
    """(value): the records of a batch of edges. A self-edge is an error."""
    checked = F.when(F.col("i") == F.col("j"), F.raise_error(F.lit("an edge joins an id with itself"))).otherwise(F.col("dist"))
    return edges.select(F.col("i").cast("int"), F.col("j").cast("int"), checked.cast("int").alias("dist")).mapInArrow(_pack, "value binary")


def write_edges(edges: DataFrame, path: str) -> None:
    """A Parquet table of packed batches keeps the record layout; :func:`export_edges` writes plain files."""
    packed_edges(edges).write.parquet(path)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            if len(raw) % RECORD:
                raise ValueError("an edge file's length is no multiple of the record's")
            rows = np.frombuffer(raw, ">i4").reshape(-1, 3).astype(np.int32)
            if (rows[:, 0] == rows[:, 1]).any():
                raise ValueError("an edge joins an id with itself")
            yield pa.record_batch([pa.array(rows[:, k].copy()) for k in range(3)], names=["i", "j", "dist"])


def unpacked_edges(packed: DataFrame) -> DataFrame:
    return packed.select("value").mapInArrow(_unpack, "i int, j int, dist int")


def export_edges(edges: DataFrame, path: str) -> None:
    """Plain edge files, one for each partition, named by it, in the order of the partitions.

    ``path`` is a URI that all executors reach (hdfs://, s3://, or file:// and a plain path of a shared folder). A task
    writes under a name of its own and renames at the end, so one that is run again leaves no half of a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyarrow import fs
        from pyspark import TaskContext

        files, folder = fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
        files.create_dir(folder, recursive=True)
        task = TaskContext.get()
        begun, name = f"{folder}/.part-{task.partitionId():05d}-{task.taskAttemptId()}", f"{folder}/part-{task.partitionId():05d}.bin"
        with files.open_output_stream(begun) as out:
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    out.write(raw)
        files.move(begun, name)
        yield pa.record_batch([pa.array([task.partitionId()], pa.int32())], names=["part"])

    packed_edges(edges).mapInArrow(write, "part int").count()


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Plain edge files of any size: records of fixed length are split anywhere between them and read in parallel."""
    records = spark.sparkContext.binaryRecords(path, RECORD)
    joined = records.mapPartitions(lambda rows: (bytearray(x) for x in _chunks(rows)))
    return unpacked_edges(joined.map(lambda x: (x,)).toDF("value binary"))


def _chunks(rows: Iterator[bytes], size: int = 100_000) -> Iterator[bytes]:
    part: list[bytes] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield b"".join(part)
            part = []
    if part:
        yield b"".join(part)


def merge_log(rows: Iterable[tuple]) -> bytes:
    """(is_leaf, ci, cj, ck, dist) rows as a log; a leaf is cluster ck with the sequence ci."""
    return b"".join(struct.pack(">?ii", True, ck, ci) if leaf else struct.pack(">?iiii", False, ci, cj, ck, dist) for leaf, ci, cj, ck, dist in rows)


def parse_merge_log(raw: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(raw):
        if raw[at]:
            ck, ci = struct.unpack_from(">ii", raw, at + 1)
            yield True, ci, None, ck, None
            at += 9
        else:
            ci, cj, ck, dist = struct.unpack_from(">iiii", raw, at + 1)
            yield False, ci, cj, ck, dist
            at += 17


def read_merge_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, step, is_leaf, ci, cj, ck, dist) of all logs under a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("step", pa.int32()), ("is_leaf", pa.bool_()), *((c, pa.int32()) for c in ("ci", "cj", "ck", "dist"))])
        for batch in batches:
            for name, raw in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(name, n, *r) for n, r in enumerate(parse_merge_log(raw), 1)]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, step int, is_leaf boolean, ci int, cj int, ck int, dist int")


def sequence_store(rows: list[tuple[int, bytes]]) -> bytes:
    """A store of (id, bases); all must have one width."""
    width = len(rows[0][1]) if rows else 0
    if any(len(b) != width for _, b in rows):
        raise ValueError("sequences of a store must have one width")
    return struct.pack(">qi", len(rows), width) + b"".join(struct.pack(">i", n) + b for n, b in rows)


def parse_sequence_store(raw: bytes, offset: int = 0, count: int | None = None) -> list[tuple[int, bytes]]:
    """The sequences from ``offset`` on, at most ``count``; a store whose size doesn't fit its head is an error."""
    n, width = struct.unpack_from(">qi", raw)
    if len(raw) != 12 + n * (4 + width):
        raise ValueError("the store's size doesn't fit its number of sequences")
    last = n if count is None else min(n, offset + count)
    at = [12 + k * (4 + width) for k in range(offset, last)]
    return [(struct.unpack_from(">i", raw, k)[0], raw[k + 4 : k + 4 + width]) for k in at]
