"""Token shards: name.bin holds little-endian uint16 ids end to end, name.idx the int64 token index where each document starts."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "shard string, doc_idx bigint, tokens array<int>"


def write_shard(path: str, documents: list[list[int]]) -> None:
    """Both files of one shard; ids have to fit into 16 bits. Written under another name and moved, so that a retry leaves no half."""
    flat = np.array([t for d in documents for t in d], np.int64)
    if len(flat) and (flat.min() < 0 or flat.max() > 65_535):
        raise ValueError("a token id does not fit into 16 bits")
    starts = np.cumsum([0, *map(len, documents)])[:-1] if documents else np.zeros(0)
    for name, data in ((f"{path}.idx", starts.astype("<i8")), (f"{path}.bin", flat.astype("<u2"))):
        data.tofile(f"{name}.part")
        os.replace(f"{name}.part", name)


def read_shard(path: str) -> list[list[int]]:
    """Documents of one shard; without an index the whole shard is one document."""
    flat = np.fromfile(path, "<u2").astype(int)
    index = path.removesuffix(".bin") + ".idx"
    starts = np.fromfile(index, "<i8") if os.path.exists(index) else np.zeros(min(1, len(flat)), int)
    return [part.tolist() for part in np.split(flat, starts[1:])] if len(starts) else []


def shard_index(path: str) -> list[int] | None:
    """Where the documents of a shard start, None where it has no index file."""
    index = path.removesuffix(".bin") + ".idx"
    return np.fromfile(index, "<i8").tolist() if os.path.exists(index) else None


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, doc_idx, tokens) of all shards of a folder in any file system Spark reads; without an index a shard is one document.

    Both files come by Spark's own reader and meet on the shard's name; an empty folder has no rows.
    """
    name = F.regexp_extract("path", r"([^/]+)\.(?:bin|idx)$", 1)
    files = [spark.read.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(folder).select(name.alias("shard"), F.col("content").alias(kind)) for kind in ("bin", "idx")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, tokens, index in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flat = np.frombuffer(tokens, "<u2").astype(np.int32)
                starts = np.zeros(min(1, len(flat)), np.int64) if index is None else np.frombuffer(index, "<i8")
                ends = pa.array(np.append(starts, len(flat)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(starts), pa.string()), pa.array(np.arange(len(starts))), pa.ListArray.from_arrays(ends, pa.array(flat)) if len(starts) else pa.array([], pa.list_(pa.int32()))], names=["shard", "doc_idx", "tokens"])

    return files[0].join(files[1], "shard", "left").select("shard", "bin", "idx").mapInArrow(run, SCHEMA)


def list_shards(folder: str) -> list[str]:
    return sorted(glob.glob(os.path.join(folder, "*.bin")))


class _Partition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [_Partition(p) for p in list_shards(self.folder)] or [_Partition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            for i, tokens in enumerate(read_shard(partition.value)):
                yield os.path.basename(partition.value).removesuffix(".bin"), i, tokens


class _Writer(DataSourceWriter):
    """A task writes shards of its rows; names hold the partition, so that tasks never meet."""

    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        part, held, n, k = TaskContext.get().partitionId(), [], 0, 0
        for row in rows:
            held.append(list(row.tokens))
            n += len(row.tokens)
            if n >= self.size:
                write_shard(os.path.join(self.folder, f"shard_{part:05d}_{k:05d}"), held)
                held, n, k = [], 0, k + 1
        if held:
            write_shard(os.path.join(self.folder, f"shard_{part:05d}_{k:05d}"), held)
        return WriterCommitMessage()


class TokenShards(DataSource):
    """spark.read.format("token_shards").load(folder); option shard_tokens bounds the size when writing."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("shard_tokens", 100_000_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenShards)


def total_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of a folder's shards from the file sizes alone; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    return files.agg(F.coalesce(F.sum(F.expr("length div 2")), F.lit(0)).alias("n_tokens"))
