"""Files byte for byte: small ones whole, any one by ranges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that one task reads of a file, and bytes of blocks that it hands on at a time.
TASK_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, content) of files, any bytes."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", "content")


def file_size(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()


def _opened(path: str):
    """A file that a Python worker can seek in: local ones, and those of the file systems that pyarrow knows by their scheme."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(urlparse(path).path)
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def read_ranges(spark: SparkSession, path: str, size: int, block_size: int) -> DataFrame:
    """(ord, begin, stop, block) of a file in blocks; a task reads TASK_BYTES of it and holds BATCH_BYTES, or one block."""
    n = -(-size // block_size)
    each = max(1, BATCH_BYTES // block_size)
    schema = pa.schema([("ord", pa.int32()), ("begin", pa.int64()), ("stop", pa.int64()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _opened(path) as f:
            for batch in batches:
                numbers = batch.column(0).to_pylist()
                for k in range(0, len(numbers), each):
                    begins = [b * block_size for b in numbers[k : k + each]]
                    read = [f.read_at(min(block_size, size - b), b) for b in begins]
                    if any(len(r) != min(block_size, size - b) for r, b in zip(read, begins)):
                        raise EOFError(f"{path} is shorter than it was")
                    yield pa.RecordBatch.from_pydict({"ord": numbers[k : k + each], "begin": begins, "stop": [b + len(r) for b, r in zip(begins, read)], "block": read}, schema=schema)

    tasks = max(1, -(-size // TASK_BYTES))
    return spark.range(0, n, 1, tasks).mapInArrow(run, "ord int, begin long, stop long, block binary")


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, read once from its start by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            out = hashlib.sha256()
            with _opened(path) as f:
                while part := f.read(BATCH_BYTES):
                    out.update(part)
            yield pa.RecordBatch.from_pydict({"digest": [out.hexdigest()]})

    return spark.range(0, 1, 1, 1).mapInArrow(run, "digest string").first().digest
