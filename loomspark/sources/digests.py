"""Digests of files that are read as streams, so no file has to fit in a row or in memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20


def file_digests(spark: SparkSession, path: str, files_per_task: int = 16) -> DataFrame:
    """path, length and sha256 of every file below ``path``, of any length.

    Spark lists the files without reading them and deals them out by their paths; a task opens
    one at a time and reads it in blocks. The store has to be one that pyarrow
    opens: local and mounted folders, HDFS and the usual object stores. Empty
    files, which Spark's readers leave out, aren't listed.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for name in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(name)
                own = hashlib.sha256()
                with store.open_input_stream(at) as stream:
                    while block := stream.read(BLOCK):
                        own.update(block)
                digests.append(own.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string())], ["path", "length", "sha256"])

    parts = max(1, -(-found.count() // files_per_task))
    return found.repartition(parts, F.xxhash64("path")).mapInArrow(digest, "path string, length long, sha256 string")
