"""Appends that exclude each other: data first, then the next numbered commit, if nobody has made it.

A table is a folder with ``data``, one folder for each append, and ``commits``,
one small file for each append that counts; it names the append's data. A
writer checks its rows against all commits that it knows and then creates the
file with the next number. If another writer has created it meanwhile, the rows
are checked again, now against the other's too. Readers see what commits name,
so an append that failed or was refused is never seen.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspark.operators.gates import repeated_keys, require_none

Check = Callable[[DataFrame, DataFrame], None]


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with its whole text in one step; False if it is there already.

    On a local or mounted file system by a hard link, elsewhere by a rename,
    which has to refuse a target that exists, as that of HDFS does.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    if files.getScheme() == "file":
        own = target.toUri().getPath()
        draft = f"{os.path.dirname(own)}/.{uuid.uuid4().hex}"
        with open(draft, "x", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(draft, own)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    done = not files.exists(target) and files.rename(draft, target)
    if not done:
        files.delete(draft, False)
    return done


def commits(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """Numbers and data folders of the appends that count, in order; one small row for each append."""
    try:
        read = spark.read.text(f"{folder}/commits").select(F.col("_metadata.file_name").alias("name"), "value")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []
    return sorted((int(r.name.removesuffix(".txt")), r.value) for r in read.collect())


def read_committed(spark: SparkSession, folder: str, schema: StructType, format: str = "parquet") -> DataFrame:
    """The rows of all appends that count; none if there is no table yet."""
    parts = [f"{folder}/{data}" for _, data in commits(spark, folder)]
    return spark.read.schema(schema).format(format).load(parts) if parts else spark.createDataFrame([], schema)


def append(rows: DataFrame, folder: str, keys: Sequence[str], check: Check | None = None, format: str = "parquet", most_tries: int = 100) -> int:
    """Appends ``rows`` as one commit and returns its number, from 1.

    A key that occurs twice or exists already raises ``ValueError``; ``check``
    gets the new rows and those that are there, and may raise as well. Nothing
    counts then. Writers on different machines may append at the same time: of
    those that reach for one number one gets it, the others check again.
    """
    spark = rows.sparkSession
    data = f"data/{uuid.uuid4().hex}"
    rows.write.format(format).save(f"{folder}/{data}")
    new = spark.read.schema(rows.schema).format(format).load(f"{folder}/{data}")
    try:
        require_none(repeated_keys(new, keys), "keys that occur twice")
        for _ in range(most_tries):
            known = commits(spark, folder)
            number = known[-1][0] + 1 if known else 1
            old = read_committed(spark, folder, rows.schema, format)
            require_none(new.select(*keys).join(old.select(*keys), list(keys), "left_semi"), "keys that exist")
            if check:
                check(new, old)
            if create_if_absent(spark, f"{folder}/commits/{number:012d}.txt", data):
                return number
        raise RuntimeError(f"{most_tries} other writers were first")
    except BaseException:
        with contextlib.suppress(Exception):  # what isn't committed is never read, so a remainder does no harm
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{data}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        raise


def links_exist(key: str, links: str) -> Check:
    """A check that every key in the array ``links`` is a key of the rows that are there."""

    def check(new: DataFrame, old: DataFrame) -> None:
        named = new.select(F.explode(links).alias(key)).distinct()
        require_none(named.join(old.select(key), key, "left_anti"), "links to keys that don't exist")

    return check
