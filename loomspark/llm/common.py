"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


#: Rows and bytes of an Arrow batch of whole texts; rows are a power of two.
TEXT_BATCH, TEXT_BYTES = 1024, 16 << 20


def in_text_batches(docs: DataFrame) -> DataFrame:
    """``docs``, whose texts Python gets in batches of ``TEXT_BATCH`` rows and ``TEXT_BYTES`` bytes, unless the session asks for fewer.

    The defaults of 10,000 rows and 64 MB are made for numbers; a batch of texts
    is held several times over. One text that is longer is a batch of its own.
    The settings are the session's and hold for what it runs from now on.
    """
    conf = docs.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", TEXT_BATCH), ("maxBytesPerBatch", TEXT_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        held = conf.get(name, str(most + 1)).rstrip("b")
        if not (held.isdigit() and 0 < int(held) <= most):
            conf.set(name, str(most))
    return docs


def by_place(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named c0, c1 and so on, and the new name of each old one.

    Operators that return a table's own columns work on these names, so what
    they add can't clash with a column of the table, whatever it is called.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


#: Into how many parts a key is dealt that may hold a large part of all rows; no more than an int has bits.
SALTS = 16


def with_total(df: DataFrame, keys: list[str], by: str, total: Column, name: str, wanted: str | None = None) -> DataFrame:
    """``df`` with the aggregate ``name`` of its rows with the same keys, without a task that holds all rows of a key.

    Rows of a key are dealt into ``SALTS`` parts by the column ``by``. The
    aggregate combines before it exchanges and notes which parts there are; it
    goes back to each of them. With ``wanted``, only keys stay whose result meets
    it. Keys must not be null.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    whole = dealt.groupBy(*keys).agg(total.alias(name), F.bit_or(F.expr("shiftleft(1, _part)")).alias("_parts"))
    if wanted is not None:
        whole = whole.filter(wanted)
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col("_parts").cast("long"), i) == 1)
    return dealt.join(whole.select(*keys, name, F.explode(parts).alias("_part")), [*keys, "_part"]).drop("_part")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, column: str) -> DataFrame:
    """As :func:`cut`, dealt by ``column``, so that grouping by it moves no row again.

    A checkpoint keeps how it is dealt only if the plan isn't adaptive.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), column))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number for each row, written once to the shared folder and read from there.

    A number is a place in a scan whose splits follow from the cores at hand,
    so what is numbered in one job can't be numbered anew in another.
    """
    path = fresh_path(docs.sparkSession, "numbered")
    rows = docs.withColumn(name, F.monotonically_increasing_id())
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


#: Bytes of texts of a block that goes to the driver and from there to every task.
BLOCK_BYTES = 1 << 20


def in_blocks(rows: DataFrame, text: str, most: int = BLOCK_BYTES) -> Iterator[list[Row]]:
    """The rows of ``rows`` in blocks whose texts have at most ``most`` bytes together, or of one row.

    For a stated set of queries or test items that all rows of a table are held
    against, a block at a time. The rows are stored and numbered once; longer
    texts than half a block are blocks of their own, and the others are dealt
    into twice as many blocks until all are small enough. There is one empty
    block if there are no rows.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 64
    held = numbered(rows, "_block_row").withColumn("_long", size > most // 2)
    few, n = held.filter("NOT _long"), 1
    while True:
        block = F.pmod(F.xxhash64("_block_row"), F.lit(n))
        if (few.groupBy(block.alias("b")).agg(F.sum(size).alias("size")).agg(F.max("size")).first()[0] or 0) <= most:
            break
        n *= 2
    for b in range(n):
        yield few.filter(block == b).drop("_long", "_block_row").collect()
    for row in held.filter("_long").drop("_long", "_block_row").toLocalIterator():
        yield [row]
