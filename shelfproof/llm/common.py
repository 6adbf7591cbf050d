"""What several operators share: the shared folder, running totals by key, words."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII blanks; in UTF-8 this is what ``bytes.split()`` gives.
WORD_SQL = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows a key's totals are first added up over, before one window runs over the totals.
FAN = 1024
#: A table per key (sources, partitions) is broadcast up to so many rows of a few
#: fixed-width columns and a key; beyond, it is spread over salts and shuffled.
SMALL_ROWS = 20_000
SALTS = 32


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; on one machine without it, a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Rows of an Arrow batch where rows carry whole texts: a batch stands in both processes several times over.
BATCH_ROWS = 1024
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Spark removes a query's shuffle files at its end, not when the driver next collects garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Jobs run inside see this value; the session's own comes back afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> contextlib.AbstractContextManager[None]:
    """Jobs run inside send Python at most so many rows at a time; the session's own setting comes back afterwards."""
    before = int(spark.conf.get(BATCH_CONF))
    return setting(spark, BATCH_CONF, str(min(before, rows) if before > 0 else rows))


def stored(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read from there: later jobs start from the files.

    What it shuffled is removed once it is written.  With ``texts``, Arrow functions in ``df`` are given small
    batches, since their rows carry whole texts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP_CONF, "true"), small_batches(spark) if texts else contextlib.nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns freed memory of a Python worker, which outlives its task, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches whose worker gives its memory back at the end of each task."""
    @functools.wraps(run)
    def task(*parts: Iterator) -> Iterator:
        try:
            yield from run(*parts)
        finally:
            give_back()

    return task


def apart(docs: DataFrame, job: Callable[[DataFrame, Callable[[str], str]], DataFrame]) -> DataFrame:
    """``job`` over ``docs`` with columns named by their places, so that none of them meets one of the job's own.

    The job is given the frame and the names that columns have in it, and returns at least these columns.
    """
    names = {c: f"column_{i}_" for i, c in enumerate(docs.columns)}
    out = job(docs.toDF(*names.values()), names.__getitem__)
    return out.select(*[F.col(new).alias(old) for old, new in names.items()])


def size_of(text: Column) -> Column:
    """Number of words, NULL text 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def text_key(text: Column, seed: int) -> Column:
    """A pseudo-random number fixed by value and seed."""
    return F.xxhash64(F.lit(seed), text)


def running_total(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over rows of the same keys with a smaller ``order``.

    ``order`` is a whole number from 0, unique and dense within its key.  Totals are
    taken by ranges of ``FAN`` numbers first, so that no task sees more than
    1/``FAN`` of a key's rows.
    """
    part = df.withColumn("_part", F.floor(F.col(order) / FAN))
    totals = part.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_part"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return (part.alias("l").join(totals.alias("r"), on)
            .select("l.*", F.col("r._base"))
            .withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in", "_part"))


def with_keyed(df: DataFrame, table: DataFrame, key: str, rows: int, spread: Column) -> DataFrame:
    """``df`` with the columns of ``table`` (one row a key, its first column) where the keys are equal, NULL being a key.

    A key may hold a third of ``df``.  A table of at most ``SMALL_ROWS`` (counted by the
    caller) is broadcast.  A larger one is repeated over ``SALTS`` salts, and the rows of
    a key are dealt over them by ``spread``.
    """
    right = table.withColumnRenamed(table.columns[0], "_key")
    if rows <= SMALL_ROWS:
        return df.join(F.broadcast(right), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    right = right.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = df.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    return (left.join(right, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_salt_r")))
            .drop("_key", "_salt", "_salt_r"))


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds ``out``: the place of each row, from 0, in the given order over all rows.

    Rows are range partitioned; places within a partition are added to the sizes of
    the partitions before it, so no task holds the whole order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("_at", F.spark_partition_id()), "ranged")
    within = Window.partitionBy("_at").orderBy(*order)
    ranged = ranged.withColumn("_n", F.row_number().over(within).cast("long") - 1)
    sizes = dict(ranged.groupBy("_at").count().collect())  # one row a partition
    base, bases = 0, {}
    for at in sorted(sizes):
        bases[at] = base
        base += sizes[at]
    table = spark.createDataFrame(sorted(bases.items()), "_p int, _base long")
    return (ranged.join(F.broadcast(table), F.col("_at") == F.col("_p"))
            .withColumn(out, F.col("_n") + F.col("_base")).drop("_at", "_n", "_p", "_base"))
