"""The live behaviours as Structured Streaming jobs.

Every sink here is a folder in shared storage and every write is keyed by the
batch id, so a batch that runs again after a lost executor replaces its own
output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfproof.functions.values import lit


def distinct_sightings(log: DataFrame, columns: list[str], keys=("run_id", "asin"), started: str = "run_started",
                       late: str = "2 days", seen_at: str = "seen_at_ts", order: str = "position") -> DataFrame:
    """First sighting of a product per run as state, so that one that arrives late but was seen earlier wins.

    ``started`` is when a run began, the same on all its sightings.  A run that began ``late`` before the newest
    one is closed: its state is dropped, and what still comes of it is not read, so state is as large as the open runs.
    Combined on the map side; run in update mode into ``Merged``.
    """
    return log.withWatermark(started, late).groupBy(started, *keys).agg(
        F.min_by(F.struct(*columns), F.struct(seen_at, order)).alias("first"))


def freshest(captures: DataFrame, key: str, stamp: str, order: str, columns: list[str]) -> DataFrame:
    """Freshest capture per key of one batch: a late older copy loses, an equal one keeps the first.

    ``order`` is numeric.  The aggregate combines on the map side, so one key
    with very many captures is a row per task.  ``freshest_of`` merges batches; no state is kept in the stream.
    """
    rank = F.struct(F.col(stamp).alias("stamp"), (-F.col(order)).alias("turn"))
    return captures.groupBy(key).agg(F.max_by(F.struct(*columns), rank).alias("capture"), F.max(rank).alias("rank"),
                                     F.count(lit(1)).alias("captures"))


def freshest_of(key: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(key).agg(
        F.max_by("capture", "rank").alias("capture"), F.max("rank").alias("rank"),
        F.sum("captures").alias("captures"), F.max("batch_id").alias("batch_id"))


def newest_of(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """The last update of each key."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_last")).select(
            *keys, *[F.col(f"_last.{c}").alias(c) for c in rest])

    return merge


def counters(log: DataFrame, stamp: str, tests: dict[str, Column], window: str = "5 minutes",
             late: str = "10 minutes") -> DataFrame:
    """Counters per time window; windows close ``late`` after their end."""
    return (log.withWatermark(stamp, late).groupBy(F.window(stamp, window))
            .agg(*[F.count_if(c).alias(name) for name, c in tests.items()])
            .select(F.col("window.start").alias("window_start"), *tests))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet table, then stop."""
    return (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start(path))


def run_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None],
                mode: str = "append") -> StreamingQuery:
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(each).start())


@dataclass(frozen=True)
class Merged:
    """A table of one row per key, fed by batches.

    A batch writes its rows under its id.  Every ``every`` batches they are merged with the table so far into
    a new one, and what that one replaces is removed a round later, so a reader meets at most one table and
    ``every`` batches, however long the stream runs.  ``merge`` takes rows of several batches (``batch_id``) to one per key
    and may be applied to its own result.
    """

    path: str
    merge: Callable[[DataFrame], DataFrame]
    every: int = 10

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batches/at={batch_id}")
        if (batch_id + 1) % self.every == 0:
            spark = batch.sparkSession
            whole = self.read(spark, upto=batch_id)
            if whole is not None:
                whole.write.mode("overwrite").parquet(f"{self.path}/tables/at={batch_id}")
                self._forget(spark, batch_id - self.every)

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame | None:
        """The table as of batch ``upto`` (the last one), None before the first batch."""
        inside = lambda n: upto is None or n <= upto
        tables = [n for n in self._written(spark, "tables") if inside(n) and n != upto]
        start = max(tables, default=-1)
        parts = [spark.read.parquet(f"{self.path}/tables/at={start}")] if tables else []
        parts += [spark.read.parquet(f"{self.path}/batches/at={n}").withColumn("batch_id", lit(n).cast("long"))
                  for n in sorted(self._written(spark, "batches")) if n > start and inside(n)]
        if not parts:
            return None
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return self.merge(rows)

    def _folder(self, spark: SparkSession, name: str):
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm

    def _written(self, spark: SparkSession, name: str) -> list[int]:
        """Numbers of the folders that were written to their end."""
        path, files, jvm = self._folder(spark, name)
        if not files.exists(path):
            return []
        found = [str(s.getPath().getName()) for s in files.listStatus(path)]
        return [int(n[3:]) for n in found if n.startswith("at=") and files.exists(jvm.org.apache.hadoop.fs.Path(path, f"{n}/_SUCCESS"))]

    def _forget(self, spark: SparkSession, upto: int) -> None:
        """Removes batches and tables that the table before the last one already replaced."""
        for name, last in (("batches", upto), ("tables", upto - 1)):
            path, files, jvm = self._folder(spark, name)
            for n in self._written(spark, name):
                if n <= last:
                    files.delete(jvm.org.apache.hadoop.fs.Path(path, f"at={n}"), True)


def budget(accepted: Merged, cap: int, keys=("run_id", "query"), asin: str = "asin", order: str = "seen_at",
           run_key: str = "run_id") -> Callable[[DataFrame, int], None]:
    """Accept at most ``cap`` new products per query and run, in order of arrival.

    A product accepted for one query is not accepted again for another; one
    refused because a budget was spent may still be accepted by a later
    sighting.  The accepted rows are the state, so a repeated batch counts only what earlier batches accepted.

    A batch is cut to the first sighting of each product and query on the map side.  The sightings of a run then
    pass by in order behind what the run has accepted; the task remembers only accepted products and counts, at most
    ``cap`` a query.  That order is what the budget means, so one run is one task's; runs are spread.
    """
    keys = list(keys)
    rest = [k for k in keys if k != run_key]

    def accept(batch: DataFrame, batch_id: int) -> None:
        columns = batch.columns
        first = batch.groupBy(*keys, asin).agg(F.min_by(F.struct(*columns), order).alias("row")).select("row.*")
        arrivals = first.withColumn("_new", lit(True))
        before = accepted.read(batch.sparkSession, batch_id - 1) if batch_id else None
        if before is not None:
            mine = before.join(batch.select(run_key).distinct(), run_key, "left_semi").select(*columns)
            arrivals = arrivals.unionByName(mine.withColumn("_new", lit(False)))
        passing = arrivals.repartition(run_key).sortWithinPartitions(run_key, "_new", order)
        accepted.write(passing.mapInArrow(_within(run_key, rest, asin, cap), batch.schema), batch_id)

    return accept


def _within(run_key: str, rest: list[str], asin: str, cap: int):
    """New rows that are accepted; rows come by run, those accepted before first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, products, used = object(), set(), {}
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (run_key, asin, "_new", *rest)]
            keep = []
            for of, product, new, *query in zip(*cols, strict=True):
                if of != now:
                    now, products, used = of, set(), {}
                query = tuple(query)
                fits = not new or (product not in products and used.get(query, 0) < cap)
                if fits:
                    products.add(product)
                    used[query] = used.get(query, 0) + 1
                keep.append(new and fits)
            names = [n for n in batch.schema.names if n != "_new"]
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return run
