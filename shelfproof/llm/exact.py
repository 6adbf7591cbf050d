"""Exact duplicates with a heavy-hitter split.

1. Each row becomes an id, a row key and the SHA-256 of its normalised text, written
   once; texts go no further.
2. A Misra-Gries summary of ``COUNTERS`` digests per partition, added up by digest,
   finds every digest that more than 1 row in ``SHARE`` has.  A summary counts a digest
   too low by at most a ``COUNTERS``-th of the rows, so a digest that frequent keeps
   more than half its bound, and as all counts together are at most the number of rows,
   fewer than ``2 * SHARE`` digests can do so: that bounds what is broadcast.
3. The candidates' exact counts and winners come from one aggregate that is combined on
   the map side, and are broadcast: rows of frequent digests never move.
4. All other digests, each at most a ``SHARE``-th of the rows, are shuffled as usual.

Two texts are equal when they are the same bytes after A-Z are lower-cased; NULL is the
empty text, so NULL and empty texts are one group.  The row with the largest id stays, a NULL id only if its
group has no other; of rows that repeat with the same id one stays.  Texts of
any length are one digest.  Other columns of the input, whatever their names, are not looked at.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfproof.llm.common import ASCII_LOWER, ASCII_UPPER, stored

#: A digest is frequent if more than one row in so many has it.
SHARE = 1024
COUNTERS = 2 * SHARE


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), ASCII_UPPER, ASCII_LOWER)


def merged(held: dict[bytes, int], new: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """Misra-Gries counters of two summaries together: the largest ``counters``, less the next largest."""
    for key, n in new.items():
        held[key] = held.get(key, 0) + n
    if len(held) <= counters:
        return held
    counts = np.fromiter(held.values(), dtype=np.int64, count=len(held))
    cut = int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])
    return {key: n - cut for key, n in held.items() if n > cut}


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            seen = pc.value_counts(batch.column("digest"))
            new = dict(zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist(), strict=True))
            held = merged(held, new, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                         names=["digest", "n"])

    return run


def frequent(digests: DataFrame, share: int = SHARE) -> DataFrame:
    """Fewer than ``2 * share`` digests, among them all that more than one row in ``share`` has."""
    sums = digests.select("digest").mapInArrow(_summaries(2 * share), "digest binary, n long").groupBy("digest").agg(
        F.sum("n").alias("n"))
    return sums.where(F.col("n") > digests.count() / (2 * share)).select("digest")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    digest = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    rows = stored(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
                              digest.alias("digest")), "digests")
    best, size = F.max(F.struct("id", "row")), F.count("*")
    hot = F.broadcast(stored(frequent(rows, share), "frequent"))
    winners = rows.join(hot, "digest", "left_semi").groupBy("digest").agg(best.alias("best"), size.alias("size"))
    heavy = rows.join(F.broadcast(stored(winners, "winners")), "digest")
    same = Window.partitionBy("digest")
    light = rows.join(hot, "digest", "left_anti").withColumn("best", best.over(same)).withColumn("size", size.over(same))
    return heavy.select("id", "row", "digest", "best", "size").union(
        light.select("id", "row", "digest", "best", "size")).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("best.row") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
