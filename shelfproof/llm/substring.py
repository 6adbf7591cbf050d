"""Removal of passages that repeat, by hashing normalised units.

A text is cut after line breaks and sentence ends (``.``, ``!``, ``?``) into units whose concatenation is the
text.  A unit's digest is taken of its words, A-Z in lower case, one blank between.  Digests
are grouped over all documents, and the occurrence that comes first by (document id, row, place)
is kept.  Other occurrences are repeats; a run of them, units without words included, goes
if it has ``min_words`` words or more in all, so short sentences that recur by chance stay
where they stand alone.  Spans that go are reported in code points of the original text.

Only digests that occur more than once are joined back, and a frequent one is counted on the map side
first.  A unit that very many rows share is one key of the join that finds its repeats, which adaptive execution may
split; it is not split before.

NULL text stays NULL and has no units.  NULL ids come last in rank.  Each row is a document
of its own: rows are numbered in a written table, and those with the same id or without one rank by their
number.  An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfproof.llm.common import lean, stored

UNIT = re.compile(r"[^.!?\n]*[.!?\n]+[ \t]*|[^.!?\n]+")
MIN_WORDS = 10


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document, row, place, span in code points, words and 128-bit digest of each unit."""
    from xxhash import xxh3_128_digest

    for batch in batches:
        rows, place, start, end, words, digests = [], [], [], [], [], []
        for r, text in enumerate(batch.column("text").to_pylist()):
            at = 0
            for i, unit in enumerate(UNIT.findall(text or "")):
                w = unit.encode().lower().split()
                rows.append(r)
                place.append(i)
                start.append(at)
                at += len(unit)
                end.append(at)
                words.append(len(w))
                digests.append(xxh3_128_digest(b" ".join(w)))
            if len(rows) > 40_000:
                yield _batch(batch, rows, place, start, end, words, digests)
                rows, place, start, end, words, digests = [], [], [], [], [], []
        yield _batch(batch, rows, place, start, end, words, digests)


def _batch(batch, rows, place, start, end, words, digests) -> pa.RecordBatch:
    d = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays([
        batch.column("id").take(pa.array(rows, pa.int64())), batch.column("row").take(pa.array(rows, pa.int64())),
        pa.array(place, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(words, pa.int32()),
        pa.array(d[:, 0]), pa.array(d[:, 1])], names=["id", "row", "place", "start", "end", "words", "h1", "h2"])


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Units of ``docs``, whose rows are numbered in ``_unit_row``."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col("_unit_row").alias("row"),
                       F.col(text_col).cast("string").alias("text")).mapInArrow(
        lean(_units), f"id {kind}, row long, place int, start int, end int, words int, h1 long, h2 long")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Units that are not the first of their digest; those without words count as repeats of none."""
    seen = units(docs, id_col, text_col).where(F.col("words") > 0)
    rank = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("row").alias("row"),
                    F.col("place").alias("place"))
    firsts = seen.groupBy("h1", "h2").agg(F.count("place").alias("_n"), F.min(rank).alias("_first"))
    firsts = firsts.where(F.col("_n") > 1).select(
        "h1", "h2", F.col("_first.row").alias("_row"), F.col("_first.place").alias("_place"))
    return (seen.select("row", "place", "h1", "h2").join(firsts, ["h1", "h2"])
            .where((F.col("row") != F.col("_row")) | (F.col("place") != F.col("_place"))).select("row", "place"))


def _cut(min_words: int):
    """Text without its long runs of repeated units, with what was removed."""

    def one(text: str | None, places: set[int]) -> tuple[str | None, int, int, int, str]:
        if text is None:
            return None, 0, 0, 0, ""
        found = UNIT.findall(text)
        if not places:
            return text, len(found), 0, 0, ""
        kept, spans, run, count, total, removed, at = [], [], [], 0, 0, 0, 0

        def close() -> None:
            nonlocal run, count, total, removed
            if count >= min_words:
                spans.append(f"{run[0][0]}-{run[-1][0] + len(run[-1][1])}")
                total += count
                removed += len(run)
            else:
                kept.extend(u for _, u in run)
            run, count = [], 0

        for i, unit in enumerate(found):
            n = len(unit.encode().split())
            if i in places or (run and not n):
                run.append((at, unit))
                count += n
            else:
                if run:
                    close()
                kept.append(unit)
            at += len(unit)
        if run:
            close()
        return "".join(kept), len(found), removed, total, ",".join(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [one(t, set(p or ())) for t, p in zip(b.column("_unit_text").to_pylist(), b.column("_unit_places").to_pylist(),
                                                        strict=True)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            keep = [n for n in b.schema.names if n not in ("_unit_text", "_unit_places")]
            yield pa.RecordBatch.from_arrays(
                [b.column(n) for n in keep] + [pa.array(list(c), t) for c, t in zip(cols, types, strict=True)],
                names=[*keep, *NEW])

    return run


NEW = ["kept_text", "n_units", "n_removed", "removed_words", "removed"]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``kept_text`` and what was removed: units, words, and spans ``start-end`` of the original."""
    docs = docs.drop(*NEW)
    rows = stored(docs.withColumn("_unit_row", F.monotonically_increasing_id()), "rows")
    # Written by themselves, so that shuffled units are gone before texts are shuffled.
    places = stored(repeats(rows, id_col, text_col).groupBy(F.col("row").alias("_unit_of")).agg(
        F.collect_set("place").alias("_unit_places")), "places")
    full = rows.withColumn("_unit_text", F.col(text_col).cast("string")).join(
        places, F.col("_unit_row") == F.col("_unit_of"), "left").drop("_unit_row", "_unit_of")
    schema = T.StructType([*docs.schema.fields, T.StructField("kept_text", T.StringType()),
                           T.StructField("n_units", T.IntegerType()), T.StructField("n_removed", T.IntegerType()),
                           T.StructField("removed_words", T.LongType()), T.StructField("removed", T.StringType())])
    return full.mapInArrow(lean(_cut(min_words)), schema)
