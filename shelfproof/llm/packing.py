"""Packing documents into sequences of a fixed number of tokens by swap-based local search.

Only a document longer than a sequence is cut; its full pieces are sequences of their own.
All other pieces are dealt by hash into groups of about ``GROUP`` and packed there: a
best-fit start, then local search between underfull sequences.  It takes the emptiest
sequence and moves a piece to another that has room, or exchanges one of its
pieces for a smaller one, or for two that are smaller together, or two of its pieces for a
larger one's place.  Each step raises the sum of squared fills; it stops when the
sequences are as few as the tokens allow or no step is left.  A group wastes
less than one sequence where pieces are small, whatever its number.

NULL and empty texts are a document of the end id alone.  Rows that repeat are packed each on its own.
NULL ids are ids like others.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfproof.llm.common import give_back, stored
from shelfproof.llm.vocabulary import REMEMBERED, default_path, forget, vocabulary

LENGTH = 2048
GROUP = 16384
#: Effort of the search: so many emptiest sequences in a row without a step end it.
TRIES = 150


class Bins:
    """Pieces in sequences, and the steps of the search."""

    def __init__(self, lengths: np.ndarray, room: int) -> None:
        self.lengths, self.room = lengths.astype(np.int64), room
        self.bin = np.full(len(lengths), -1, dtype=np.int64)
        self.fill: list[int] = []
        self._best_fit()
        self.fill = np.asarray(self.fill, dtype=np.int64)
        self.least = -(-int(self.lengths.sum()) // room)

    def _best_fit(self) -> None:
        """Longest first, each to the fullest sequence with room; ``free`` has a bit for each gap that occurs."""
        by_gap: list[list[int]] = [[] for _ in range(self.room + 1)]
        free = 0
        for i in np.argsort(-self.lengths, kind="stable").tolist():
            n = int(self.lengths[i])
            if fits := free >> n:
                gap = n + (fits & -fits).bit_length() - 1
                b = by_gap[gap].pop()
                if not by_gap[gap]:
                    free &= ~(1 << gap)
            else:
                b, gap = len(self.fill), self.room
                self.fill.append(0)
            self.bin[i] = b
            self.fill[b] += n
            by_gap[gap - n].append(b)
            free |= 1 << (gap - n)

    def search(self) -> None:
        """Empties the emptiest sequences as long as a step is found for one of them."""
        used = int((self.fill > 0).sum())
        tried: set[int] = set()
        while used > self.least:
            open_ = np.flatnonzero((self.fill > 0) & (self.fill < self.room))
            donors = [b for b in open_[np.argsort(self.fill[open_], kind="stable")].tolist() if b not in tried]
            if not donors or len(tried) >= TRIES:
                return
            if self._step(donors[0]):
                tried.clear()
                used = int((self.fill > 0).sum())
            else:
                tried.add(donors[0])

    def _step(self, donor: int) -> bool:
        mine = np.flatnonzero(self.bin == donor)
        mine = mine[np.argsort(-self.lengths[mine], kind="stable")]
        gap = np.where((self.fill > 0) & (self.fill >= self.fill[donor]), self.room - self.fill, 0)
        gap[donor] = 0
        others = np.flatnonzero((gap[self.bin] > 0))
        own, room = self.lengths[others], gap[self.bin[others]]
        for i in mine.tolist():
            n = int(self.lengths[i])
            fit = np.flatnonzero(gap >= n)  # move
            if len(fit):
                self._put(i, int(fit[np.argmin(gap[fit])]))
                return True
            fit = np.flatnonzero((own < n) & (own + room >= n))  # one for one
            if len(fit):
                j = int(others[fit[np.argmin(own[fit])]])
                b = int(self.bin[j])
                self._put(j, donor)
                self._put(i, b)
                return True
        for i in mine.tolist():
            if pair := self._two_of_other(int(self.lengths[i]), others, own, room):  # one for two
                b = int(self.bin[pair[0]])
                for j in pair:
                    self._put(j, donor)
                self._put(i, b)
                return True
        for at, i in enumerate(mine[:-1].tolist()):  # two for one
            both = self.lengths[mine[at + 1:]] + self.lengths[i]
            for k, n in zip(mine[at + 1:].tolist(), both.tolist(), strict=True):
                fit = np.flatnonzero((own < n) & (own + room >= n))
                if len(fit):
                    j = int(others[fit[np.argmin(own[fit])]])
                    b = int(self.bin[j])
                    self._put(j, donor)
                    self._put(i, b)
                    self._put(k, b)
                    return True
        return False

    def _two_of_other(self, n: int, others: np.ndarray, own: np.ndarray, room: np.ndarray) -> tuple[int, int] | None:
        """Two pieces of one sequence, smaller together than ``n``, in whose place ``n`` fits."""
        small = np.flatnonzero(own < n)
        order = small[np.lexsort([own[small], self.bin[others[small]]])]
        b = self.bin[others[order]]
        for step in range(1, 9):  # partners among the next larger ones of the same sequence
            both = own[order[:-step]] + own[order[step:]]
            good = np.flatnonzero((b[:-step] == b[step:]) & (both < n) & (both + room[order[:-step]] >= n))
            if len(good):
                return int(others[order[good[0]]]), int(others[order[good[0] + step]])
        return None

    def _put(self, i: int, b: int) -> None:
        self.fill[self.bin[i]] -= self.lengths[i]
        self.bin[i] = b
        self.fill[b] += self.lengths[i]


def _group(room: int, names: list[str]):
    """Sequence and offset of each piece of a group."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins = Bins(lengths, room)
        bins.search()
        number = np.unique(bins.bin, return_inverse=True)[1]
        order = np.argsort(number, kind="stable")
        after = np.cumsum(lengths[order])
        first = np.flatnonzero(np.diff(number[order], prepend=-1))
        base = np.repeat((after - lengths[order])[first], np.diff(np.append(first, len(order))))
        offset = np.empty(len(order), dtype=np.int64)
        offset[order] = after - lengths[order] - base
        return (table.select(names).append_column("sequence_id", pa.array((key[0].as_py() << 32) + number.astype(np.int64)))
                .append_column("offset", pa.array(offset)))

    return run


def pack(pieces: DataFrame, room: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``room``) with ``sequence_id`` and ``offset``."""
    pieces = stored(pieces.drop("sequence_id", "offset", "_g", "_u"), "pieces", texts=True)
    rest = pieces.where(F.col("length") < room)
    full = pieces.where(F.col("length") >= room).withColumn(
        "sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    n = rest.count()
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    # Dealt by the number of the row in the written table, so that rows that repeat are dealt apart.
    rest = rest.withColumn("_g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, math.ceil(n / group)))))
    rest = rest.groupBy("_g").applyInArrow(_group(room, pieces.columns), schema)
    return full.unionByName(rest)


def _pieces(path: str, room: int, end_id: int, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path, remembered)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                texts = batch.column(1).slice(at, 1024).cast(pa.binary()).to_pylist()
                rows, piece, start, length, crc = [], [], [], [], []
                for r, data in enumerate(voc.encode(texts)):
                    ids = np.append(np.frombuffer(data, dtype=voc.dtype), end_id).astype("<u4")
                    for p, a in enumerate(range(0, len(ids), room)):
                        part = ids[a:a + room]
                        rows.append(at + r)
                        piece.append(p)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"])
        if remembered < REMEMBERED:  # where memory is short, other tasks of this worker get it back
            del voc
            forget()
            give_back()

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = LENGTH, end_id: int = 0,
           tokenizer: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of each whole text: place and length in ids, and the CRC-32 of the ids.

    ``remembered`` words are kept by a worker: fewer take less memory and more time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _pieces(tokenizer or default_path(), room, end_id, remembered),
        f"id {kind}, piece int, start long, length long, ids_crc32 long")
    return cut.withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = LENGTH,
                   end_id: int = 0, tokenizer: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    return pack(pieces(docs, id_col, text_col, room, end_id, tokenizer, remembered), room)
