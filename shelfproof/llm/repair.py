"""Token ids in files compressed with a Re-Pair grammar.

Documents are put in order of their ids, encoded, and cut into segments of about ``SEGMENT``
token ids, whole documents each.  In a segment the most frequent pairs of
neighbouring symbols are replaced by new symbols again and again, never across the end of
a document, until no pair is frequent enough, ``RULES`` rules are used or
``ROUNDS`` rounds are over (a grammar's size, not the data's: what has no rule stays as it is).

A segment is one binary value of a Parquet table that Spark writes, little-endian:
``magic, documents, rules, symbols, width`` (4 bytes each), then the rules (two symbols
each, 4 bytes), the number of token ids each rule stands for (4 bytes), each document's end among the symbols
(4 bytes), and the symbols (``width`` bytes).  With the expansion lengths any range of a document is
decoded from the symbols that cover it alone (``read_range``).

NULL and empty texts are the end id alone.  Rows that repeat an id follow each other, in the order of their
texts; NULL ids come first.  An empty table gives no segment and no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfproof.llm.common import stored
from shelfproof.llm.vocabulary import default_path, vocabulary

MAGIC = 0x31505052
SEGMENT = 1 << 20
RULES, ROUNDS = 12_000, 4
#: A pair gets a rule from so many occurrences on.
OFTEN = 16
#: Documents encoded together.
TOGETHER = 4096
_SLOTS = 18


def _slot(pair: np.ndarray) -> np.ndarray:
    if pair.dtype == np.uint32:
        return (pair * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOTS)
    return (pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)


def compress(ids: np.ndarray, ends: np.ndarray, base: int) -> bytes:
    """Bytes of a segment: token ids (below ``base``) of documents that end at ``ends``."""
    # Two symbols in one number: of 32 bits where all symbols fit 16, else of 64.
    half, pair_type = (16, np.uint32) if base + RULES <= 1 << 16 else (32, np.uint64)
    seq = ids.astype(np.uint16 if half == 16 else np.uint32)
    last = np.zeros(len(seq), dtype=bool)
    last[np.asarray(ends) - 1] = True
    rules: list[np.ndarray] = []
    known = 0
    size = np.zeros(RULES, dtype=np.uint32)
    for turn in range(ROUNDS):
        room = min(RULES - known, RULES // ROUNDS * 2 if turn else RULES // 2)
        if room <= 0 or len(seq) < 2:
            break
        key = seq[:-1].astype(pair_type) << pair_type(half) | seq[1:]
        inner = np.sort(key[~last[:-1]])
        if not len(inner):
            break
        first = np.concatenate([[0], np.flatnonzero(inner[1:] != inner[:-1]) + 1])
        count = np.diff(first, append=len(inner))
        often = np.flatnonzero(count >= OFTEN)
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")[:room]]
        pairs = inner[first[often]]  # the most frequent first
        # The rule of each place, by a table of pairs; where two pairs share a slot the more frequent one has it.
        table = np.full(1 << _SLOTS, -1, dtype=np.int32)
        table[_slot(pairs)[::-1]] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int32)
        rule = table[_slot(key)]
        at = np.flatnonzero((rule >= 0) & ~last[:-1])
        at = at[pairs[rule[at]] == key[at]]
        # Of places that follow each other every second one is taken, from the first.
        fresh = np.diff(at, prepend=-2) > 1
        at = at[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]
        there = np.zeros(len(pairs), dtype=bool)
        there[rule[at]] = True
        used = np.flatnonzero(there)
        number = (np.cumsum(there) - 1)[rule[at]]
        low = pair_type((1 << half) - 1)
        pair = np.stack([pairs[used] >> pair_type(half), pairs[used] & low], axis=1).astype(np.uint32)
        below = np.where(pair >= base, size[np.where(pair >= base, pair - base, 0)], 1)
        size[known:known + len(used)] = below.sum(1)
        seq[at] = base + known + number
        last[at] = last[at + 1]
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(pair)
        known += len(used)
    width = 2 if base + known <= 1 << 16 else 4
    table = np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)
    head = np.array([MAGIC, len(ends), known, len(seq), width], dtype="<u4")
    return b"".join([head.tobytes(), table.astype("<u4").tobytes(), size[:known].astype("<u4").tobytes(),
                     (np.flatnonzero(last) + 1).astype("<u4").tobytes(), seq.astype(f"<u{width}").tobytes()])


class Segment:
    """A segment read back."""

    def __init__(self, data: bytes, base: int) -> None:
        magic, docs, rules, symbols, width = np.frombuffer(data, dtype="<u4", count=5).tolist()
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at = 20
        self.base = base
        self.rules = np.frombuffer(data, dtype="<u4", count=2 * rules, offset=at).reshape(-1, 2)
        self.lengths = np.frombuffer(data, dtype="<u4", count=rules, offset=at + 8 * rules)
        self.ends = np.frombuffer(data, dtype="<u4", count=docs, offset=at + 12 * rules)
        self.symbols = np.frombuffer(data, dtype=f"<u{width}", count=symbols, offset=at + 12 * rules + 4 * docs)
        self.flat = self.offset = None

    def _expansions(self) -> None:
        """All rules written out one after the other; a rule names only symbols before it."""
        ends = np.cumsum(self.lengths, dtype=np.int64)
        self.offset = ends - self.lengths
        self.flat = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
        offset, length, base = self.offset.tolist(), self.lengths.tolist(), self.base
        for (a, b), at in zip(self.rules.tolist(), offset, strict=True):
            for s in (a, b):
                if s < base:
                    self.flat[at] = s
                    at += 1
                else:
                    n = length[s - base]
                    self.flat[at:at + n] = self.flat[offset[s - base]:offset[s - base] + n]
                    at += n

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), dtype=np.int64)
        new = symbols >= self.base
        out[new] = self.lengths[symbols[new].astype(np.int64) - self.base]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if self.flat is None:
            self._expansions()
        size = self.sizes(symbols)
        ends = np.cumsum(size)
        out = np.repeat(symbols.astype(np.uint32), size)
        new = np.flatnonzero(symbols >= self.base)
        n, rule = size[new], symbols[new].astype(np.int64) - self.base
        # Places of the output that rules fill, and the places of their expansions.
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(ends[new] - n, n) + step] = self.flat[np.repeat(self.offset[rule], n) + step]
        return out

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """All token ids, and where each document ends among them."""
        total = np.cumsum(self.sizes(self.symbols))
        return self.expand(self.symbols), total[self.ends.astype(np.int64) - 1]

    def read_range(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Token ids ``start`` to ``stop`` of a document, from the symbols that cover them."""
        symbols = self.symbols[int(self.ends[doc - 1]) if doc else 0:int(self.ends[doc])]
        total = np.cumsum(self.sizes(symbols))
        a, b = np.searchsorted(total, start, side="right"), np.searchsorted(total, stop, side="left")
        skipped = int(total[a - 1]) if a else 0
        return self.expand(symbols[a:b + 1])[start - skipped:stop - skipped]


def _encode(path: str, end_id: int, segment: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, part, before = vocabulary(path), TaskContext.get().partitionId(), 0
        base = len(voc.ends)
        end = np.array([end_id], dtype=voc.dtype).tobytes()
        names, held, size = [], [], 0

        def done() -> pa.RecordBatch:
            nonlocal names, held, size, before
            ids = np.frombuffer(b"".join(held), dtype=voc.dtype)
            ends = np.cumsum([len(h) // voc.dtype.itemsize for h in held])
            out = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([names], pa.list_(id_type)), pa.array([compress(ids, ends, base)], pa.binary())],
                names=["part", "before", "n_ids", "ids", "data"])
            before += len(ids)
            names, held, size = [], [], 0
            return out

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), TOGETHER):
                ids = batch.column(0).slice(at, TOGETHER).to_pylist()
                for name, data in zip(ids, voc.encode(texts[at:at + TOGETHER]), strict=True):
                    names.append(name)
                    held.append(data + end)
                    size += len(data) // voc.dtype.itemsize + 1
                    if size >= segment:
                        yield done()
        if held:
            yield done()

    return run


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
          tokenizer: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """Segments, written to the shared folder: ``part``, ``before`` (ids before it in its part), ``n_ids``, ``ids``, ``data``."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
               .repartitionByRange(parts, "id").sortWithinPartitions("id", "text"))
    encoded = ordered.mapInArrow(_encode(tokenizer or default_path(), end_id, segment, to_arrow_type(kind)),
                                 f"part int, before long, n_ids long, ids array<{kind.simpleString()}>, data binary")
    return stored(encoded, "segments")


def _decode(base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (part, before) in enumerate(zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(),
                                                   strict=True)):
                ids, ends = Segment(batch.column("data")[i].as_py(), base).documents()
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([
                    batch.column("ids")[i].values, pa.array([part] * n, pa.int32()), pa.array(before + starts),
                    pa.array(ends - starts), pa.array(crc, pa.int64())],
                    names=["id", "part", "at", "n_tokens", "ids_crc32"])

    return run


def read(segments: DataFrame, id_col: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """``id_col``, ``start``, ``n_tokens``, ``ids_crc32`` of each document, decoded from its segment."""
    kind = segments.schema["ids"].dataType.elementType.simpleString()
    base = len(vocabulary(tokenizer or default_path()).ends)
    sizes = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a partition of the writing job
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    docs = segments.select("part", "before", "ids", "data").mapInArrow(
        _decode(base), f"id {kind}, part int, at long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(sizes), F.col("part") == F.col("_p")).select(
        F.col("id").alias(id_col), (F.col("at") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32")
