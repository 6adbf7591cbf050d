"""Token counts without token ids: pieces of each distinct pre-token, times its frequency in each document.

A task turns a block of documents into postings: for each distinct pre-token the places
of the documents that hold it and how often.  Postings are packed by a hash of the pre-token and meet by it;
there each distinct pre-token is split into pieces once, its count is joined to all its postings, and the
products go back to their block, where they are summed per document.  A word that is in
every document has one posting list per block, not a row per document, and a bucket of the hash holds as many
lists of frequent words as any other.  Pre-tokens are the runs between blanks, whose pieces
do not depend on their neighbours (``Vocabulary.by_word``); with a tokenizer for which they do, whole texts are
encoded where they are.

NULL and empty texts count 0 bytes and 0 tokens.  Each row of the input gives a
row, so repeated rows repeat; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfproof.llm.vocabulary import default_path, vocabulary

#: Documents of a block; places in a block are kept in 16 bits.
BLOCK = 8192
#: Blocks whose sums a task holds before it hands them on.
HELD = 256


def _postings(texts: list[bytes | None], buckets: int) -> Iterator[tuple[int, bytes]]:
    """Bucket and packed lists: words, their list lengths, places, frequencies."""
    number: dict[bytes, int] = {}
    words, places, times = [], [], []
    for slot, text in enumerate(texts):
        for word, n in Counter((text or b"").split()).items():
            w = number.setdefault(word, len(number))
            while n > 0:  # a frequency beyond 16 bits takes more than one posting
                words.append(w)
                places.append(slot)
                times.append(min(n, 65535))
                n -= 65535
    if not number:
        return
    names = list(number)
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in names), dtype=np.int64, count=len(names))
    w = np.asarray(words, dtype=np.int64)
    rank = np.empty(len(names), dtype=np.int64)
    order = np.argsort(bucket, kind="stable")
    rank[order] = np.arange(len(names))
    by = np.argsort(rank[w], kind="stable")
    lengths = np.bincount(rank[w], minlength=len(names)).astype("<u4")
    places, times = (np.asarray(x, dtype="<u2")[by] for x in (places, times))
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.unique(bucket).tolist():
        lo, hi = int(at[b]), int(at[b + 1])
        blob = b" ".join([names[i] for i in order[lo:hi].tolist()])
        span = slice(int(ends[lo]), int(ends[hi]))
        head = np.array([hi - lo, span.stop - span.start], dtype="<u4").tobytes()
        yield b, head + lengths[lo:hi].tobytes() + places[span].tobytes() + times[span].tobytes() + blob


def _unpacked(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(data, dtype="<u4", count=2).tolist()
    lengths = np.frombuffer(data, dtype="<u4", count=n, offset=8)
    places = np.frombuffer(data, dtype="<u2", count=m, offset=8 + 4 * n)
    times = np.frombuffer(data, dtype="<u2", count=m, offset=8 + 4 * n + 2 * m)
    return data[8 + 4 * n + 4 * m:].split(b" "), lengths, places, times


def _blocks(id_type: pa.DataType, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 20
        names = ["bucket", "block", "data", "ids", "bytes"]
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                ends = pa.array([0, len(texts)], pa.int32())
                sizes = pa.array([len(t or b"") for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array([-1 - block % 97], pa.int32()), pa.array([block], pa.int64()), pa.nulls(1, pa.binary()),
                    pa.ListArray.from_arrays(ends, batch.column(0)), pa.ListArray.from_arrays(ends, sizes)], names=names)
                for bucket, data in _postings(texts, buckets):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary()),
                        pa.nulls(1, pa.list_(id_type)), pa.nulls(1, pa.list_(pa.int64()))], names=names)
                block += 1

    return run


def _priced(path: str, id_type: pa.DataType):
    """Products of pieces and frequency, added up by document within a block; rows come sorted by bucket."""

    def out(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        data = []
        for s in sums.values():
            there = np.flatnonzero(s)
            data.append(np.array([len(there)], dtype="<u4").tobytes() + there.astype("<u2").tobytes()
                        + s[there].astype("<i8").tobytes())
        n = len(data)
        return pa.RecordBatch.from_arrays([
            pa.array(list(sums), pa.int64()), pa.array(data, pa.binary()), pa.nulls(n, pa.list_(id_type)),
            pa.nulls(n, pa.list_(pa.int64()))], names=["block", "data", "ids", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, count, now, sums = vocabulary(path), {}, None, {}
        for batch in batches:
            heads = batch.filter(batch.column("data").is_null())
            if heads.num_rows:
                yield heads.select(["block", "data", "ids", "bytes"])
            rows = batch.filter(batch.column("data").is_valid())
            for bucket, block, data in zip(rows.column("bucket").to_pylist(), rows.column("block").to_pylist(),
                                           rows.column("data").to_pylist(), strict=True):
                if bucket != now:
                    count, now = {}, bucket
                tokens, lengths, places, times = _unpacked(data)
                new = [t for t in tokens if t not in count]
                count.update(zip(new, voc.counts(new).tolist(), strict=True))
                pieces = np.fromiter(map(count.__getitem__, tokens), dtype=np.float64, count=len(tokens))
                if block not in sums:
                    if len(sums) >= HELD:
                        yield out(sums)
                        sums = {}
                    sums[block] = np.zeros(BLOCK, dtype=np.int64)
                sums[block] += np.bincount(places, np.repeat(pieces, lengths) * times, BLOCK).astype(np.int64)
        if sums:
            yield out(sums)

    return run


def _summed(id_type: pa.DataType):
    """Rows of documents, block by block; rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sizes, total = None, None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, sizes, pa.array(total[:len(ids)])], names=["id", "n_bytes", "n_tokens"])

        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                if block != now:
                    if now is not None:
                        yield done()
                    now, ids, sizes, total = block, None, None, np.zeros(BLOCK, dtype=np.int64)
                data = batch.column("data")[i].as_py()
                if data is None:
                    ids, sizes = batch.column("ids")[i].values, batch.column("bytes")[i].values
                else:
                    n = int(np.frombuffer(data, dtype="<u4", count=1)[0])
                    total[np.frombuffer(data, dtype="<u2", count=n, offset=4)] += np.frombuffer(
                        data, dtype="<i8", count=n, offset=4 + 2 * n)
        if now is not None:
            yield done()

    return run


def _whole(path: str):
    """Counts of texts whose pieces depend on the blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                                                  pa.array(voc.counts(texts))], names=["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str | None = None) -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens`` of each row's whole text."""
    kind = docs.schema[id_col].dataType
    arrow, name = _arrow_type(kind), kind.simpleString()
    path = tokenizer or default_path()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if not vocabulary(path).by_word:
        return own.mapInArrow(_whole(path), f"id {name}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
    buckets = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = f"block long, data binary, ids array<{name}>, bytes array<long>"
    postings = own.mapInArrow(_blocks(arrow, buckets), f"bucket int, {held}")
    priced = postings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _priced(path, arrow), held)
    counted = priced.repartition("block").sortWithinPartitions("block").mapInArrow(
        _summed(arrow), f"id {name}, n_bytes long, n_tokens long")
    return counted.withColumnRenamed("id", id_col)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
