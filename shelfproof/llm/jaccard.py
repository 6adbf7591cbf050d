"""Links between texts whose sets of word shingles have a Jaccard similarity or more, exactly.

Two sets at similarity ``s`` or more share a shingle among the first ``n - ceil(s n) + 1`` of
each in any order that is fixed for all, so texts meet on each of these and none is
missed, wherever their differences lie.  The order puts shingles that are frequent in a
bounded sample last: the sample decides how many texts meet, not which are linked.  A pair that meets
at places p and q shares at most the smaller of n - p and m - q shingles if these are its first; pairs for which
that is too few are left out.

Before texts are fetched, a pair must pass a bound on how much it can share: each set has its shingles counted by
bucket of the hash (``counts_of``), and two sets share at most the smaller count of every bucket.  That is a fraction of
a text's size and leaves few pairs that are not links.

Links are verified on the whole sets of both texts, in passes: first the pairs that an index of fingerprints
proposes (``simhash``) and each text against one text of those it meets, where their shingle comes first, so that a
large group becomes one component without its pairs; then every pair that meets and is not yet in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfproof.llm.common import lean, stored
from shelfproof.llm.graph import components

WIDTH, SEED = 5, 42
#: Words of a fingerprint's shingles.
PRINT_WIDTH = 3
#: Texts of the sample, in how many of them a shingle is frequent, frequent shingles kept: only the work depends on them.
SAMPLE, FREQUENT, REMEMBERED = 4000, 3, 200_000
#: Passes against one text before all pairs.
STARS = 1
#: Pairs looked at together, sets a worker keeps.
TOGETHER, SETS = 1 << 18, 256


def shingle_set(text: bytes | None) -> np.ndarray:
    """XXH64 of the shingles of a text, in order and once each."""
    from shelfproof.llm.simhash import shingle_hashes

    return np.unique(shingle_hashes(text or b"", WIDTH, SEED))


def counts_of(shingles: np.ndarray) -> bytes:
    """How many shingles of a set fall into each bucket, four a bucket on average; empty where a count needs more than a byte."""
    buckets = 1 << max(len(shingles) // 4, 1).bit_length()
    counts = np.bincount((shingles & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def shared_at_most(a: bytes, b: bytes) -> tuple[int, int]:
    """Most shingles that two sets with these counts share, and the sizes of both together; (0, 0) where that is open."""
    if not a or not b:
        return 0, 0
    x, y = (np.frombuffer(c, dtype=np.uint8).astype(np.int64) for c in (a, b))
    if len(x) > len(y):
        x, y = y, x
    # The buckets are the low bits of the hash, so the finer counts add up to the coarser ones.
    return int(np.minimum(x, y.reshape(-1, len(x)).sum(axis=0)).sum()), int(x.sum() + y.sum())


def _promising(share: Fraction):
    """Pairs that can reach the similarity by their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("ca").to_pylist(), batch.column("cb").to_pylist(), strict=True):
                both, sizes = shared_at_most(a, b)
                good.append(both * (share.numerator + share.denominator) >= sizes * share.numerator)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            sets = [shingle_set(t) for t in batch.column("text").slice(at, 256).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])


def frequent(docs: DataFrame, mark: Column, text: Column) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample, in order, and their counts."""
    every = max(1, -(-docs.count() // SAMPLE))
    sample = docs.where(F.pmod(mark, F.lit(every)) == 0).select(text.alias("text"))
    count = sample.mapInArrow(lean(_shingles), "h long").groupBy("h").agg(F.count("*").alias("n"))
    rows = count.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(REMEMBERED).collect()
    h = np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64)
    n = np.array([r["n"] for r in rows], dtype=np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _prefixes(hot: np.ndarray, times: np.ndarray, share: Fraction):
    """Fingerprint of each text, hash and size of its set, and its first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        from shelfproof.llm.simhash import majority, shingle_hashes

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fp, v, n, counts, first = [], [], [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    fp.append(majority(shingle_hashes(text or b"", PRINT_WIDTH, SEED)))
                    s = shingle_set(text)
                    v.append(xxh64_intdigest(s.tobytes()))
                    n.append(len(s))
                    counts.append(counts_of(s))
                    if len(hot) and len(s):
                        i = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                        s = s[np.argsort(np.where(hot[i] == s, times[i], 0), kind="stable")]
                    first.append(s[:len(s) + (len(s) * -share.numerator // share.denominator) + 1] if len(s) else s)
                ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("mark"), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(v, dtype=np.uint64).view(np.int64)),
                    pa.array(n, pa.int32()), pa.array(counts, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first).view(np.int64)))],
                    names=["id", "mark", "fp", "v", "n", "counts", "first"])

    return run


def prefixes(docs: DataFrame, id_col: str, mark: Column, text: Column, similarity: float) -> DataFrame:
    """``id``, ``mark``, ``fp`` (SimHash), ``v`` (hash of the set), ``n`` (its size), its ``counts`` and ``first`` shingles of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    hot, times = frequent(docs, mark, text)
    return docs.select(F.col(id_col).alias("id"), mark.alias("mark"), text.alias("text")).mapInArrow(
        lean(_prefixes(hot, times, _share(similarity))), f"id {kind}, mark long, fp long, v long, n int, counts binary, first array<long>")


def _share(similarity: float) -> Fraction:
    return Fraction(similarity).limit_denominator(10_000)


def meeting(sets: DataFrame) -> DataFrame:
    """Rows ``h``, ``v``, ``n``, ``p`` of first shingles that more than one of the distinct sets has."""
    rows = sets.select("v", "n", F.posexplode("first").alias("p", "h"))
    return (rows.withColumn("_c", F.count("*").over(Window.partitionBy("h"))).where(F.col("_c") > 1)
            .select("h", "v", "n", "p"))


def _possible(share: Fraction, n, p, m, q):
    """Whether sets of ``n`` and ``m`` whose first common shingle is at ``p`` and ``q`` can reach the similarity."""
    a, b = share.numerator, share.denominator
    least = F.least(n - p, m - q) if isinstance(n, Column) else np.minimum(n - p, m - q)
    return least * (a + b) >= (n + m) * a


def _stars(rows: DataFrame, share: Fraction, seed: int) -> DataFrame:
    """Each row against one of its shingle's, in another component: a set where the shingle comes first.

    That set has the fewest rare shingles, so of a large group it is one that the others were edited from, or is near it.
    """
    one = F.min(F.struct("p", F.xxhash64(F.lit(seed), "v").alias("k"), "v", "n", "root")).over(Window.partitionBy("h"))
    c = F.col("_one")
    long = lambda x: x.cast("long")
    return rows.withColumn("_one", one).where(
        (F.col("root") != c["root"]) & _possible(share, long(F.col("n")), long(F.col("p")), long(c["n"]), long(c["p"]))
    ).select(F.least("v", c["v"]).alias("a"), F.greatest("v", c["v"]).alias("b"))


def _across(share: Fraction):
    """All pairs of a shingle's rows that are in two components; rows come sorted by shingle and component."""

    def pairs(v, n, p, root) -> Iterator[pa.RecordBatch]:
        block = np.searchsorted(root, root, side="right")  # the rows from here on are in later components
        todo = len(v) - block
        ends = np.cumsum(todo)
        lo = 0
        while lo < len(v):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOGETHER, side="right")))
            i = np.repeat(np.arange(lo, hi), todo[lo:hi])
            start = ends[lo:hi] - todo[lo:hi] - (ends[lo - 1] if lo else 0)
            j = np.arange(len(i)) - np.repeat(start, todo[lo:hi]) + block[i]
            good = _possible(share, n[i], p[i], n[j], p[j])
            i, j = v[i[good]], v[j[good]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held, axis=1)
            for part in np.split(rows, np.flatnonzero(np.diff(rows[0])) + 1, axis=1):
                if part[4][0] != part[4][-1]:
                    yield from pairs(*part[1:])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("h", "v", "n", "p", "root")])
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last shingle may go on in the next batch
            if cut or (held and held[0][0][-1] != rows[0][0]):
                held.append(rows[:, :cut])
                yield from done()
                held = []
            held.append(rows[:, cut:])
        if held:
            yield from done()

    return run


def _verified(share: Fraction):
    """Pairs of texts that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def of(v: int, text: bytes | None) -> np.ndarray:
            if v not in sets:
                if len(sets) >= SETS:
                    sets.clear()
                sets[v] = shingle_set(text)
            return sets[v]

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                ta, tb = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("ta", "tb"))
                good = []
                for v, w, t, u in zip(a, b, ta, tb, strict=True):
                    x, y = of(v, t), of(w, u)
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    good.append(both * (share.numerator + share.denominator) >= (len(x) + len(y)) * share.numerator)
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def links(rows: DataFrame, sets: DataFrame, texts: DataFrame, similarity: float, proposed: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect what pairs at the similarity or more connect.

    ``rows`` as ``meeting`` gives them, ``sets`` (``v``, ``counts``) and ``texts`` (``v``, ``text``), once each, all written.
    ``proposed`` are pairs (``a`` < ``b``) to look at first; those that don't reach the similarity are no links.
    """
    share, found = _share(similarity), None
    for turn in range(STARS + 1):
        if found is None:
            now = rows.withColumn("root", F.col("v"))
        else:
            roots = components(found)
            now = rows.join(roots, F.col("v") == F.col("node"), "left").drop("node")
            now = now.withColumn("root", F.coalesce("root", "v"))
        if turn < STARS:
            pairs = _stars(now, share, turn)
            pairs = pairs.unionByName(proposed) if turn == 0 else pairs
        else:
            pairs = now.repartition("h").sortWithinPartitions("h", "root").mapInArrow(lean(_across(share)), "a long, b long")
        counted = pairs.distinct().join(sets.select(F.col("v").alias("a"), F.col("counts").alias("ca")), "a").join(
            sets.select(F.col("v").alias("b"), F.col("counts").alias("cb")), "b")
        pairs = stored(counted.select("a", "b", "ca", "cb").mapInArrow(lean(_promising(share)), "a long, b long"), "pairs")
        sides = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("ta")), "a").join(
            texts.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b")
        new = stored(sides.select("a", "b", "ta", "tb").mapInArrow(lean(_verified(share)), "a long, b long"), "links", texts=True)
        found = new if found is None else found.unionByName(new)
    return found
