"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes of a text's word
shingles.  Distinct fingerprints are dealt into chunks so that any two within the radius
meet in one: with ``radius`` differing bits one of ``radius + 1`` equal blocks agrees, so each
fingerprint goes once for each block to the chunk of that block's leading bits (as many as give chunks of
about ``CHUNK`` rows).  Chunks that are still too large use the whole block, then
blocks of the bits that remain, on the same ground.

In a chunk fingerprints are sorted by their rank in Gray order, runs of ``NODE`` become nodes
that hold the bit pattern all of them share, runs of nodes become upper nodes.  Two nodes
whose shared patterns differ in more than ``radius`` bits are left out with all below
them.  What remains is compared bit by bit, and only a forest of links per chunk is passed
on, so copies are never expanded into pairs.  Components of the forest are the groups.

``without_near_duplicates`` proposes by this index; the pairs it links are checked on the sets of shingles
themselves, and pairs beyond the radius are found there, too, see ``jaccard``.

NULL and empty texts have fingerprint 0, linked like any other.  Repeated rows and equal texts
share a fingerprint.  NULL ids take part; a group's id is the smallest that is not NULL.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfproof.llm import jaccard
from shelfproof.llm.common import apart, lean, stored
from shelfproof.llm.graph import components

CHUNK, LIMIT = 2048, 16384
NODE = 32
#: Pairs of nodes looked at together.
FRONT = 2048


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words, repeats included; a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        shingles = [b" ".join(words)]
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        n = len(words) - width + 1
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Further hashes of the same shingles: the hash, a multiple of the lane added, through a 64-bit finaliser."""
    if not lane:
        return hashes
    h = hashes + np.uint64((lane * 0x9E3779B97F4A7C15) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: Column, width: int = 3, seed: int = 42, lanes: int = 1) -> Column:
    """The fingerprint of each text as an array of ``lanes`` longs."""

    @F.pandas_udf("array<bigint>")
    @lean
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = []
            for t in texts:
                h = shingle_hashes((t or "").encode(), width, seed)
                prints = [majority(mixed(h, lane)) for lane in range(lanes)]
                out.append(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pd.Series(out)

    return of(text.cast("string"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit word in the reflected Gray order."""
    rank = codes.copy()
    for by in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(by)
    return rank


class GrayIndex:
    """Links within a radius among fingerprints of one or more 64-bit words."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.radius = radius
        self.order = np.lexsort([gray_rank(prints[:, i]) for i in range(prints.shape[1])][::-1])
        self.x = prints[self.order]
        self.levels = []
        every, some = self.x, self.x  # bits set in all, bits set in any
        while True:
            self.levels.append((every, ~(every ^ some)))
            if len(every) <= NODE:
                break
            at = np.arange(0, len(every), NODE)
            every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
        self.root = np.arange(len(prints))

    def _apart(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits that differ in the patterns both nodes have."""
        pattern, mask = self.levels[level]
        both = (pattern[i] ^ pattern[j]) & mask[i] & mask[j]
        return np.bitwise_count(both).sum(-1, dtype=np.int64)

    def _children(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, step = len(self.levels[level - 1][0]), np.arange(NODE)
        a, b = np.broadcast_arrays((i[:, None] * NODE + step)[:, :, None], (j[:, None] * NODE + step)[:, None, :])
        a, b = a.ravel(), b.ravel()
        keep = (a < n) & (b < n) & ((a < b) if level == 1 else (a <= b))
        return a[keep], b[keep]

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.root[i], self.root[j]
        new = a != b
        if not new.any():
            return
        pairs = np.unique(np.stack([np.minimum(a[new], b[new]), np.maximum(a[new], b[new])], axis=1), axis=0)
        parent: dict[int, int] = {}

        def find(v: int) -> int:
            while v in parent:
                parent[v] = w = parent.get(parent[v], parent[v])
                v = w
            return v

        for u, v in pairs.tolist():
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        to = np.arange(len(self.root))
        for v in parent:
            to[v] = find(v)
        self.root = to[self.root]

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Members and the member that stands for their component, of components of two or more."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        i, j = np.triu_indices(n, 0 if top else 1)
        todo = [(top, i, j)]
        while todo:
            level, i, j = todo.pop()
            near = self._apart(level, i, j) <= self.radius
            i, j = i[near], j[near]
            if level == 0:
                self._join(i, j)
                continue
            if level == 1 and len(i):  # nodes that are one component already have nothing to add
                at = np.arange(0, len(self.root), NODE)
                lo, hi = np.minimum.reduceat(self.root, at), np.maximum.reduceat(self.root, at)
                open_ = ~((lo[i] == hi[i]) & (lo[j] == hi[j]) & (lo[i] == lo[j]))
                i, j = i[open_], j[open_]
            near_first = np.argsort(np.abs(j - i), kind="stable")[::-1]
            i, j = i[near_first], j[near_first]
            for at in range(0, len(i), FRONT):
                todo.append((level - 1, *self._children(level, i[at:at + FRONT], j[at:at + FRONT])))
        member = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.order[member], self.order[self.root[member]]


def _small(x: np.ndarray, left: np.ndarray, radius: int) -> np.ndarray:
    """Root of each row among rows of groups that follow each other; ``left`` rows of its group come after a row."""
    root, i, j = np.arange(len(x)), [], []
    for step in range(1, int(left.max(initial=0)) + 1):
        at = np.flatnonzero(left >= step)
        near = np.bitwise_count(x[at] ^ x[at + step]).sum(1, dtype=np.int64) <= radius
        i.append(at[near])
        j.append(at[near] + step)
    i, j = (np.concatenate(k) if k else np.zeros(0, dtype=int) for k in (i, j))
    while True:
        before = root.copy()
        np.minimum.at(root, j, root[i])
        np.minimum.at(root, i, root[j])
        root = root[root]
        if (root == before).all():
            return root


def _forest(radius: int, lanes: int):
    """Links of each chunk; rows come sorted by chunk.  Chunks of up to ``NODE`` rows are compared many at a time."""

    def links(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        chunk, v, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        start = np.flatnonzero(np.diff(chunk, prepend=chunk[0])) if len(chunk) else np.zeros(0, dtype=int)
        start = np.concatenate([[0], start])
        size = np.diff(start, append=len(chunk))
        of = np.repeat(size, size)
        few = np.flatnonzero((of > 1) & (of <= NODE))
        left = (np.repeat(start + size, size) - 1 - np.arange(len(chunk)))[few]
        root = _small(x[few], left, radius)
        member = np.flatnonzero(root != np.arange(len(root)))
        a, b = [v[few][member]], [v[few][root[member]]]
        for at, n in zip(start[size > NODE].tolist(), size[size > NODE].tolist(), strict=True):
            i, j = GrayIndex(x[at:at + n], radius).run()
            a.append(v[at + i])
            b.append(v[at + j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            chunk, v = batch.column("chunk").to_numpy(), batch.column("v").to_numpy()
            x = np.stack([batch.column(f"f{i}").to_numpy() for i in range(lanes)], axis=1).view(np.uint64)
            cut = int(np.searchsorted(chunk, chunk[-1]))  # the last chunk may go on in the next batch
            if cut or (held and held[0][0][-1] != chunk[0]):
                held.append((chunk[:cut], v[:cut], x[:cut]))
                yield links(held)
                held = []
            held.append((chunk[cut:], v[cut:], x[cut:]))
        if held:
            yield links(held)

    return run


def _bits(value: Column, total: int, start: int, width: int) -> Column:
    """``width`` bits from ``start`` (0 is the highest) of a word of ``total`` bits."""
    return F.shiftrightunsigned(value, total - start - width).bitwiseAND(F.lit((1 << width) - 1))


def _without(value: Column, total: int, start: int, width: int) -> Column:
    """The word with those bits taken out."""
    low = total - start - width
    lower = value.bitwiseAND(F.lit((1 << low) - 1))
    upper = F.shiftrightunsigned(value, low + width) if start else F.lit(0).cast("long")
    return F.shiftleft(upper, low).bitwiseOR(lower)


def chunked(prints: DataFrame, radius: int, n: int) -> DataFrame:
    """Rows ``v``, ``f0`` of distinct fingerprints with ``chunk``: any two within ``radius`` share one."""
    parts = radius + 1
    width = 64 // parts
    lead = min(width, max(0, math.ceil(math.log2(max(n / CHUNK, 1)))))
    rows = None
    for p in range(parts):
        start = p * width
        size = width if p < parts - 1 else 64 - start
        part = prints.select("v", "f0", F.xxhash64(F.lit(p), _bits(F.col("f0"), 64, start, lead) if lead else F.lit(0)).alias("chunk"),
                             _bits(F.col("f0"), 64, start, size).alias("_block"),
                             _without(F.col("f0"), 64, start, size).alias("_rest"), F.lit(64 - size).alias("_left"))
        rows = part if rows is None else rows.unionByName(part)
    done = None
    for level in range(3):
        crowded = rows.groupBy("chunk").count().where(F.col("count") > LIMIT).select(F.col("chunk").alias("_hot"))
        crowded = stored(crowded, "crowded")
        if crowded.isEmpty():
            break
        split = rows.join(crowded, F.col("chunk") == F.col("_hot"), "left")
        calm = split.where(F.col("_hot").isNull()).select("v", "f0", "chunk")
        done = calm if done is None else done.unionByName(calm)
        hot = split.where(F.col("_hot").isNotNull()).drop("_hot")
        if level == 0:
            rows = hot.withColumn("chunk", F.xxhash64("chunk", "_block"))
            continue
        left = 64 - width if level == 1 else 64 - width - (64 - width) // parts
        piece = left // parts
        rows = None
        for p in range(parts):
            start = p * piece
            part = hot.select("v", "f0", F.xxhash64("chunk", F.lit(p), _bits(F.col("_rest"), left, start, piece)).alias("chunk"),
                              "_block", _without(F.col("_rest"), left, start, piece).alias("_rest"), "_left")
            rows = part if rows is None else rows.unionByName(part)
    rows = rows.select("v", "f0", "chunk")
    return rows if done is None else done.unionByName(rows)


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """A forest (``a``, ``b``) of the links between distinct fingerprints ``v`` at ``radius`` or fewer differing bits."""
    rows = chunked(prints.withColumn("f0", F.col("v")), radius, prints.count())
    return rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_forest(radius, 1), "a long, b long")


def groups(docs: DataFrame, print_col: str, id_col: str = "doc_id", radius: int = 3) -> DataFrame:
    """``docs`` (with a long fingerprint) and ``component_id``, the smallest id reachable by links."""
    firsts = stored(docs.groupBy(F.col(print_col).alias("v")).agg(F.min(id_col).alias("_first")), "prints")
    roots = components(links(firsts.select("v"), radius))
    named = firsts.join(roots, F.col("v") == F.col("node"), "left").select(
        "v", "_first", F.coalesce("root", "v").alias("_root"))
    best = named.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = stored(named.join(best, "_root").select(F.col("v").alias("_sim_v"), "component_id"), "groups")
    return docs.drop("component_id").join(named, F.col(print_col) == F.col("_sim_v")).drop("_sim_v")


#: Jaccard similarity of near-duplicates among whole texts.
ALIKE = 0.8


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            similarity: float = ALIKE) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the smallest id.

    The Gray-order index of fingerprints proposes pairs.  Two texts are linked when their sets of five-word shingles
    have this Jaccard similarity or more, which is checked on the sets (``jaccard``), of proposed pairs and of those that
    no fingerprint tells; a group is what links connect.  A text of fewer words is
    one shingle.  Texts without words are copies of each other.  Rows that repeat are copies.  A row without an id is
    kept only if no row of its group has one.
    """
    return apart(docs, lambda d, at: _one_of_each(d, at(id_col), at(text_col), similarity))


def proposed(sets: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs ``a`` < ``b`` of sets ``v`` whose fingerprints ``fp`` are the same or linked by the index.

    The first set stands for all of its fingerprint, so copies are never expanded into pairs.
    """
    heads = stored(sets.groupBy("fp").agg(F.min("v").alias("head")), "heads")
    near = stored(links(heads.select(F.col("fp").alias("v")), radius), "near")
    across = near.join(heads.toDF("a", "x"), "a").join(heads.toDF("b", "y"), "b")
    same = sets.join(heads, "fp").where(F.col("v") != F.col("head"))
    return across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(
        same.select(F.col("head").alias("a"), F.col("v").alias("b")))


def _one_of_each(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    text = F.col(text_col).cast("string")
    mark = F.xxhash64(F.coalesce(text, F.lit("")))
    narrow = stored(jaccard.prefixes(docs, id_col, mark, text, similarity), "narrow", texts=True)
    rank = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("mark").alias("mark")))
    firsts = stored(narrow.groupBy("v").agg(rank.alias("first_row"), F.min("fp").alias("fp"), F.first("n").alias("n"),
                                            F.first("counts").alias("counts"), F.first("first").alias("first")), "sets")
    rows = stored(jaccard.meeting(firsts), "meeting")
    marked = docs.withColumn("_mark", mark)
    need = firsts.join(rows.select("v").distinct(), "v").select(
        "v", F.col("first_row.id").alias("_id"), F.col("first_row.mark").alias("_kept"))
    texts = marked.select(F.col(id_col).alias("_own"), "_mark", text.alias("text")).join(
        need, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_kept")))
    texts = stored(texts.select("v", "text").dropDuplicates(["v"]), "texts")
    roots = components(jaccard.links(rows, firsts, texts, similarity, proposed(firsts)))
    named = firsts.join(roots, F.col("v") == F.col("node"), "left").select(
        "first_row", F.coalesce("root", "v").alias("_root"))
    kept = named.groupBy("_root").agg(F.min("first_row").alias("k")).select(
        F.col("k.id").alias("_id"), F.col("k.mark").alias("_kept"))
    kept = stored(kept, "kept")
    one = marked.join(kept, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_kept")), "left_semi")
    order = Window.partitionBy(id_col, "_mark").orderBy(F.lit(0))
    return one.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).select(*docs.columns)
