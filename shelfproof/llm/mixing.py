"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sources, in code-point order and NULL last, weigh 3, 1, 2, repeating, and share
   ``share`` of all words; a target stops at ``most`` times its source's words, and
   what is cut off is shared again by weight among the rest until none is above.
2. Each source is dealt by a hash into blocks of about ``block_words`` words.  A hash
   deals at random, so blocks in order of their number are already permuted.  Whole
   passes take every block; the rest of a target takes blocks from the first on, and of
   the last of these documents in hash order, the very last one cut at a word, so that
   the words taken are the rounded target exactly and at most one document of a source
   is cut.
3. The draws, counted in blocks per source, are split among output shards by a binary
   tree: each node draws the part of its left half from all its sources at once without
   replacement (multivariate hypergeometric), fixed by the seed and the node.  So shards
   hold equal numbers of blocks, every block goes to one shard, and any task can walk
   the tree for its own blocks.  Sources are put together into at most ``STRATA`` strata
   for this, each permuted as a whole, which gives the same distribution.
4. ``emit`` puts a shard's documents together and shuffles them by hash.

The unit is a word, ``[^\\x20\\x09-\\x0D]+``.  A document without words takes none.  NULL
sources are one source, NULL ids are ids like others, rows that repeat are dealt and taken
each on its own.  An empty table gives an empty mix.  A source may hold any share of the
rows: only one block of it is ever ordered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfproof.llm.common import numbered, running_total, stored, text_key, with_keyed

WEIGHTS = (3.0, 1.0, 2.0)
STRATA = 256
BLOCK_WORDS, SHARD_WORDS = 1 << 16, 1 << 22


class SplitTree:
    """Which shard the draw at a place of a stratum goes to."""

    def __init__(self, quotas: list[int], shards: int, seed: int) -> None:
        self.quotas, self.shards, self.seed = np.asarray(quotas, dtype=np.int64), max(shards, 1), seed
        self.total = int(self.quotas.sum())
        rng = np.random.default_rng([seed, 7])
        self.step = np.array([self._coprime(int(q), rng) for q in self.quotas], dtype=object)
        self.shift = np.array([int(rng.integers(q)) if q else 0 for q in self.quotas], dtype=object)
        self.left: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def _coprime(q: int, rng: np.random.Generator) -> int:
        while q > 2:
            step = int(rng.integers(1, q))
            if math.gcd(step, q) == 1:
                return step
        return 1

    def _draw(self, lo: int, mid: int, hi: int, held: np.ndarray) -> np.ndarray:
        if (lo, hi) not in self.left:
            edge = lambda i: self.total * i // self.shards
            rng = np.random.default_rng([self.seed, lo, hi])
            self.left[lo, hi] = rng.multivariate_hypergeometric(held, edge(mid) - edge(lo), method="marginals")
        return self.left[lo, hi]

    def shard(self, stratum: np.ndarray, place: np.ndarray) -> np.ndarray:
        place = np.array([(int(p) * self.step[s] + self.shift[s]) % int(self.quotas[s])
                          for s, p in zip(stratum.tolist(), place.tolist(), strict=True)], dtype=np.int64)
        out = np.zeros(len(place), dtype=np.int32)
        todo = [(0, self.shards, self.quotas, np.arange(len(place)))]
        while todo:
            lo, hi, held, rows = todo.pop()
            if not len(rows):
                continue
            if hi - lo == 1:
                out[rows] = lo
                continue
            mid = (lo + hi) // 2
            left = self._draw(lo, mid, hi, held)
            mine = left[stratum[rows]]
            goes = place[rows] < mine
            place[rows[~goes]] -= mine[~goes]
            todo += [(lo, mid, left, rows[goes]), (mid, hi, held - left, rows[~goes])]
        return out


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds ``target`` to ``weight`` and ``words`` of each source."""
    cap = F.col("words") * F.lit(most)
    total, weights = sources.agg(F.sum("words"), F.sum("weight")).first()
    if not total:
        return sources.withColumn("target", F.lit(0.0))
    level, capped = share * total / weights, -1
    while True:
        over = cap <= F.col("weight") * F.lit(level)
        n, held, free = sources.agg(F.count_if(over), F.sum(F.when(over, cap).otherwise(0.0)),
                                    F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not free:
            break
        level, capped = (share * total - held) / free, n
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def plan(rows: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size",
         share: float = 1.5, most: float = 2.0, seed: int = 20, block_words: int = BLOCK_WORDS,
         shard_words: int = SHARD_WORDS) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``draws``: (pass, words, shard) for each time a row is taken."""
    clash = [c for c in rows.columns if c.startswith("_m_") or c in ("source_size", "target", "draws")]
    rows = rows.drop(*[c for c in clash if c not in (id_col, source_col, size_col)])
    sources = rows.groupBy(F.col(source_col).alias("_m_source")).agg(F.sum(size_col).cast("long").alias("words"))
    sources = numbered(sources, [F.col("_m_source").isNull(), F.col("_m_source")], "rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    sources = stored(targets(sources.withColumn("weight", weight), share, most), "targets")
    # Whole passes of a source, and the words that the last, partial pass takes.
    taken = F.round("target").cast("long")
    passes = F.when(F.col("words") > 0, F.floor(taken / F.col("words"))).otherwise(F.lit(0)).cast("long")
    sources = (sources.withColumn("_m_passes", passes).withColumn("_m_cut", taken - passes * F.col("words"))
               .withColumn("_m_blocks", F.greatest(F.lit(1), F.ceil(F.col("words") / block_words)).cast("long"))
               .withColumn("_m_stratum", (F.col("rank") % STRATA).cast("int")))
    n_sources = sources.count()
    order = text_key(F.struct(F.col(id_col), F.col(size_col)), seed)
    block = F.pmod(text_key(F.struct(F.col(id_col), F.col(size_col)), seed + 1), F.col("_m_blocks"))
    near = sources.select("_m_source", "_m_passes", "_m_cut", "_m_blocks")
    dealt = with_keyed(rows.select(id_col, source_col, size_col), near, source_col, n_sources, order)
    blocks = dealt.groupBy(F.col(source_col).alias("_m_source"), "_m_cut", block.alias("_m_block")).agg(
        F.sum(size_col).alias("held"))
    blocks = running_total(stored(blocks, "blocks"), ["_m_source"], "_m_block", "held", "before")
    take = F.least(F.greatest(F.col("_m_cut") - F.col("before"), F.lit(0)), F.col("held"))
    edge = blocks.withColumn("take", take).where(F.col("take") < F.col("held")).groupBy("_m_source").agg(
        F.min_by(F.struct(F.col("_m_block").alias("edge"), F.col("take").alias("rest")), "_m_block").alias("e"))
    whole = sources.alias("s").join(edge.alias("b"), F.col("s._m_source").eqNullSafe(F.col("b._m_source")), "left").select(
        "s.*", F.coalesce(F.col("b.e.edge"), F.col("s._m_blocks")).alias("_m_edge"),
        F.coalesce(F.col("b.e.rest"), F.lit(0)).alias("_m_rest"))
    quota = F.col("_m_passes") * F.col("_m_blocks") + F.col("_m_edge") + (F.col("_m_rest") > 0).cast("long")
    whole = whole.withColumn("_m_quota", quota).withColumn("_m_nth", F.floor(F.col("rank") / STRATA))
    whole = stored(running_total(whole, ["_m_stratum"], "_m_nth", "_m_quota", "_m_first"), "quotas")
    quotas = dict(whole.groupBy("_m_stratum").agg(F.sum("_m_quota")).collect())  # at most STRATA rows
    words = whole.agg(F.sum(F.round("target"))).first()[0] or 0
    tree = SplitTree([quotas.get(i, 0) for i in range(max(quotas, default=0) + 1)], math.ceil(words / shard_words), seed)

    per = whole.select("_m_source", F.col("words").alias("source_size"), "target", "_m_passes", "_m_blocks", "_m_edge",
                       "_m_rest", "_m_stratum", "_m_first")
    full = with_keyed(rows, per, source_col, n_sources, order).withColumn("_m_block", block)
    at_edge = (F.col("_m_block") == F.col("_m_edge")) & (F.col("_m_rest") > 0)
    before = Window.partitionBy(source_col).orderBy(order, id_col, size_col).rowsBetween(Window.unboundedPreceding, -1)
    edge_rows = full.where(at_edge).withColumn("_m_before", F.coalesce(F.sum(size_col).over(before), F.lit(0)))
    edge_rows = edge_rows.withColumn("_m_extra", F.least(F.greatest(F.col("_m_rest") - F.col("_m_before"), F.lit(0)),
                                                         F.col(size_col))).drop("_m_before")
    rest = full.where(~at_edge).withColumn(
        "_m_extra", F.when(F.col("_m_block") < F.col("_m_edge"), F.col(size_col)).otherwise(F.lit(0)))
    full = rest.unionByName(edge_rows)

    @F.pandas_udf("int")
    def shard(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for stratum, place in parts:
            out = pd.Series([None] * len(place), dtype="Int32")
            there = place.notna().to_numpy()
            out[there] = tree.shard(stratum[there].to_numpy(), place[there].to_numpy().astype(np.int64))
            yield out

    def draw(nth: int) -> Column:
        """The draw of pass ``nth``: a whole pass, or the partial one after the whole ones, or none."""
        size = F.when(F.col("_m_passes") > nth, F.col(size_col)).when(F.col("_m_passes") == nth, F.col("_m_extra"))
        return F.coalesce(size, F.lit(0))

    most_passes = math.ceil(most)
    full = full.withColumns({f"_m_words{p}": draw(p) for p in range(most_passes)})
    full = full.withColumns({f"_m_shard{p}": shard(F.col("_m_stratum"), F.when(
        F.col(f"_m_words{p}") > 0, F.col("_m_first") + p * F.col("_m_blocks") + F.col("_m_block")))
        for p in range(most_passes)})
    draws = F.array(*[F.struct(F.lit(p).alias("pass"), F.col(f"_m_words{p}").cast("long").alias("words"),
                               F.col(f"_m_shard{p}").alias("shard")) for p in range(most_passes)])
    full = full.withColumn("draws", F.filter(draws, lambda d: d.words > 0))
    return full.drop(*[c for c in full.columns if c.startswith("_m_")])


def emit(planned: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "size",
         seed: int = 20) -> DataFrame:
    """A row for each draw: the document, its text cut to the words drawn, ``shard``; shards together, each shuffled."""
    drawn = planned.withColumn("_d", F.explode("draws"))
    pieces = F.regexp_extract_all(text_col, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.concat_ws("", F.slice(pieces, F.lit(1), F.col("_d.words").cast("int")))
    drawn = drawn.withColumn(text_col, F.when(F.col("_d.words") < F.col(size_col), cut).otherwise(F.col(text_col)))
    drawn = drawn.withColumn("shard", F.col("_d.shard")).withColumn("_o", text_key(F.struct(id_col, "_d.pass"), seed))
    return drawn.repartition("shard").sortWithinPartitions("shard", "_o").drop("_d", "_o", "draws")
