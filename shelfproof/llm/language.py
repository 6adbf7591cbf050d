"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and read as code points; n-grams of 1 to ``MOST`` characters are hashed
to ``FEATURES`` columns.  Counts per language, of n-grams and of texts for the priors, are added up over all rows to
learn from (not a sample).  Their log-probability matrix, languages by features, goes to the tasks as
a broadcast; at most ``LANGUAGES`` languages are taken, so it has a fixed largest size.  Texts are scored in
numpy by summing the matrix's columns at each text's n-grams to the log prior.

The score is the posterior of the predicted language.  NULL texts and texts without a letter get
``und`` and score 0; so does every text if nothing was learned.  Ties go to the language
that sorts first.  Repeated rows count as often as they occur.  Texts of any length are read whole, in slices.  Columns
of the input named ``lang_pred`` or ``score`` are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES, MOST = 1 << 15, 3
#: Largest number of languages: 256 x 2^15 x 4 bytes are 34 MB at most.
LANGUAGES = 256
UNKNOWN = "und"
#: Characters hashed at a time.
SLICE = 1 << 20


def ngrams(points: np.ndarray) -> Iterator[np.ndarray]:
    """Columns of the n-grams of a text, in slices that overlap by an n-gram."""
    for at in range(0, len(points), SLICE):
        p = points[at:at + SLICE + MOST - 1].astype(np.uint32)
        last = min(SLICE, len(points) - at)
        h = np.zeros(len(p), dtype=np.uint32)
        for n in range(1, MOST + 1):
            if len(p) < n:
                break
            h = h[:len(p) - n + 1] * np.uint32(0x01000193) ^ (p[n - 1:] * np.uint32(0x9E3779B1))
            mixed = (h + np.uint32(n)) * np.uint32(0x85EBCA6B)
            yield (mixed >> np.uint32(17))[:last]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each n-gram column by language within a task."""
    total: dict[str, np.ndarray] = {}  # behind the n-grams' columns, one for texts
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            whole = total.setdefault(lang, np.zeros(FEATURES + 1, dtype=np.int64))
            whole[FEATURES] += 1
            count = whole[:FEATURES]
            for h in ngrams(code_points(text)):
                count += np.bincount(h, minlength=FEATURES)
    for lang, count in total.items():
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there)), pa.array(there.astype(np.int32)),
                                          pa.array(count[there])], names=["lang", "feature", "n"])


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and log-probabilities: a row for each n-gram column and a last one of priors, a column for each
    language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = (rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
              .mapInArrow(_counted, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")))
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("feature", "n")).alias("c")).limit(LANGUAGES + 1).collect()
    if len(packed) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    langs = sorted(r["lang"] for r in packed)
    table = np.ones((FEATURES + 1, len(langs)), dtype=np.float64)
    for r in packed:
        for feature, n in r["c"]:
            table[feature, langs.index(r["lang"])] += n
    table[:FEATURES] /= table[:FEATURES].sum(0)
    table[FEATURES] /= max(table[FEATURES].sum(), 1)
    return langs, np.log(table).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    langs, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def one(text: str | None) -> tuple[str, float]:
        if text is None or not langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        points, log = code_points(text), shared.value[FEATURES].astype(np.float64)
        for h in ngrams(points):
            log += np.bincount(h, minlength=FEATURES) @ shared.value[:FEATURES] if len(h) > FEATURES else shared.value[h].sum(
                0, dtype=np.float64)
        best = int(log.argmax())
        return langs[best], float(1 / np.exp(log - log[best]).sum())

    @F.pandas_udf("lang_pred string, score double")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])

    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_p", predicted(F.col(text_col).cast("string"))).select(*keep, "_p.lang_pred", "_p.score")

