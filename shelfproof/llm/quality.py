"""Quality of a text from a byte-level convolutional network in numpy.

A text's UTF-8 bytes are read in chunks that overlap by a filter's width, so every
position of the whole text is covered.  Each byte is a learned vector plus one channel
that says whether the last ``MATCH`` bytes also occurred within the ``LAGS`` bytes before.
Learned filters of ``WIDTH`` bytes move by ``STRIDE``; each filter's largest value over the
whole text (max-pooling across chunks) goes through one linear unit and a sigmoid.

``fit`` learns by Adam on the driver from at most ``ROWS`` labelled texts of each label and at most
``BYTES`` bytes of them, whole texts in hash order, none longer than a twentieth of ``BYTES`` (the documented bound); scoring runs in
Arrow batches on all rows, with the weights (about 20 kB) in the closure.

NULL and empty texts have no filter value and get the probability that the bias gives.
Without any labelled row the score is 0.5.  Rows that repeat a document id among the labels
count once, with the larger label; every row of the table is scored on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfproof.llm.common import lean

EMBED, FILTERS, WIDTH, STRIDE = 6, 24, 12, 4
CHUNK = 1 << 15
MATCH, LAGS = 4, 24
#: Bound of the training sample, for each label, and its bytes in all.
ROWS, BYTES = 800, 8_000_000
STEPS, BATCH, RATE = 300, 32, 0.01
#: Texts longer than this are read in more than one chunk and never held as windows whole.
THRESHOLD = 0.3


@dataclass
class Network:
    table: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * (EMBED + 1) x FILTERS
    shift: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    bias: float

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.filters, self.shift, self.out, np.array([self.bias], dtype=np.float32)]


def start(seed: int = 4) -> Network:
    rng = np.random.default_rng(seed)
    return Network(rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
                   rng.normal(0, 0.15, (WIDTH * (EMBED + 1), FILTERS)).astype(np.float32),
                   np.zeros(FILTERS, dtype=np.float32), rng.normal(0, 0.2, FILTERS).astype(np.float32), 0.0)


def repeats(b: np.ndarray) -> np.ndarray:
    """Whether the MATCH bytes that end here also ended up to LAGS bytes before."""
    hit = np.zeros(len(b), dtype=bool)
    if len(b) <= MATCH:
        return hit
    word = np.zeros(len(b), dtype=np.uint32)
    for i in range(MATCH):
        word[MATCH - 1:] |= b[i:len(b) - MATCH + 1 + i].astype(np.uint32) << (8 * i)
    word[:MATCH - 1] = np.arange(MATCH - 1)  # no match before the first whole word
    for lag in range(2, LAGS + 1):
        if lag < len(b):
            hit[lag:] |= word[lag:] == word[:-lag]
    return hit


def windows(net: Network, b: np.ndarray, match: np.ndarray) -> np.ndarray:
    """One row of inputs for each place of the filters in a chunk."""
    x = np.empty((len(b), EMBED + 1), dtype=np.float32)
    x[:, :EMBED] = net.table[b]
    x[:, EMBED] = match
    view = np.lib.stride_tricks.sliding_window_view(x, (WIDTH, EMBED + 1))[::STRIDE, 0]
    return view.reshape(len(view), -1)


def chunks(text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Offset, bytes and match channel of overlapping chunks; the text is padded to a whole number of steps."""
    if not text:
        return
    pad = max(WIDTH - len(text), -(len(text) - WIDTH) % STRIDE)
    b = np.frombuffer(text + b"\0" * pad, dtype=np.uint8)
    match = repeats(b)
    for at in range(0, len(b) - WIDTH + 1, CHUNK):
        yield at, b[at:at + CHUNK + WIDTH - STRIDE], match[at:at + CHUNK + WIDTH - STRIDE]


def pooled(net: Network, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Largest value of each filter over the whole text and where it is; zeros and -1 for an empty text."""
    top = np.full(FILTERS, -np.inf, dtype=np.float32)
    place = np.full(FILTERS, -1, dtype=np.int64)
    for at, b, match in chunks(text):
        value = windows(net, b, match) @ net.filters
        best = value.argmax(0)
        peak = value[best, np.arange(FILTERS)]
        place = np.where(peak > top, at + best * STRIDE, place)
        top = np.maximum(peak, top)
    if place[0] < 0:
        return np.zeros(FILTERS, dtype=np.float32), place
    return np.tanh(top + net.shift), place


def train(texts: list[bytes], labels: np.ndarray, seed: int = 4) -> Network:
    """Adam on cross-entropy; only the places that won the pooling get a gradient.

    Both labels weigh the same, however rare one is in the sample.
    """
    net, rng = start(seed), np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
    first, second = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    padded = [t + b"\0" * (WIDTH + STRIDE) for t in texts]
    order = np.zeros(0, dtype=int)
    for step in range(1, STEPS + 1):
        rate = RATE * (1 - step / STEPS) + RATE * 0.05
        if len(order) < min(BATCH, len(texts)):
            order = rng.permutation(len(texts))
        some, order = order[:BATCH], order[BATCH:]
        grads = [np.zeros_like(p) for p in net.parts()]
        for i in some:
            h, place = pooled(net, texts[i])
            p = 1 / (1 + np.exp(-np.clip(float(h @ net.out) + net.bias, -30, 30)))
            d = (p - labels[i]) * weight[i] / len(some)
            grads[3] += d * h
            grads[4] += d
            if place[0] < 0:
                continue
            dh = d * net.out * (1 - h**2)
            grads[2] += dh
            b = np.frombuffer(padded[i], dtype=np.uint8)
            at = place[:, None] + np.arange(WIDTH)
            x = np.empty((FILTERS, WIDTH, EMBED + 1), dtype=np.float32)
            x[:, :, :EMBED] = net.table[b[at]]
            lo = np.maximum(place - LAGS - MATCH, 0)
            for f in range(FILTERS):
                x[f, :, EMBED] = repeats(b[lo[f]:place[f] + WIDTH])[place[f] - lo[f]:]
            grads[1] += (x.reshape(FILTERS, -1) * dh[:, None]).T
            back = (net.filters.T * dh[:, None]).reshape(FILTERS, WIDTH, EMBED + 1)[:, :, :EMBED]
            np.add.at(grads[0], b[at].ravel(), back.reshape(-1, EMBED))
        new = []
        for k, (p, g) in enumerate(zip(net.parts(), grads, strict=True)):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            new.append((p - move).astype(np.float32))
        net = Network(*new[:4], float(new[4][0]))
    return net


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", rows: int = ROWS, size: int = BYTES) -> Network | None:
    """Learns from labelled texts whose row satisfies ``learn`` (an expression of ``id_col``)."""
    marked = (labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .groupBy(id_col).agg(F.max(label_col).alias("_label")))
    order = F.xxhash64(id_col)
    sample = None
    for value in (0, 1):
        part = marked.where(F.col("_label") == value).orderBy(order, id_col).limit(rows)
        sample = part if sample is None else sample.union(part)
    texts = (docs.select(id_col, F.col(text_col).cast("string").alias("_text")).join(F.broadcast(sample), id_col)
             .where(F.octet_length("_text") <= size // 20))
    got = texts.dropDuplicates([id_col]).withColumn("_o", order).toPandas().sort_values(["_o", id_col])
    got = got[got["_text"].notna()]
    data = [t.encode() for t in got["_text"]]
    inside = np.cumsum([len(t) for t in data]) <= size if data else np.zeros(0, dtype=bool)
    data = [t for t, keep in zip(data, inside, strict=True) if keep]
    marks = got["_label"].to_numpy(dtype=np.float32)[inside]
    return train(data, marks) if data else None


def score(net: Network | None, text: Column) -> Column:
    """Probability of label 1 of each whole text."""

    @F.pandas_udf("double")
    @lean
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            if net is None:
                yield pd.Series(np.full(len(texts), 0.5))
                continue
            h = np.array([pooled(net, (t or "").encode())[0] for t in texts], dtype=np.float64).reshape(-1, FILTERS)
            yield pd.Series(1 / (1 + np.exp(-(h @ net.out.astype(np.float64) + net.bias))))

    return scored(text.cast("string"))


def with_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "quality", out: str = "score") -> DataFrame:
    return docs.withColumn(out, score(fit(docs, labels, learn, id_col, text_col, label_col), F.col(text_col)))
