"""Document quality by a byte-level convolutional network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import labelled_sample, texts

#: Bytes of a chunk, and from one chunk's start to the next one's.
CHUNK, STRIDE = 256, 224
FILTERS, WIDTH = 16, 8
#: Rows of one label that are brought to the driver to learn from.
SAMPLE_PER_LABEL = 2_500
STEPS, BATCH, TRAIN_CHUNKS = 900, 64, 3
#: Stands for the bytes after a text's end.
PAD = 0


@dataclass
class Convolution:
    """``filters[k]`` is what a byte at place k adds to each filter; ``out`` weighs the pooled filters."""

    filters: np.ndarray
    offset: np.ndarray
    out: np.ndarray
    bias: float


def _convolved(net: Convolution, chunks: np.ndarray) -> np.ndarray:
    """Filter values at each place of each chunk: (chunk, place, filter)."""
    places = chunks.shape[1] - WIDTH + 1
    value = net.filters[0][chunks[:, :places]]
    for k in range(1, WIDTH):
        value += net.filters[k][chunks[:, k : k + places]]
    return value


def chunked(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks that cover every text, and the text of each; an empty text has one."""
    lengths = np.diff(bounds)
    n = 1 + np.maximum(0, -(-(lengths - CHUNK) // STRIDE))
    doc = np.repeat(np.arange(len(n)), n)
    first = bounds[doc] + STRIDE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    at = first[:, None] + np.arange(CHUNK)
    inside = at < bounds[doc + 1][:, None]
    padded = data if len(data) else np.zeros(1, np.uint8)
    return np.where(inside, padded[np.minimum(at, len(padded) - 1)], PAD).astype(np.uint8), doc


def fit(sample: list[tuple[str, int]], seed: int = 11) -> Convolution:
    """Train on chunks of the texts by backpropagation through the largest place of each filter."""
    rng = np.random.default_rng(seed)
    net = Convolution(
        rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, FILTERS).astype(np.float32),
        0.0,
    )
    by_label = [[t for t, v in sample if int(v) == k] for k in (0, 1)]
    if not all(by_label):
        net.out[:] = 0
        net.bias = 4.0 if by_label[1] else -4.0 if by_label[0] else 0.0
        return net
    parts = []
    for own in by_label:
        cut = []
        for t in own:
            raw = np.frombuffer(t.encode(), np.uint8)
            cut.append(chunked(raw, np.array([0, len(raw)]))[0])
        parts.append(cut)
    bias = np.zeros(1, np.float32)
    weights = [net.filters, net.offset, net.out, bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    place = np.arange(WIDTH)
    for step in range(1, STEPS + 1):
        y = np.arange(BATCH) % 2
        picked = [parts[k][rng.integers(len(parts[k]))] for k in y]
        chunks = np.concatenate([c[rng.integers(0, len(c), TRAIN_CHUNKS)] for c in picked])
        value = _convolved(net, chunks)
        best = value.argmax(axis=1)
        top = np.take_along_axis(value, best[:, None, :], axis=1)[:, 0, :] + net.offset
        pooled = np.tanh(top)
        mean = pooled.reshape(BATCH, TRAIN_CHUNKS, FILTERS).mean(axis=1)
        p = 1 / (1 + np.exp(-(mean @ net.out + bias[0])))
        slope = ((p - y) / BATCH).astype(np.float32)
        d_top = np.repeat(slope / TRAIN_CHUNKS, TRAIN_CHUNKS)[:, None] * net.out * (1 - pooled * pooled)
        d_filters = np.zeros_like(net.filters)
        rows = np.arange(len(chunks))[:, None, None]
        seen = chunks[rows, best[:, :, None] + place]
        np.add.at(d_filters, (place, seen, np.arange(FILTERS)[None, :, None]), d_top[:, :, None])
        grads = [d_filters, d_top.sum(axis=0), mean.T @ slope + 1e-4 * net.out, np.array([slope.sum()], np.float32)]
        rate = 0.01 * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    net.bias = float(bias[0])
    return net


def train(
    df: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    per_label: int = SAMPLE_PER_LABEL,
    doc_id: str = "doc_id",
    text: str = "text",
) -> Convolution:
    """Fit on at most ``per_label`` rows of each label, 0 and 1, chosen by a hash of their id."""
    return fit(labelled_sample(df, labels.where(F.col(label).isin(0, 1)), label, per_label, doc_id, text))


def probabilities(net: Convolution, data: np.ndarray, bounds: np.ndarray, step: int = 256) -> np.ndarray:
    """The probability of good quality of each text, from all its chunks."""
    chunks, doc = chunked(data, bounds)
    n = len(bounds) - 1
    score = np.zeros(n)
    for low in range(0, len(chunks), step):
        pooled = np.tanh(_convolved(net, chunks[low : low + step]).max(axis=1) + net.offset)
        score += np.bincount(doc[low : low + step], pooled @ net.out, n)
    return 1 / (1 + np.exp(-(score / np.bincount(doc, minlength=n) + net.bias)))


def _scored(batches: Iterator[pa.RecordBatch], net: Convolution) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in texts(batches, "text", 1 << 18):
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(probabilities(net, data, bounds))], names=["doc_id", "score"]
        )


def score_documents(df: DataFrame, net: Convolution, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The probability of label 1 for each whole text: ``doc_id``, ``score``.

    Overlapping chunks cover the text; each filter's largest value in a chunk is squashed
    and averaged over the chunks, and a weighted sum of these gives the probability.

    A null or empty text is scored as one chunk of padding; a null id stays null; repeated
    rows are scored each. Only the two named columns are read, in one pass without a shuffle.
    """
    sent = df.sparkSession.sparkContext.broadcast(net)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _scored(it, sent.value), "doc_id long, score double")
