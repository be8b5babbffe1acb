"""Toxicity by multiple-instance learning: sentences scored, documents labelled."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import BYTE_CODE, IS_LETTER, LOWER, labelled_sample, quoted, run_hashes, slices, texts, utf8, word_runs

#: Rows of one label that are brought to the driver to learn from.
SAMPLE_PER_LABEL = 2_000
FEATURE_BITS = 18
#: Bytes of a word's start that are features beside the word.
PREFIXES = (4, 5)
ROUNDS = 120
#: Where the log odds of a sentence start.
START = -7.0
PENALTY = 4.0
MIN_DOCUMENTS = 5

ENDS_SENTENCE = np.zeros(256, dtype=bool)
ENDS_SENTENCE[list(b".!?\n")] = True


@dataclass
class NoisyOr:
    """A weight for each hashed word, and the weight that every sentence starts from."""

    weights: np.ndarray
    start: float


def _sentences(data: np.ndarray, bounds: np.ndarray):
    """Features of the sentences with words: (feature, its sentence, text and span of each sentence).

    A word has itself as a feature, and its first four and five bytes, which inflected
    and derived words share.
    """
    starts, ends, doc = word_runs(data, bounds, IS_LETTER)
    codes = BYTE_CODE[LOWER[data]]
    stops = np.concatenate([[0], np.cumsum(ENDS_SENTENCE[data])])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (stops[starts[1:]] != stops[starts[:-1]]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    hashes, own = [run_hashes(codes, starts, ends)], [sentence]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts >= n)
        hashes.append(run_hashes(codes, starts[long], starts[long] + n) ^ np.uint64(n))
        own.append(sentence[long])
    feature = (np.concatenate(hashes) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    return feature, np.concatenate(own), doc[first], starts[first], ends[last]


def _log_clean(model: NoisyOr, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    """The logarithm of each sentence's probability of being clean."""
    z = model.start + np.bincount(sentence, model.weights[feature], n)
    return -np.logaddexp(0, z)


def fit(sample: list[tuple[str, int]]) -> NoisyOr:
    """Learn sentence scores from document labels.

    A document is toxic unless all its sentences are clean; the likelihood of the labels
    under that noisy-or is maximised by gradient steps with adaptive rates and a
    penalty on absolute weights, so that few words get any. Features of fewer than ``MIN_DOCUMENTS`` texts get no weight.
    """
    size = 1 << FEATURE_BITS
    model = NoisyOr(np.zeros(size), START)
    if not sample:
        return model
    y = np.array([int(v) for _, v in sample], float)
    parts = []
    n = 0
    for low in range(0, len(sample), 100):  # small slices: features are held as 32-bit numbers only
        data, bounds = utf8(pa.array([t for t, _ in sample[low : low + 100]], pa.string()))
        feature, sentence, doc, _, _ = _sentences(data, bounds)
        parts.append([x.astype(np.int32) for x in (feature, sentence + n, doc + low)])
        n += len(doc)
    feature, sentence, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
    docs = len(y)
    frequent = np.zeros(size, np.int32)
    for f, s, d in parts:
        pairs = np.unique((d[s - s.min()].astype(np.int64) if len(s) else s.astype(np.int64)) * size + f)
        np.add.at(frequent, pairs % size, 1)
    del parts
    known = (frequent >= MIN_DOCUMENTS)[feature]
    feature, sentence = feature[known], sentence[known]
    used, feature = np.unique(feature, return_inverse=True)
    feature = feature.astype(np.int32)
    w, start = np.zeros(len(used)), START
    speed, speed0 = np.full(len(used), 1.0), 1.0
    # Each label weighs the same, whatever its share of the sample.
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * docs
    for _ in range(ROUNDS):
        z = start + np.bincount(sentence, w[feature], n)
        p = np.exp(-np.logaddexp(0, -z))
        clean = np.bincount(doc, -np.logaddexp(0, z), docs)
        toxic = np.maximum(-np.expm1(clean), 1e-12)
        pull = np.where(y > 0, -np.exp(clean) / toxic, 1.0) * weight
        slope = pull[doc] * p
        g = np.bincount(feature, slope[sentence], len(used))
        speed += g * g
        w -= 0.5 * g / np.sqrt(speed)
        w = np.sign(w) * np.maximum(np.abs(w) - 0.5 * PENALTY / np.sqrt(speed), 0)
        g0 = slope.sum()
        speed0 += g0 * g0
        start -= 0.2 * g0 / np.sqrt(speed0)
    model.weights[used] = w
    model.start = float(start)
    return model


def train(
    df: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    per_label: int = SAMPLE_PER_LABEL,
    doc_id: str = "doc_id",
    text: str = "text",
) -> NoisyOr:
    """Fit on at most ``per_label`` rows of each label, 0 and 1, chosen by a hash of their id."""
    return fit(labelled_sample(df, labels.where(F.col(label).isin(0, 1)), label, per_label, doc_id, text))


def _scored(batches: Iterator[pa.RecordBatch], model: NoisyOr, spans: float | None) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in texts(batches, "text"):
        feature, sentence, doc, start, end = _sentences(data, bounds)
        log_clean = _log_clean(model, feature, sentence, len(doc))
        if spans is None:
            score = -np.expm1(np.bincount(doc, log_clean, rows.num_rows))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.clip(score, 0, 1))], names=["doc_id", "score"])
            continue
        p = -np.expm1(log_clean)
        hit = np.flatnonzero(p >= spans)
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(0).take(pa.array(doc[hit])),
                pa.array(start[hit] - bounds[doc[hit]]),
                pa.array(end[hit] - bounds[doc[hit]]),
                pa.array(p[hit]),
                pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[hit], end[hit], strict=True)], pa.string()),
            ],
            names=["doc_id", "start", "end", "score", "sentence"],
        )


def _rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))


def score_documents(df: DataFrame, model: NoisyOr, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The probability that some sentence of a document is toxic: ``doc_id``, ``score``.

    Every sentence of the whole text counts. A text that is null or has no letters scores
    0; a null id stays null; repeated rows are scored each. Only the two named columns
    are read, in one pass without a shuffle.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    return _rows(df, doc_id, text).mapInArrow(lambda it: _scored(it, sent.value, None), "doc_id long, score double")


def _clean(batches: Iterator[pa.RecordBatch], model: NoisyOr, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = utf8(pc.struct_field(batch.column(0), [at]))
        keep = []
        for low, high in slices(bounds):
            own = bounds[low : high + 1] - bounds[low]
            feature, sentence, doc, _, _ = _sentences(data[bounds[low] : bounds[high]], own)
            log_clean = _log_clean(model, feature, sentence, len(doc))
            keep.append(-np.expm1(np.bincount(doc, log_clean, high - low)) < threshold)
        yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch


def keep_clean(df: DataFrame, model: NoisyOr, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below ``threshold``.

    The rows are filtered where they are read; texts that are null or have no letters stay, as do
    rows with a null id, and repeated rows are judged each. Columns may have any names. No rows give no rows.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    # One struct holds the columns given, because names with dots are not passed to Python otherwise.
    rows = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"))
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    at = [c if exact else c.lower() for c in df.columns].index(text if exact else text.lower())
    kept = rows.mapInArrow(lambda it: _clean(it, sent.value, at, threshold), rows.schema)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def offending_sentences(
    df: DataFrame, model: NoisyOr, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Sentences that score at least ``threshold``, with their bytes in the text."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    return _rows(df, doc_id, text).mapInArrow(
        lambda it: _scored(it, sent.value, threshold), "doc_id long, start long, end long, score double, sentence string"
    )
