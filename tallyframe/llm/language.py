"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import IS_LETTER, labelled_sample, texts

#: Bytes that the state runs over before it starts anew; every byte is in one segment.
SEGMENT = 128
HIDDEN = 8
#: Rows of one language that are brought to the driver to learn from.
SAMPLE_PER_LABEL = 600
STEPS, BATCH, TRAIN_LENGTH = 500, 256, 48
UNKNOWN = "und"

BLANK = 0x20


@dataclass
class Network:
    """Weights of both directions and of the labels.

    ``inputs[d]`` is what each byte adds to reset gate, update gate and candidate,
    ``states[d]`` what the state adds; ``out`` maps both states to label scores.
    """

    labels: list[str]
    inputs: list[np.ndarray]
    states: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def _new(labels: list[str], rng: np.random.Generator) -> Network:
    h = HIDDEN
    return Network(
        labels,
        [rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32) for _ in range(2)],
        [rng.normal(0, 0.3, (h, 3 * h)).astype(np.float32) for _ in range(2)],
        rng.normal(0, 0.3, (2 * h, len(labels))).astype(np.float32),
        np.zeros(len(labels), np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def _run(steps: np.ndarray, table: np.ndarray, state: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each byte of ``steps`` (time by segment), from zero: (time, segment, hidden)."""
    h = HIDDEN
    now = np.zeros((steps.shape[1], h), np.float32)
    out = np.empty((*steps.shape, h), np.float32)
    for t, b in enumerate(steps):
        x = table[b]
        a = now @ state
        gates = _sigmoid(x[:, : 2 * h] + a[:, : 2 * h])
        r, z = gates[:, :h], gates[:, h:]
        n = np.tanh(x[:, 2 * h :] + r * a[:, 2 * h :])
        if keep is not None:
            keep.append((now, a[:, 2 * h :], r, z, n))
        now = np.add(n, z * (now - n), out=out[t])
    return out


def _unrun(steps: np.ndarray, kept: list, state: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: gradients of the byte table and of the state matrix."""
    h = HIDDEN
    d_table, d_state = np.zeros((256, 3 * h), np.float32), np.zeros_like(state)
    down = np.zeros_like(above[0])
    for t in range(len(steps) - 1, -1, -1):
        was, a_n, r, z, n = kept[t]
        down = down + above[t]
        d_n = down * (1 - z) * (1 - n * n)
        d_z = down * (was - n) * z * (1 - z)
        d_r = d_n * a_n * r * (1 - r)
        d_x = np.concatenate([d_r, d_z, d_n], axis=1)
        d_a = np.concatenate([d_r, d_z, d_n * r], axis=1)
        np.add.at(d_table, steps[t], d_x)
        d_state += was.T @ d_a
        down = down * z + d_a @ state.T
    return d_table, d_state


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def fit(sample: list[tuple[str, str]], seed: int = 7) -> Network:
    """Train on random stretches of the texts; each byte of a stretch carries its text's label."""
    rng = np.random.default_rng(seed)
    labels = sorted({v for _, v in sample})
    net = _new(labels, rng)
    by_label = [
        [np.frombuffer(t.encode(), np.uint8) for t, v in sample if v == label and len(t) >= 1] for label in labels
    ]
    if len(labels) < 2 or not all(by_label):
        return net
    weights = [*net.inputs, *net.states, net.out, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        y = rng.integers(0, len(labels), BATCH)
        stretch = np.full((BATCH, TRAIN_LENGTH), BLANK, np.uint8)
        for i, k in enumerate(y):
            text = by_label[k][rng.integers(len(by_label[k]))]
            at = rng.integers(max(1, len(text) - TRAIN_LENGTH + 1))
            part = text[at : at + TRAIN_LENGTH]
            stretch[i, : len(part)] = part
        ahead, back = stretch.T.copy(), stretch.T[::-1].copy()
        kept: tuple[list, list] = ([], [])
        states = np.concatenate(
            [
                _run(ahead, net.inputs[0], net.states[0], kept[0]),
                _run(back, net.inputs[1], net.states[1], kept[1])[::-1],
            ],
            axis=2,
        )
        p = _softmax(states @ net.out + net.bias)
        p[:, np.arange(BATCH), y] -= 1
        p /= p.shape[0] * BATCH
        above = p @ net.out.T
        table0, state0 = _unrun(ahead, kept[0], net.states[0], above[:, :, :HIDDEN])
        table1, state1 = _unrun(back, kept[1], net.states[1], above[::-1, :, HIDDEN:])
        d_out = states.reshape(-1, 2 * HIDDEN).T @ p.reshape(-1, len(labels))
        grads = [table0, table1, state0, state1, d_out, p.sum(axis=(0, 1))]
        rate = 0.02 * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def train(
    df: DataFrame,
    labelled: DataFrame,
    label: str = "lang",
    per_label: int = SAMPLE_PER_LABEL,
    doc_id: str = "doc_id",
    text: str = "text",
) -> Network:
    """Fit on at most ``per_label`` rows of each label, chosen by a hash of their id."""
    return fit(labelled_sample(df, labelled, label, per_label, doc_id, text))


def label_positions(data: np.ndarray, bounds: np.ndarray, net: Network) -> np.ndarray:
    """The probability of each label at every byte: (byte, label)."""
    lengths = np.diff(bounds)
    n = -(-lengths // SEGMENT)
    first = np.repeat(bounds[:-1], n) + SEGMENT * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    end = np.repeat(bounds[1:], n)
    at = first[None, :] + np.arange(SEGMENT)[:, None]
    valid = at < end
    steps = np.where(valid, data[np.minimum(at, max(len(data) - 1, 0))], BLANK) if len(data) else at.astype(np.uint8)
    ahead = _run(steps, net.inputs[0], net.states[0])
    back = _run(steps[::-1], net.inputs[1], net.states[1])[::-1]
    scores = ahead.reshape(-1, HIDDEN) @ net.out[:HIDDEN]
    scores += back.reshape(-1, HIDDEN) @ net.out[HIDDEN:]
    scores += net.bias
    p = _softmax(scores).reshape(*steps.shape, len(net.labels))
    return np.swapaxes(p, 0, 1)[valid.T]


def _predicted(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    names = np.array([*net.labels, UNKNOWN], dtype=object)
    for rows, data, bounds in texts(batches, "text", 1 << 18):
        letters = IS_LETTER[data]
        doc = np.repeat(np.arange(rows.num_rows), np.diff(bounds))[letters]
        n = np.bincount(doc, minlength=rows.num_rows)
        if net.labels:
            pooled = np.zeros((rows.num_rows, len(net.labels)))
            low = 0
            # A text longer than a slice is labelled in parts, cut between segments.
            for cut in range(0, len(data), SEGMENT << 11) if rows.num_rows == 1 else [0]:
                high = min(cut + (SEGMENT << 11), len(data)) if rows.num_rows == 1 else len(data)
                own = np.array([0, high - cut]) if rows.num_rows == 1 else bounds
                p = label_positions(data[cut:high], own, net)[letters[cut:high]]
                for k in range(len(net.labels)):
                    pooled[:, k] += np.bincount(doc[low : low + len(p)], p[:, k], rows.num_rows)
                low += len(p)
            pooled /= np.maximum(n, 1)[:, None]
            best, score = pooled.argmax(axis=1), np.clip(pooled.max(axis=1), 0, 1)
        else:
            best, score = np.zeros(rows.num_rows, int), np.zeros(rows.num_rows)
        # Bytes beyond ASCII may be other characters than letters.
        plain = np.bincount(doc[data[letters] < 0x80], minlength=rows.num_rows) > 0
        for i in np.flatnonzero(~plain):
            raw = data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace")
            if not any(map(str.isalpha, raw)):
                best[i], score[i] = len(net.labels), 0.0
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(names[best], pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
        )


def predict(df: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The language of each whole text: ``doc_id``, ``lang_pred``, ``score``.

    Every byte gets label probabilities from a state that comes from its left and one
    that comes from its right; a document's are the means over its letters. States
    start anew every ``SEGMENT`` bytes, so memory does not follow a text's length.

    A text that is null or without letters is ``und`` with score 0; a null id stays null;
    repeated rows are labelled each. Only the two named columns are read, in one pass
    without a shuffle.
    """
    sent = df.sparkSession.sparkContext.broadcast(net)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _predicted(it, sent.value), "doc_id long, lang_pred string, score double")
