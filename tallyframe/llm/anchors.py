"""Sampled positions through which long repeats are found without comparing every position.

A window is ``window`` consecutive symbols of one text. Its anchor is the place, among
its grams of half that length, of the smallest gram hash, the leftmost one if tied. Equal
windows have equal anchors at the same place, so a window can only repeat if the gram of
its anchor does. Successive windows mostly share their anchor: the windows of one anchor
form a stretch, and equal stretches hold equal windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .text import _DOWN, _MULTIPLIER, _UP, BYTE_CODE, IS_SPACE, fingerprint, mixed, powers, quoted, run_hashes, texts, word_runs

#: Symbols that a text may have; anchors keep a place in so many bits of a hash.
PLACE_BITS = 28
_PLACE_BITS = np.uint64(PLACE_BITS)


class Hashes:
    """Hashes of any stretch of a sequence of 64-bit codes, from running sums."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        up = _UP[:n] if n <= len(_UP) else powers(_MULTIPLIER, n)
        self.down = _DOWN[: n + 1] if n < len(_DOWN) else powers(pow(_MULTIPLIER, -1, 1 << 64), n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * up, out=self.total[1:])

    def all(self, length: int) -> np.ndarray:
        """A hash of every stretch of the length; not the one of :meth:`of`."""
        n = len(self.total) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = self.total[length:] - self.total[:n]
        out *= self.down[:n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0x7FB5D329728EA185)
        return out

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each given stretch."""
        return mixed((self.total[ends] - self.total[starts]) * self.down[starts])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` successive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def stretches(hashes: Hashes, bounds: np.ndarray, window: int, gram: int = 0):
    """The stretches of windows with one anchor: (text, first window, windows, gram hash, stretch hash).

    ``bounds`` delimits the texts in the sequence. A stretch's hash covers all symbols of
    its windows.
    """
    if len(hashes.total) > 1 << PLACE_BITS:
        raise ValueError(f"a text has more than 2^{PLACE_BITS} symbols")
    gram = gram or window // 2
    grams = hashes.all(gram)
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    placed = grams & ~low
    placed |= np.arange(len(grams), dtype=np.uint64)
    best = sliding_min(placed, window - gram + 1)
    # A stretch ends where the anchor changes, where a text begins, and after the last window of a text.
    long = np.diff(bounds) >= window
    ends = (np.flatnonzero(best[1:] != best[:-1]) + 1, bounds[:-1][long], bounds[1:][long] - window + 1)
    cut = np.unique(np.concatenate(ends))
    text = np.searchsorted(bounds, cut, side="right") - 1
    inside = cut + window <= bounds[np.minimum(text + 1, len(bounds) - 1)]
    first, of = cut[inside], text[inside]
    count = np.diff(np.append(cut, len(best)))[inside]
    return of, first, count, grams[(best[first] & low).astype(np.int64)], hashes.of(first, first + count - 1 + window)


SAMPLED = "h long, seg long, key long, fp long, s int, n int"
#: Bytes of text that are hashed at a time; the arrays of so many stay in a processor's cache.
SAMPLED_BYTES = 1 << 16


def keyed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The id, a key that is never null, a fingerprint that tells rows of one key apart, and the text.

    The key of a null id is 0; its fingerprint is seeded otherwise, so it is no row with the id 0.
    """
    own, value = F.col(quoted(doc_id)).cast("long"), F.col(quoted(text)).cast("string")
    return df.select(
        own.alias("doc_id"), F.coalesce(own, F.lit(0)).alias("key"), fingerprint(own, value).alias("fp"), value.alias("text")
    )


def symbols(data: np.ndarray, bounds: np.ndarray, words: bool) -> tuple[Hashes, np.ndarray]:
    """Hashes over bytes or over words, and where each text's symbols begin and end."""
    if not words:
        return Hashes(BYTE_CODE[data]), bounds
    starts, ends, _ = word_runs(data, bounds, ~IS_SPACE)
    return Hashes(run_hashes(BYTE_CODE[data], starts, ends)), np.searchsorted(starts, bounds)


def _sampled(batches: Iterator[pa.RecordBatch], window: int, words: bool, grams_only: bool) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in texts(batches, "text", SAMPLED_BYTES):
        hashes, own = symbols(data, bounds, words)
        text, first, count, gram, seg = stretches(hashes, own, window)
        key = rows.column("key").to_numpy(zero_copy_only=False)[text]
        if grams_only:
            columns, names = [gram.view(np.int64), key], ["h", "key"]
        else:
            fp = rows.column("fp").to_numpy(zero_copy_only=False)[text]
            start = (first - own[text]).astype(np.int32)
            columns = [gram.view(np.int64), seg.view(np.int64), key, fp, start, count.astype(np.int32)]
            names = ["h", "seg", "key", "fp", "s", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def repeated_stretches(rows: DataFrame, window: int, words: bool, by_document: bool) -> DataFrame:
    """Stretches whose anchor's gram occurs twice, or in two documents if ``by_document``.

    The texts are read twice: once for the grams, which are counted with a partial
    aggregate, and once for the stretches, which are joined with the repeated grams. These
    are written before, so that the join has two plain shuffles, and adaptive execution can
    split the rows of a gram that very many share. With ``by_document``, rows without an id are left out.
    """
    if by_document:
        rows = rows.where(F.col("doc_id").isNotNull())
    grams = rows.select("key", "fp", "text").mapInArrow(lambda it: _sampled(it, window, words, True), "h long, key long")
    if by_document:
        found = grams.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("b"))
        repeated = found.where("a < b").select("h")
    else:
        repeated = grams.groupBy("h").count().where("count > 1").select("h")
    every = rows.select("key", "fp", "text").mapInArrow(lambda it: _sampled(it, window, words, False), SAMPLED)
    return every.join(written(repeated, "anchors-repeated"), "h")


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[list[dict]]:
    """Rows as dictionaries, a few at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows).to_pylist()


def covered(n: int, windows: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which of n symbols lie in a window; windows are given as (first, count)."""
    edge = np.zeros(n + 1, np.int64)
    if windows:
        at = np.array(windows, np.int64)
        np.add.at(edge, at[:, 0], 1)
        np.add.at(edge, at[:, 0] + at[:, 1] - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0

