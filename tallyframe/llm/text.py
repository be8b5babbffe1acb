"""Texts of Arrow batches as numpy bytes, and what several operators do with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a single longer text is taken alone.
SLICE_BYTES = 1 << 20

#: The bytes that end a word: blank and the six ASCII control characters of white space.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Lower case of A-Z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Letters for the classifiers: A-Z, a-z and every byte of a longer UTF-8 character.
IS_LETTER = np.zeros(256, dtype=bool)
IS_LETTER[0x41:0x5B] = IS_LETTER[0x61:0x7B] = IS_LETTER[0x80:] = True

_MULTIPLIER = 0x9E3779B97F4A7C15
#: A random 64-bit value for each byte, so that hashes do not follow the alphabet.
BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 bounds; a null text is empty."""
    binary = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, bounds, data = binary.buffers()
    if len(binary) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(binary) + 1, np.int64)
    at = np.frombuffer(bounds, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(bounds: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``size`` bytes together, or one longer row."""
    low, rows = 0, len(bounds) - 1
    while low < rows:
        high = int(np.searchsorted(bounds, bounds[low] + size, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def texts(batches: Iterator[pa.RecordBatch], name: str, size: int = SLICE_BYTES):
    """Slices of each batch: (the batch's rows of the slice, bytes, bounds)."""
    for batch in batches:
        data, bounds = utf8(batch.column(batch.schema.get_field_index(name)))
        for low, high in slices(bounds, size):
            own = bounds[low : high + 1]
            yield batch.slice(low, high - low), data[own[0] : own[-1]], own - own[0]


def powers(multiplier: int, n: int) -> np.ndarray:
    """1, m, m^2, ... modulo 2^64."""
    out = np.full(n, multiplier, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_UP = powers(_MULTIPLIER, 1 << 16)
_DOWN = powers(pow(_MULTIPLIER, -1, 1 << 64), 1 << 16)


def _powers(table: np.ndarray, base: int, n: int) -> np.ndarray:
    return table[:n] if n <= len(table) else powers(base, n)


def run_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[start:end] for each run; equal runs have equal hashes."""
    n = len(codes)
    up = powers(_MULTIPLIER, n) if n > len(_UP) else _UP[:n]
    down = powers(pow(_MULTIPLIER, -1, 1 << 64), n + 1) if n + 1 > len(_DOWN) else _DOWN[: n + 1]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * up, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_runs(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray):
    """Maximal runs of the marked bytes within each text: (starts, ends, text of each run).

    ``inside`` marks bytes by value; a run never crosses the bound of a text.
    """
    marked = inside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = marked[:-1]
    starts = np.flatnonzero(marked & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = marked[1:]
    ends = np.flatnonzero(marked & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def quoted(name: str) -> str:
    """A column's name, which may hold dots, as an expression."""
    return "`" + name.replace("`", "``") + "`"


def fingerprint(doc_id: Column, text: Column) -> Column:
    """64 bits that tell the texts of rows of one id apart, and rows without an id from those with one."""
    return F.xxhash64(text, doc_id.isNull())


def fold(doc_id: Column, parts: int) -> Column:
    """The remainder of crc32 of an id written as text; null for a null id."""
    return F.crc32(doc_id.cast("string")) % parts


def labelled_sample(
    df: DataFrame, labels: DataFrame, label: str, per_label: int, doc_id: str = "doc_id", text: str = "text"
) -> list[tuple[str, object]]:
    """(text, label) of at most ``per_label`` rows of each label, the same on every run.

    ``labels`` holds ``doc_id`` and the label. Ids are chosen from it by their hash, before
    any text is read: for each label the smallest hashes, which a partial aggregate keeps within each task.
    So the labels are read twice and the texts once, for any number of labels. What is broadcast and what comes to the driver is bounded by
    ``64 * per_label`` rows: more than 64 labels share them evenly, and more labels than
    these rows are an error. Of several texts under one chosen id, all are read, and the smallest hashes stay.
    """
    given = labels.where(F.col(quoted(label)).isNotNull() & F.col(quoted(doc_id)).isNotNull()).select(
        F.col(quoted(doc_id)).alias("_id"), F.col(quoted(label)).alias("_label")
    )
    most = 64 * per_label
    found_labels = given.select("_label").distinct().limit(most + 1).collect()
    if len(found_labels) > most:
        raise ValueError(f"more than {most} labels: {label}")
    per_label = min(per_label, most // max(1, len(found_labels)))

    def smallest(rows: DataFrame, *by: Column) -> DataFrame:
        order = Window.partitionBy("_label").orderBy(*by)
        return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_label).drop("_rank")

    chosen = smallest(given.distinct(), F.xxhash64("_id"), F.col("_id"))
    value = F.col(quoted(text)).cast("string")
    read = df.where(value.isNotNull()).select(F.col(quoted(doc_id)).alias("_id"), value.alias("_text"))
    met = read.join(F.broadcast(chosen), "_id")
    hashed = smallest(met, F.xxhash64("_id"), F.col("_id"), F.xxhash64("_text"), F.col("_text"))
    rows = hashed.collect()
    order = {r["_label"]: [] for r in rows}
    for r in rows:
        order[r["_label"]].append((r["_id"], r["_text"]))
    return [(value, key) for key in sorted(order) for _, value in sorted(order[key])]
