"""Quality rules kept as a ledger of failure bits and measurements."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import texts

#: What is measured of a text, in the order of the ledger's columns.
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_upper",
    "n_marks",
)
WINDOW = 5


def _rules() -> list[tuple[str, Column]]:
    """Name and failure of each rule; its place is its bit. Append only: bits are stored."""
    c = F.col
    return [
        ("few_words", c("n_words") < 10),
        ("repeated_words", 100 * c("n_repeat_words") > 20 * c("n_words")),
        ("short_words", c("word_chars") < 2 * c("n_words")),
        ("long_words", c("word_chars") > 15 * c("n_words")),
        ("symbols", 100 * c("n_symbols") > 25 * c("n_words")),
        ("repeated_lines", 100 * c("n_dup_lines") > 30 * c("n_lines")),
        ("upper_case", 100 * c("n_upper") > 50 * c("word_chars")),
        ("exclamations", 100 * c("n_marks") > 50 * c("n_words")),
    ]


RULES = ("few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines", "upper_case", "exclamations")

#: Rules that each version of the policy rejects by.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines"),
    "v2": RULES,
}
CURRENT = "v2"


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of :data:`MEASURES`."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    symbols = len(joined) - len(joined.translate(None, b"#*$%&|<>"))
    upper = len(joined) - len(joined.translate(None, bytes(range(65, 91))))
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in text.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            if line in seen:
                duplicates += 1
            seen.add(line)
    repeated = 0
    if n >= WINDOW:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            upto = 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + WINDOW - max(i, upto)
                    upto = i + WINDOW
    return n, chars, symbols, lines, duplicates, repeated, upper, text.count(b"!")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in texts(batches, "text"):
        raw, cut = data.tobytes(), bounds.tolist()
        found = [measure(raw[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        columns = [pa.array(x, pa.int64()) for x in zip(*found, strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=["doc_id", *MEASURES])


def ledger(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements of every text and a bit for each rule that it fails.

    Every rule is evaluated once, here; policies, ablations and new versions read the
    ledger and never the texts. Words are runs of bytes other than blank, tab, line
    feed, vertical tab, form feed and carriage return. One pass over the rows, no shuffle.

    A null text has no words and fails ``few_words``, as an empty one does; a null id stays
    null; repeated rows are judged each. Only the two named columns are read.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    bits = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(_rules()):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return rows.mapInArrow(_measured, schema).withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``kept``: no bit of the policy is set."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects.

    One aggregate over the bits; a row per rule. ``kept_without`` is what the policy
    would keep if the rule were dropped. No rows give zeros.
    """
    own = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    parts = [
        F.struct(
            F.lit(r).alias("rule"),
            F.lit(1 << RULES.index(r)).cast("long").alias("bit"),
            count(own.bitwiseAND(F.lit(1 << RULES.index(r))) != 0).alias("n_failed"),
            count(own == F.lit(1 << RULES.index(r))).alias("n_only"),
            count((own == 0) | (own == F.lit(1 << RULES.index(r)))).alias("kept_without"),
        )
        for r in POLICIES[policy]
    ]
    return rows.agg(F.array(*parts).alias("rules")).select(F.inline("rules"))
