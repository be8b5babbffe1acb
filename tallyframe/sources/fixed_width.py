"""Microdata in fixed-width text files."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MALFORMED = "malformed"

# Encodings of one byte for each character that Spark's decode knows.
SINGLE_BYTE = ("US-ASCII", "ISO-8859-1")

# Characters that a cast skips at the end of a number.
BLANKS = "".join(map(chr, range(33)))

DECIMAL = re.compile(r"(?:decimal|dec|numeric)(?:\s*\(\s*\d+\s*(?:,\s*(\d+)\s*)?\))?")


@dataclass(frozen=True)
class Field:
    """One field of a layout; ``start`` counts characters from 1."""

    name: str
    start: int
    width: int
    type: str = "string"


def read_fixed_width(
    spark: SparkSession,
    path: str | list[str],
    layout: Sequence[Field],
    encoding: str | None = None,
) -> DataFrame:
    """Typed columns of fixed-width text, plus the names of malformed fields.

    A blank or missing field is NULL. A field that is not blank and does not fit
    its type is NULL and named in the array column ``malformed``: a value that the type
    could only hold rounded does not fit, nor does one that is cut by the end of its line,
    unless it is text.

    The text is UTF-8 unless ``encoding`` names one of :data:`SINGLE_BYTE`. Such a file must not be read as UTF-8: an accented letter would
    swallow the bytes after it and shift the fields.
    """
    if encoding is not None and encoding.upper() not in SINGLE_BYTE:
        raise ValueError(f"encoding must be one of {', '.join(SINGLE_BYTE)}, not {encoding}")
    lines = spark.read.text(path)
    length = F.length("value") if encoding is None else F.octet_length("value")

    def cut(field: Field) -> Column:
        if encoding is None:
            text = F.substring("value", field.start, field.width)
        else:
            octets = F.col("value").cast("binary")
            text = F.decode(F.substring(octets, field.start, field.width), encoding)
        return F.nullif(F.trim(text), F.lit(""))

    # Blank lines' ends may be missing, so only a value that reaches the end counts as cut.
    raw = lines.select(
        *[cut(f).alias(f.name) for f in layout],
        *[(length < f.start + f.width - 1).alias(f"__cut_{f.name}") for f in layout],
    )

    def read(field: Field) -> Column:
        text = F.col(f"`{field.name}`")
        value = text.try_cast(field.type)
        if field.type.strip().lower() in ("string", "varchar", "char"):
            return value
        kept = ~F.col(f"`__cut_{field.name}`")
        if decimal := DECIMAL.fullmatch(field.type.strip().lower()):
            # Plain digits are compared as text; with an exponent the values are.
            after = F.rtrim(F.substring_index(text, ".", -1), F.lit(BLANKS))
            decimals = F.when(F.contains(text, F.lit(".")), F.length(F.rtrim(after, F.lit("0")))).otherwise(0)
            kept = kept & F.when(
                F.lower(text).contains("e"), value.cast("double") == text.try_cast("double")
            ).otherwise(decimals <= int(decimal[1] or 0))
        return F.when(kept, value)

    typed = {f.name: read(f) for f in layout}
    bad = [
        F.when(F.col(f"`{name}`").isNotNull() & value.isNull(), F.lit(name))
        for name, value in typed.items()
    ]
    return raw.select(
        *[value.alias(name) for name, value in typed.items()],
        F.array_compact(F.array(*bad)).alias(MALFORMED),
    )


def malformed_counts(df: DataFrame) -> DataFrame:
    """Number of malformed values per field, for the fields that have any."""
    return (
        df.select(F.explode(MALFORMED).alias("field"))
        .groupBy("field")
        .agg(F.count("*").alias("n_malformed"))
    )
