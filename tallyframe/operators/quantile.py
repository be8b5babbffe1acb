"""Exact weighted quantiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import is_floating, names, same_keys, weight
from tallyframe.sources.scratch import written, written_and_measured

# A slot spans about half a percent of the values in it.
SLOTS_PER_LOG_UNIT = 200
# Rows for each range of the values that are sorted.
RANGE_ROWS = 1_000_000
# Decimal digits to which double weights count, from the largest one's first.
WEIGHT_DIGITS = 15

FIRST_SLOT, LAST_SLOT = -(2**63), 2**63 - 1


def weighted_quantile(
    df: DataFrame,
    w: str,
    y: str,
    probs: Sequence[float],
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Smallest ``y`` whose cumulative weight reaches share ``p`` of the group.

    Returns one row per group and probability: ``by``, ``prob``, ``quantile``.
    A group without usable rows is kept, with NULL quantiles. Weights are added exactly,
    so ties at ``p`` are exact and the answer is the same however the rows are spread.
    Double weights count to 15 decimal digits of the largest one, whose size takes a scan of
    the weights; what is below that counts as zero.

    No group is brought together in one task. A first scan sums the weights per
    group and slot, a narrow band of values or a day; the running sum over the slots tells
    the one slot that holds each quantile. A second scan keeps only the rows of
    those slots. Their values are range-partitioned into as many ranges as their number
    takes, and written, and the same search runs over the ranges. Values that are neither
    numbers nor times have one slot.
    """
    by = names(by)
    probs = [Decimal(str(p)) for p in probs]
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probs must lie between 0 and 1")
    integral = isinstance(df.schema[w].dataType, T.IntegralType)

    def targets() -> list[Column]:
        found = [F.col("__whole") * F.lit(p) for p in probs]
        return [F.ceil(t).cast("decimal(38,0)") for t in found] if integral else found

    usable = F.when(df[y].isNotNull(), _exact(df, w))
    rows = df.select(
        *by, usable.alias("__w"), F.when(usable.isNotNull(), df[y]).alias("__y")
    )
    # The hash stands in for the group in joins, where a group may be NULL.
    group_hash = F.xxhash64(*by) if by else F.lit(0)
    rows = rows.withColumn("__group", group_hash.cast("bigint"))
    rows = rows.withColumn("__slot", _slot(df.schema[y].dataType))
    group = ["__group", *by]

    slots = rows.groupBy(*group, "__slot").agg(
        F.sum("__w").alias("__part"), F.count("*").alias("__rows")
    )
    seen = Observation()
    held = F.sum(F.when(~F.col("__empty"), F.col("__rows"))).alias("rows")
    hits, few = written_and_measured(
        _holding(_running(slots, group, "__slot"), targets()).observe(seen, held)
    )
    found = F.broadcast(hits) if few else hits
    values = (
        rows.alias("r")
        .join(found.alias("h"), _same(by, ["__slot"]), "left_semi")
        .groupBy(*group, "__slot", "__y")
        .agg(F.sum("__w").alias("__w"))
    )
    ranges = _ranges(values, by, 1 + (seen.get["rows"] or 0) // RANGE_ROWS)
    parts = ranges.groupBy(*group, "__slot", "__range").agg(F.sum("__w").alias("__part"))
    # The sums start over in each slot; put what came before the slot in front.
    start = F.coalesce("h.__before", F.lit(0))
    names_of_targets = _target_names(probs)
    inside = (
        _running(parts, [*group, "__slot"], "__range")
        .alias("r")
        .join(found.alias("h"), _same(by, ["__slot"]))
        .select(
            *[F.col(f"r.`{k}`") for k in [*group, "__slot", "__range"]],
            F.coalesce(start + F.col("r.__before"), F.col("h.__before")).alias("__before"),
            (start + F.col("r.__so_far")).alias("__so_far"),
            (start + F.col("r.__whole")).alias("__whole"),
            *[f"h.{t}" for t in names_of_targets],
        )
    )
    within, few = written_and_measured(_holding(inside, [F.col(t) for t in names_of_targets]))
    return _answers(ranges, within, few, by, ["__slot", "__range"], probs)


def _exact(df: DataFrame, w: str) -> Column:
    """The weight as a number whose sums are exact: doubles in units of their last digit."""
    usable = weight(df, w)
    if not is_floating(df, w):
        return usable
    largest = df.agg(F.max(usable)).first()[0]
    shift = WEIGHT_DIGITS - (math.floor(math.log10(largest)) + 1) if largest else 0
    scaled = F.round(usable.cast("double") * F.lit(10.0) ** F.lit(float(shift)))
    units = scaled.cast(f"decimal({WEIGHT_DIGITS + 1},0)")
    return F.when(units > 0, units)


def _slot(kind: T.DataType) -> Column:
    """A whole number that never falls as ``__y`` rises."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        day = F.unix_date(F.col("__y").cast("date")).cast("bigint")
        return F.when(F.col("__y").isNull(), FIRST_SLOT).otherwise(day)
    if not isinstance(kind, T.NumericType):
        return F.lit(0).cast("bigint")
    value = F.col("__y").cast("double")
    log = F.signum(value) * F.log1p(F.abs(value))
    return (
        F.when(value.isNull(), FIRST_SLOT)
        .when(F.isnan(value), LAST_SLOT)
        .otherwise(F.floor(log * SLOTS_PER_LOG_UNIT))
    )


def _ranges(values: DataFrame, by: list[str], count: int) -> DataFrame:
    """Range-partitioned values; writing them fixes the range each belongs to."""
    ranged = values.repartitionByRange(count, *by, "__y")
    return written(ranged.withColumn("__range", F.spark_partition_id()))


def _running(parts: DataFrame, group: list[str], order: str) -> DataFrame:
    """Cumulative weight before, up to and after all of each part of a group."""
    in_order = Window.partitionBy(*group).orderBy(order)
    part = F.sum("__part")
    return parts.withColumns(
        {
            "__before": part.over(in_order.rowsBetween(Window.unboundedPreceding, -1)),
            "__so_far": part.over(
                in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
            "__whole": part.over(
                in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        }
    )


def _holding(running: DataFrame, targets: list[Column]) -> DataFrame:
    """The parts in which the cumulative weight reaches a target, and which.

    ``__before`` is NULL until some weight has been seen. A group without weight
    keeps all its parts.
    """
    reached = {
        f"__target{i}": F.when(
            (F.col("__so_far") >= target)
            & (F.col("__before").isNull() | (F.col("__before") < target)),
            target,
        )
        for i, target in enumerate(targets)
    }
    return (
        running.select(
            *[c for c in running.columns if c not in {*reached, "__part", "__so_far"}],
            *[target.alias(name) for name, target in reached.items()],
        )
        .withColumn("__empty", F.col("__whole").isNull())
        .drop("__whole")
        .where(F.coalesce(*reached).isNotNull() | F.col("__empty"))
    )


def _answers(
    values: DataFrame,
    hits: DataFrame,
    few: bool,
    by: list[str],
    place: list[str],
    probs: list[Decimal],
) -> DataFrame:
    """Sort the values of the places found and pick the first past each target."""
    targets = _target_names(probs)
    hits = F.broadcast(hits) if few else hits
    in_place = (
        Window.partitionBy("__group", *place, *by)
        .orderBy("__y")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = (
        values.alias("r")
        .join(hits.alias("h"), _same(by, place))
        .select("r.*", "h.__before", *[f"h.{t}" for t in targets])
        .withColumn(
            "__cum", F.coalesce("__before", F.lit(0)) + F.sum("__w").over(in_place)
        )
    )
    found = running.groupBy(*by).agg(
        *[_first_reaching(t).alias(f"__answer{i}") for i, t in enumerate(targets)]
    )
    answers = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("prob"), F.col(f"__answer{i}").alias("quantile")
            )
            for i, p in enumerate(probs)
        ]
    )
    return found.select(*by, F.inline(answers))


def _first_reaching(target: str) -> Column:
    """Smallest value at or past the target."""
    return F.min(F.when(F.col("__cum") >= F.col(target), F.col("__y")))


def _target_names(probs: list[Decimal]) -> list[str]:
    return [f"__target{i}" for i in range(len(probs))]


def _same(by: list[str], place: list[str]) -> Column:
    """Equality of group and place between ``r`` and ``h``."""
    same = F.lit(True)
    for k in ["__group", *place]:
        same = same & (F.col(f"r.{k}") == F.col(f"h.{k}"))
    return same & same_keys(by, "r", "h") if by else same
