"""Weighted totals, means, shares, ratios and crosstabs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import names, number, ratio, weight


def weighted_estimates(
    df: DataFrame, w: str, y: str, by: str | Sequence[str] | None = None
) -> DataFrame:
    """Estimated count, total, mean and share of the overall total per group.

    Returns ``by`` plus ``n_hat``, ``y_hat``, ``mean_hat``, ``share_n`` and
    ``share_y``. A group without usable rows is kept, with NULL estimates.

    The overall totals come from a one-row scalar subquery over the same
    aggregate. It asks for the same sums as the main query, so Spark runs the
    scan and the shuffle once and reuses them.
    """
    by = names(by)
    usable = F.when(df[y].isNotNull(), weight(df, w))
    sums = (
        df.select(*by, usable.alias("__w"), (usable * number(df, y)).alias("__wy"))
        .groupBy(*by)
        .agg(F.sum("__w").alias("n_hat"), F.sum("__wy").alias("y_hat"))
    )
    overall = sums.agg(
        F.struct(F.sum("n_hat").alias("n"), F.sum("y_hat").alias("y"))
    ).scalar()
    return sums.select(
        *by,
        "n_hat",
        "y_hat",
        ratio(F.col("y_hat"), F.col("n_hat")).alias("mean_hat"),
        ratio(F.col("n_hat"), overall["n"]).alias("share_n"),
        ratio(F.col("y_hat"), overall["y"]).alias("share_y"),
    )


def weighted_ratio(
    df: DataFrame,
    w: str,
    num: str,
    den: str,
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Ratio of two weighted totals per group, such as a rate.

    A row counts only if both ``num`` and ``den`` are present. Returns ``by``
    plus ``num_hat``, ``den_hat`` and ``ratio_hat``.
    """
    by = names(by)
    usable = F.when(df[num].isNotNull() & df[den].isNotNull(), weight(df, w))
    sums = (
        df.select(
            *by, (usable * number(df, num)).alias("__num"), (usable * number(df, den)).alias("__den")
        )
        .groupBy(*by)
        .agg(F.sum("__num").alias("num_hat"), F.sum("__den").alias("den_hat"))
    )
    return sums.withColumn("ratio_hat", ratio(F.col("num_hat"), F.col("den_hat")))


def weighted_crosstab(df: DataFrame, w: str, dims: str | Sequence[str]) -> DataFrame:
    """Weighted counts for every combination of ``dims`` and every subtotal.

    Returns ``dims`` plus ``gid`` and ``n_hat``. ``gid`` has one bit per
    dimension, the first dimension highest; a set bit means the dimension is
    summed over. It tells a subtotal from a category that is NULL.

    Rows are summed to cells first, so the cube multiplies cells, not rows. A table without
    rows has a grand total, which is NULL.
    """
    dims = names(dims)
    cells = (
        df.select(*dims, weight(df, w).alias("__w"))
        .groupBy(*dims)
        .agg(F.sum("__w").alias("__cell"))
    )
    total = F.sum("__cell").alias("n_hat")
    parts = (
        cells.cube(*dims)
        .agg(F.grouping_id().cast("int").alias("gid"), total)
        .select(*dims, "gid", "n_hat")
    )
    if not dims:
        return parts
    # The cube of no rows has no grand total; a plain aggregate has one.
    all_over = (1 << len(dims)) - 1
    grand = cells.agg(total).select(
        *[F.lit(None).cast(df.schema[d].dataType).alias(d) for d in dims],
        F.lit(all_over).alias("gid"),
        "n_hat",
    )
    return parts.where(F.col("gid") != all_over).unionByName(grand)
