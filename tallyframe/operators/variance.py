"""Standard errors of totals and ratios under a sample design."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import is_floating, label, names, number, ratio, same_keys, weight

LONELY_PSU = ("fail", "zero", "center")
# Replicates that one aggregate sums.
REPLICATES_PER_BATCH = 40


def design_variance(
    df: DataFrame,
    w: str,
    y: str,
    strata: str | Sequence[str],
    psu: str | Sequence[str],
    by: str | Sequence[str] | None = None,
    lonely_psu: str = "fail",
) -> DataFrame:
    """Estimated total per group with its standard error.

    The design is stratified, with PSUs nested in strata and drawn with
    replacement. Returns ``by`` plus ``y_hat``, ``variance``, ``se`` and ``cv``.
    A PSU in the sample without a case in a group counts as zero for it.

    ``lonely_psu`` says what a stratum with one PSU does: ``fail`` raises when the
    stratum is met, ``zero`` adds nothing, ``center`` measures the PSU from the
    mean PSU total of the whole sample. Rows with a null or zero weight are not in the sample and do not put
    their PSU there.
    """
    psus = _psu_totals(df, w, [number(df, y)], strata, psu, by, lonely_psu)
    parts = psus.spread(psus.table.withColumn("__e", F.col("__z0")))
    return parts.select(
        *names(by),
        F.col("__total0").alias("y_hat"),
        F.col("__v").alias("variance"),
        F.sqrt("__v").alias("se"),
        ratio(F.sqrt("__v"), F.abs("__total0")).alias("cv"),
    )


def ratio_variance(
    df: DataFrame,
    w: str,
    num: str,
    den: str,
    strata: str | Sequence[str],
    psu: str | Sequence[str],
    by: str | Sequence[str] | None = None,
    lonely_psu: str = "fail",
) -> DataFrame:
    """Estimated ratio per group with its linearized standard error.

    Returns ``by`` plus ``ratio_hat``, ``variance``, ``se`` and ``cv``. See
    :func:`design_variance` for the design and ``lonely_psu``.

    The linearized variance is that of the total of ``(num - r * den) / den_hat``.
    These residuals are linear in the totals, so they are formed of the totals of the
    PSUs, once the ratios are known, and the rows are read once.
    """
    both = df[num].isNotNull() & df[den].isNotNull()
    measures = [F.when(both, number(df, num)), F.when(both, number(df, den))]
    psus = _psu_totals(df, w, measures, strata, psu, by, lonely_psu)
    parts = psus.spread(psus.with_residuals())
    return parts.select(
        *names(by),
        ratio(F.col("__total0"), F.col("__total1")).alias("ratio_hat"),
        ratio(F.col("__v"), F.pow(F.col("__total1"), 2)).alias("variance"),
    ).select(
        "*",
        F.sqrt("variance").alias("se"),
        ratio(F.sqrt("variance"), F.abs("ratio_hat")).alias("cv"),
    )


def replicate_variance(
    df: DataFrame,
    w: str,
    y: str,
    replicate_cols: Sequence[str],
    by: str | Sequence[str] | None = None,
    scale: float = 1.0,
) -> DataFrame:
    """Estimated total per group with its standard error from replicate weights.

    The variance is ``scale`` times the sum over the replicates of the squared
    gap between the replicate's total and the full-sample total. Returns ``by``
    plus ``y_hat``, ``variance``, ``se`` and ``cv``.

    A row counts where its full weight does, whatever its replicate weights. Those may be
    negative, as some replication methods make them, but not NaN. The replicates are
    taken in batches of ``REPLICATES_PER_BATCH``, each a plain aggregate of the columns it
    needs: of more columns than that Spark compiles no aggregate. Nothing is exploded.
    """
    by = names(by)
    full = weight(df, w)

    def product(name: str) -> Column:
        value = number(df, name)
        if is_floating(df, name):
            message = F.lit(f"replicate weight column {name} holds NaN")
            value = F.when(F.isnan(value), F.raise_error(message)).otherwise(value)
        return F.when(full.isNotNull(), value * number(df, y))

    def batch(columns: Sequence[str]) -> DataFrame:
        sums = (
            df.select(*by, (full * number(df, y)).alias("__t0"), *[product(c).alias(f"__t{i}") for i, c in enumerate(columns, 1)])
            .groupBy(*by)
            .agg(*[F.sum(f"__t{i}").alias(f"__t{i}") for i in range(len(columns) + 1)])
        )
        total = F.col("__t0").cast("double")
        # A replicate without weight in a group estimates zero there.
        gaps = [
            F.pow(F.coalesce(F.col(f"__t{i}").cast("double"), F.lit(0.0)) - total, 2)
            for i in range(1, len(columns) + 1)
        ]
        return sums.select(*by, F.col("__t0").alias("y_hat"), reduce(lambda a, b: a + b, gaps, F.lit(0.0)).alias("__gaps"))

    step = REPLICATES_PER_BATCH
    parts = [batch(replicate_cols[i : i + step]) for i in range(0, max(len(replicate_cols), 1), step)]
    together = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        together = together.groupBy(*by).agg(F.first("y_hat").alias("y_hat"), F.sum("__gaps").alias("__gaps"))
    return (
        together.select(*by, "y_hat", (F.lit(float(scale)) * F.col("__gaps")).alias("variance"))
        .withColumn("se", F.sqrt("variance"))
        .withColumn("cv", ratio(F.col("se"), F.abs("y_hat")))
    )


@dataclass(frozen=True)
class _Psus:
    """Totals ``__z<i>`` of the measures per PSU and group, and whether the PSU is in the sample.

    Every use of the table reads all its columns, so that Spark runs the scan and the shuffle
    once for all of them.
    """

    table: DataFrame
    stratum: list[str]
    unit: list[str]
    by: list[str]
    z: list[str]
    lonely_psu: str

    def with_residuals(self) -> DataFrame:
        """The table with ``__e``, the first measure less its group's ratio times the second."""
        sums = [F.sum(F.when(F.col("__in"), F.col(c))).alias(f"__g{c}") for c in self.z]
        if not self.by:
            whole = self.table.agg(F.struct(*sums)).scalar()
            r = ratio(whole["__g__z0"], whole["__g__z1"])
            return self.table.withColumn("__e", F.col("__z0") - r * F.col("__z1"))
        groups = self.table.groupBy(*self.by).agg(*sums)
        r = ratio(F.col("g.__g__z0"), F.col("g.__g__z1"))
        joined = self.table.alias("p").join(groups.alias("g"), same_keys(self.by, "p", "g"))
        return joined.select("p.*", (F.col("p.__z0") - r * F.col("p.__z1")).alias("__e"))

    def sizes(self) -> DataFrame:
        """The number of sampled PSUs per stratum, ``__n``."""
        present = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in self.z], F.col("__in"))
        each = self.table.groupBy(*self.unit).agg(F.max(present).alias("__present"))
        return each.groupBy(*self.stratum).agg(F.sum(F.col("__present").cast("int")).alias("__n"))

    def spread(self, table: DataFrame) -> DataFrame:
        """Totals ``__total<i>`` per group and the variance ``__v`` of the total of ``__e``.

        The PSUs without a case in a group are never written out. With ``m`` PSU totals
        present out of ``n``, of mean ``a`` and population variance ``c``, adding
        ``n - m`` zeros makes the sum of squares ``m * c + m * (n - m) / n * a * a``.
        """
        by_stratum = table.groupBy(*self.stratum, *self.by).agg(
            F.count("__e").alias("__m"),
            *[F.sum(F.when(F.col("__in"), F.col(c))).alias(f"__sum{i}") for i, c in enumerate(self.z)],
            F.sum("__e").alias("__sum"),
            F.avg("__e").alias("__avg"),
            F.var_pop("__e").alias("__c"),
            F.sum(F.col("__e") * F.col("__e")).alias("__x"),
        )
        if self.stratum:
            sized = (
                by_stratum.alias("b")
                .join(self.sizes().alias("s"), same_keys(self.stratum, "b", "s"))
                .select("b.*", "s.__n")
            )
        else:
            sized = by_stratum.withColumn("__n", self.sizes().select("__n").scalar())

        n, m = F.col("__n"), F.col("__m")
        alone = F.lit(0.0)
        if self.lonely_psu == "fail":
            named = label({k.removeprefix("__s_"): F.col(k) for k in self.stratum})
            message = F.concat(F.lit("stratum with a single PSU: "), named)
            alone = F.raise_error(message).cast("double")
        absent = m * (n - m) / F.nullif(n, F.lit(0)) * F.col("__avg") * F.col("__avg")
        within = n / F.nullif(n - 1, F.lit(0)) * (m * F.col("__c") + absent)
        totals = sized.groupBy(*self.by).agg(
            *[F.sum(f"__sum{i}").alias(f"__total{i}") for i in range(len(self.z))],
            F.sum(F.when(n == 1, alone).when(n > 1, within)).alias("__v"),
            F.sum("__sum").alias("__total"),
            F.sum(F.when(n == 1, F.col("__sum"))).alias("__alone"),
            F.sum(F.when(n == 1, F.col("__x"))).alias("__alone_x"),
        )
        if self.lonely_psu == "center":
            totals = totals.withColumn("__v", self._centered())
        usable = F.col("__total0").isNotNull()
        return totals.withColumn("__v", F.when(usable, F.col("__v")))

    def _centered(self) -> Column:
        """The variance with the lonely PSUs' squares about the mean PSU total.

        A lonely PSU without a case in a group is a zero there and still counts, so the
        numbers of PSUs and of lonely strata are those of the whole sample.
        """
        frame = self.sizes().agg(
            F.struct(
                F.sum("__n").cast("double").alias("psus"),
                F.sum(F.when(F.col("__n") == 1, 1).otherwise(0)).alias("alone"),
            )
        ).scalar()
        center = F.col("__total") / F.nullif(frame["psus"], F.lit(0.0))
        zero = F.lit(0.0)
        return (
            F.coalesce(F.col("__v"), zero)
            + F.coalesce(F.col("__alone_x"), zero)
            - 2 * center * F.coalesce(F.col("__alone"), zero)
            + frame["alone"] * center * center
        )


def _psu_totals(
    df: DataFrame,
    w: str,
    measures: Sequence[Column],
    strata: str | Sequence[str],
    psu: str | Sequence[str],
    by: str | Sequence[str] | None,
    lonely_psu: str,
) -> _Psus:
    if lonely_psu not in LONELY_PSU:
        raise ValueError(f"lonely_psu must be one of {', '.join(LONELY_PSU)}")
    strata, psu, by = names(strata), names(psu), names(by)
    z = [f"__z{i}" for i in range(len(measures))]
    sampled = weight(df, w)
    rows = df.select(
        *[_design_key(df, sampled, k).alias(f"__s_{k}") for k in strata],
        *[_design_key(df, sampled, k).alias(f"__p_{k}") for k in psu],
        *by,
        sampled.isNotNull().alias("__in"),
        *[(sampled * m).alias(c) for m, c in zip(measures, z)],
    )
    stratum = [f"__s_{k}" for k in strata]
    unit = [*stratum, *[f"__p_{k}" for k in psu]]
    table = rows.groupBy(*unit, *by).agg(
        F.max("__in").alias("__in"),
        *[F.sum(c).cast("double").alias(c) for c in z],
    )
    return _Psus(table, stratum, unit, by, z, lonely_psu)


def _design_key(df: DataFrame, sampled: Column, name: str) -> Column:
    """A design column, which may not be NULL on a sampled row."""
    message = F.lit(f"design column {name} is NULL on a row with weight")
    missing = df[name].isNull() & sampled.isNotNull()
    return F.when(missing, F.raise_error(message)).otherwise(df[name])
