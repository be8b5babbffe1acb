"""Weights adjusted so that estimates agree with known totals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import label, names, ratio, same_keys, weight
from tallyframe.sources.scratch import new_path, written, written_and_measured


# Totals that one job takes when the cells are few.
WINDOWS_PER_JOB = 24


class RakingNotConverged(RuntimeError):
    """Raking stopped at ``max_iter`` with a margin still off its control."""


@dataclass(frozen=True)
class Margin:
    """A factor per category of ``cols``, and whether the table may be broadcast."""

    cols: list[str]
    table: DataFrame
    small: bool


def poststratify(
    df: DataFrame,
    w: str,
    cells: str | Sequence[str],
    controls: DataFrame,
    control: str = "control",
    out: str = "w_post",
) -> DataFrame:
    """Scale the weights so that each cell sums to its known total.

    ``controls`` has one row per cell: the ``cells`` columns and ``control``.
    Returns ``df`` with the new weight in ``out``, NULL where the weight is null
    or zero. A sampled cell without a control, a positive control without sample,
    a repeated cell and a null or negative control are errors.

    There is one factor per control. The controls are written once to the shared
    folder. When their measured size allows it the factors are broadcast, so the
    microdata are not shuffled; otherwise the join is Spark's, which splits a hot
    cell.
    """
    cells = names(cells)
    if not cells:
        raise ValueError("post-stratification needs at least one cell column")
    wanted, small = written_and_measured(_controls(controls, cells, control))
    sampled = (
        df.select(*cells, weight(df, w).alias("__w"))
        .groupBy(*cells)
        .agg(F.sum("__w").alias("__total"))
        .where(F.col("__total").isNotNull())
    )
    known = F.col("c.__control").isNotNull()
    cell = {k: F.coalesce(F.col(f"c.`{k}`"), F.col(f"s.`{k}`")) for k in cells}
    factor = F.when(
        ~known,
        F.raise_error(F.concat(F.lit("sampled cell without a control: "), label(cell))),
    ).otherwise(_scaled(F.lit(1.0), F.col("c.__control"), F.col("s.__total"), cell))
    factors = (
        wanted.alias("c")
        .join(sampled.alias("s"), same_keys(cells, "c", "s"), "full_outer")
        .select(
            *[col.alias(k) for k, col in cell.items()],
            "c.__control",
            factor.alias("__factor"),
        )
    )
    return _reweighted(df, w, [Margin(cells, factors, small)], out)


def rake(
    df: DataFrame,
    w: str,
    margins: Sequence[DataFrame],
    tol: float = 1e-6,
    max_iter: int = 50,
    control: str = "control",
    out: str = "w_raked",
    one_task_bytes: int | None = None,
) -> DataFrame:
    """Scale the weights until every margin sums to its known totals.

    Each of ``margins`` has one row per category: ``control`` and the margin's
    own columns, which are also columns of ``df``. Returns ``df`` with the new
    weight in ``out``. Fitting ends when the worst relative gap between a fitted
    and a known total is at most ``tol``, and raises :class:`RakingNotConverged`
    after ``max_iter`` rounds. Controls are checked as in :func:`poststratify`.

    The rows are read twice: once to sum them to cells, once for the result. The
    rounds work on the cells and change only one factor per category, written to
    the shared folder each time, in a job of its own per margin, whose plan has one join per
    margin. Cells that were measured to be few enough to broadcast are fitted in one task
    instead, several rounds to a job; ``one_task_bytes`` lowers that size, and 0 keeps all cells
    distributed. A margin whose measured size allows it is broadcast, and then neither cells nor
    rows are shuffled by it.
    """
    columns = [[c for c in m.columns if c != control] for m in margins]
    if not all(columns) or not columns:
        raise ValueError("raking needs margins, each with a column beside its control")
    dims = list(dict.fromkeys(c for cols in columns for c in cols))
    cells, few = written_and_measured(
        df.select(*dims, weight(df, w).alias("__w"))
        .groupBy(*dims)
        .agg(F.sum("__w").cast("double").alias("__base"))
        .where(F.col("__base").isNotNull()),
        limit=one_task_bytes,
    )
    # Two tables for each margin take turns: the next factors are written while these are read.
    paths = [[new_path(df.sparkSession) for _ in range(2)] for _ in margins]
    fitted = [
        _starting_margin(cells, _controls(m, cols, control), cols, own[1])
        for m, cols, own in zip(margins, columns, paths)
    ]
    if few:
        return _raked_in_memory(df, w, cells, fitted, tol, max_iter, out)
    for turn in range(max_iter):
        moved = 0.0
        for k in range(len(fitted)):
            fitted[k], gap = _refitted(cells, fitted, k, paths[k][turn % 2])
            moved = max(moved, gap)
        # Each gap was seen before the margins after it were fitted: look again.
        if moved <= tol and _worst_gap(cells, fitted)[0] <= tol:
            return _reweighted(df, w, fitted, out)
    worst, k = _worst_gap(cells, fitted)
    raise _not_converged(max_iter, columns[k], worst)


def _not_converged(rounds: int, columns: Sequence[str], gap: float) -> RakingNotConverged:
    return RakingNotConverged(
        f"after {rounds} rounds the margin {', '.join(columns)} "
        f"is off its control by a relative {gap:.3g}"
    )


def _controls(controls: DataFrame, keys: list[str], control: str) -> DataFrame:
    """One checked row per key, with the known total as ``__control``."""
    key = label({k: F.col(k) for k in keys})
    total = F.col("__control")
    return (
        controls.groupBy(*keys)
        .agg(
            F.count("*").alias("__rows"),
            F.sum(F.col(control).cast("double")).alias("__control"),
        )
        .select(
            *keys,
            F.when(F.col("__rows") > 1, F.raise_error(F.concat(F.lit("repeated control: "), key)))
            .when(
                total.isNull() | F.isnan(total) | (total < 0),
                F.raise_error(F.concat(F.lit("unusable control: "), key)),
            )
            .otherwise(total)
            .alias("__control"),
        )
    )


def _scaled(factor: Column, control: Column, total: Column, key: dict[str, Column]) -> Column:
    """The factor after fitting ``total`` to ``control``."""
    empty = total.isNull() | (total == 0)
    message = F.concat(F.lit("control without sample: "), label(key))
    return (
        F.when(empty & (control > 0), F.raise_error(message))
        .when(empty, 0.0)
        .otherwise(factor * ratio(control, total))
    )


def _attached(left: DataFrame, margins: Sequence[Margin]) -> DataFrame:
    """``left`` with the columns ``__control<k>`` and ``__factor<k>`` of each margin."""
    for k, margin in enumerate(margins):
        table = F.broadcast(margin.table) if margin.small else margin.table
        left = (
            left.alias("l")
            .join(table.alias("r"), same_keys(margin.cols, "l", "r"), "left")
            .select(
                "l.*",
                F.col("r.__control").alias(f"__control{k}"),
                F.col("r.__factor").alias(f"__factor{k}"),
            )
        )
    return left


def _product(margins: Sequence[Margin]) -> Column:
    return reduce(
        lambda a, b: a * b, [F.col(f"__factor{k}") for k in range(len(margins))]
    )


def _reweighted(df: DataFrame, w: str, margins: Sequence[Margin], out: str) -> DataFrame:
    rows = _attached(df.withColumn("__w", weight(df, w)), margins)
    return rows.select(
        *[F.col(f"`{c}`") for c in df.columns],
        (F.col("__w") * _product(margins)).alias(out),
    )


def _starting_margin(cells: DataFrame, controls: DataFrame, cols: list[str], path: str) -> Margin:
    """Factors of one, once every positive control has been found in the sample."""
    sampled = cells.groupBy(*cols).agg(F.sum("__base").alias("__total"))
    factor = _scaled(
        F.lit(1.0),
        F.col("c.__control"),
        F.col("t.__total"),
        {c: F.col(f"c.`{c}`") for c in cols},
    )
    table, small = written_and_measured(
        controls.alias("c")
        .join(sampled.alias("t"), same_keys(cols, "c", "t"), "left")
        .select("c.*", F.when(factor >= 0, 1.0).alias("__factor")),
        path,
    )
    return Margin(cols, table, small)


def _raked_in_memory(
    df: DataFrame,
    w: str,
    cells: DataFrame,
    margins: Sequence[Margin],
    tol: float,
    max_iter: int,
    out: str,
) -> DataFrame:
    """As :func:`rake`, for cells whose measured size lets one task hold them.

    The rounds and the rule for ending are the same; a job runs several rounds and keeps
    the weights after each, and the first round that ended it counts.
    """
    dims = [c for c in cells.columns if c != "__base"]
    controls = [f"__control{k}" for k in range(len(margins))]
    paths = [new_path(df.sparkSession) for _ in range(2)]
    fitted = written(_fitted_cells(cells, margins).select(*dims, "__base", *controls, "__fit"), paths[0])
    totals = [F.sum("__fit").over(Window.partitionBy(*m.cols)) for m in margins]
    per_job = max(1, WINDOWS_PER_JOB // (2 * len(margins)))
    done, turn, ended, gaps = 0, 0, None, [float("inf")] * len(margins)
    while done < max_iter and ended is None:
        rounds = range(min(per_job, max_iter - done))
        table = fitted.coalesce(1)
        for r in rounds:
            for k, (control, total) in enumerate(zip(controls, totals)):
                table = table.withColumn("__total", total)
                table = table.withColumn(f"__moved{r}_{k}", _gap(control))
                key = label({c: F.col(c) for c in margins[k].cols})
                message = F.concat(F.lit("control without sample: "), key)
                empty = F.col("__total") == 0
                scaled = (
                    F.when(empty & (F.col(control) > 0), F.raise_error(message))
                    .when(empty, 0.0)
                    .otherwise(F.col("__fit") * F.col(control) / F.col("__total"))
                )
                table = table.withColumn("__fit", scaled)
            for k, (control, total) in enumerate(zip(controls, totals)):
                table = table.withColumn("__total", total).withColumn(f"__gap{r}_{k}", _gap(control))
            table = table.withColumn(f"__fit{r}", F.col("__fit"))
        seen = Observation()
        measured = [f"__{what}{r}_{k}" for what in ("moved", "gap") for r in rounds for k in range(len(margins))]
        turn = 1 - turn
        kept = written(
            table.observe(seen, *[F.max(m).alias(m) for m in measured]).select(
                *dims, "__base", *controls, *[f"__fit{r}" for r in rounds]
            ),
            paths[turn],
        )
        found = {name: value or 0.0 for name, value in seen.get.items()}
        gaps = [found[f"__gap{rounds[-1]}_{k}"] for k in range(len(margins))]
        ended = next(
            (
                r
                for r in rounds
                if all(found[f"__{what}{r}_{k}"] <= tol for what in ("moved", "gap") for k in range(len(margins)))
            ),
            None,
        )
        last = rounds[-1] if ended is None else ended
        fitted = kept.select(*dims, "__base", *controls, F.col(f"__fit{last}").alias("__fit"))
        done += len(rounds)
    if ended is None:
        worst = max(range(len(gaps)), key=gaps.__getitem__)
        raise _not_converged(max_iter, margins[worst].cols, gaps[worst])
    rows = df.withColumn("__w", weight(df, w)).alias("l")
    joined = rows.join(F.broadcast(fitted.alias("r")), same_keys(dims, "l", "r"), "left")
    return joined.select(
        *[F.col(f"l.`{c}`") for c in df.columns],
        (F.col("l.__w") * F.col("r.__fit") / F.col("r.__base")).alias(out),
    )


def _fitted_cells(cells: DataFrame, margins: Sequence[Margin]) -> DataFrame:
    """The cells with every margin's control and factor, and the fitted weight ``__fit``."""
    message = F.concat(
        F.lit("sampled cell without a control: "),
        label({c: F.col(c) for c in cells.columns if c != "__base"}),
    )
    fit = F.when(_product(margins).isNull(), F.raise_error(message)).otherwise(
        F.col("__base") * _product(margins)
    )
    return _attached(cells, margins).withColumn("__fit", fit)


def _gap(name: str = "__control") -> Column:
    control, total = F.col(name), F.col("__total")
    return F.coalesce(ratio(F.abs(total - control), control), total)


def _refitted(
    cells: DataFrame, margins: Sequence[Margin], k: int, path: str
) -> tuple[Margin, float]:
    """Margin k fitted to its controls, and the largest gap that it had just before."""
    cols = margins[k].cols
    totals = (
        _fitted_cells(cells, margins)
        .select(
            *cols,
            F.col(f"__control{k}").alias("__control"),
            F.col(f"__factor{k}").alias("__factor"),
            "__fit",
        )
        .groupBy(*cols, "__control", "__factor")
        .agg(F.sum("__fit").alias("__total"))
        .withColumn("__gap", _gap())
    )
    key = {c: F.col(c) for c in cols}
    factor = _scaled(F.col("__factor"), F.col("__control"), F.col("__total"), key)
    seen = Observation()
    table = written(
        totals.withColumn("__factor", factor)
        .observe(seen, F.max("__gap").alias("gap"))
        .select(*cols, "__control", "__factor"),
        path,
    )
    return Margin(cols, table, margins[k].small), seen.get["gap"] or 0.0


def _worst_gap(cells: DataFrame, margins: Sequence[Margin]) -> tuple[float, int]:
    """Largest relative gap over all categories, and the margin it is in.

    The factors are attached once; each cell then gives a row to every margin, with its
    category as a hash and the control.
    """
    places = [
        F.struct(
            F.lit(k).alias("__margin"),
            F.xxhash64(F.lit(k), *m.cols).alias("__category"),
            F.col(f"__control{k}").alias("__control"),
        )
        for k, m in enumerate(margins)
    ]
    worst = (
        _fitted_cells(cells, margins)
        .select("__fit", F.inline(F.array(*places)))
        .groupBy("__margin", "__category", "__control")
        .agg(F.sum("__fit").alias("__total"))
        .withColumn("__gap", _gap())
        .agg(F.max("__gap").alias("gap"), F.max_by("__margin", "__gap").alias("margin"))
        .first()
    )
    return worst["gap"] or 0.0, worst["margin"] or 0
