"""Changes of estimates over periods, and flows of panel units between them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import label, names, ratio, weight

PERIODS_PER_BLOCK = 64


def period_change(
    df: DataFrame, est: str, p: str, by: str | Sequence[str] | None = None, season: int = 4
) -> DataFrame:
    """Change of an estimate on the previous period and on the same season.

    ``df`` has one row per group and period ordinal ``p``; a repeated or null
    period is an error. Returns ``by``, ``p`` and ``est`` plus ``change_prev``,
    ``rel_prev``, ``change_year`` and ``rel_year``, all NULL where the period to
    compare with is missing.

    The frames look up the period by its value, not by its position, so gaps
    need no filling and one shuffle serves every comparison. A group is in one task, and
    all rows are if there is no ``by``: they are as many as there are periods.
    """
    by = names(by)
    periods = Window.partitionBy(*by).orderBy(p)
    keys = {**{k: F.col(k) for k in by}, p: F.col(p)}
    repeated = F.count("*").over(periods.rangeBetween(0, 0)) > 1
    message = F.concat(F.lit("repeated or null period: "), label(keys))
    looked_up = df.select(
        *by,
        p,
        F.when(repeated | F.col(p).isNull(), F.raise_error(message))
        .otherwise(F.col(est))
        .alias(est),
        F.first(est).over(periods.rangeBetween(-1, -1)).alias("__prev"),
        F.first(est).over(periods.rangeBetween(-season, -season)).alias("__year"),
    )
    changes = []
    for name in ("prev", "year"):
        change = F.col(est) - F.col(f"__{name}")
        changes.append(change.alias(f"change_{name}"))
        changes.append(ratio(change, F.col(f"__{name}")).alias(f"rel_{name}"))
    return looked_up.select(*by, p, est, *changes)


def panel_flows(
    df: DataFrame, key: str | Sequence[str], p: str, state: str, w: str
) -> DataFrame:
    """Weighted flows between states from each period to the next.

    Returns ``p``, ``kind``, ``from_state``, ``to_state``, ``n`` and ``n_hat``,
    where ``p`` is the period of arrival. ``kind`` is ``stay`` for a unit seen in
    both periods, ``entry`` for one not seen in the period before and ``exit`` for
    one not seen in the period after; so the first period holds only entries, and
    the period after the last only exits. A flow has the weight of the earlier
    record, an entry its own. A repeated key in a period is an error. A record
    with a NULL in its key cannot be linked, and counts as entry and as exit.

    Records are sorted within a unit and a block of periods. A block holds each
    period once, so no task receives more than one block of one unit, however
    long its history. NULL keys take no part in that shuffle.
    """
    key = names(key)
    period = F.col("__p")
    no_period = F.raise_error(F.lit(f"period column {p} is NULL on a row with weight"))
    sampled = (
        df.select(
            *key,
            df[p].cast("bigint").alias("__p"),
            df[state].alias("__state"),
            weight(df, w).alias("__w"),
        )
        .where(F.col("__w").isNotNull())
        .withColumn("__p", F.when(period.isNull(), no_period).otherwise(period))
    )
    unlinkable = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])

    # The arrival in p is judged in the block of p, the exit from p in that of p + 1.
    block = period - F.pmod(period, F.lit(PERIODS_PER_BLOCK))
    following = period + 1 - F.pmod(period + 1, F.lit(PERIODS_PER_BLOCK))
    here = F.struct(
        block.alias("__block"),
        F.lit(True).alias("__arrives"),
        (block == following).alias("__leaves"),
    )
    beyond = F.struct(
        following.alias("__block"),
        F.lit(False).alias("__arrives"),
        F.lit(True).alias("__leaves"),
    )
    places = F.when(block == following, F.array(here)).otherwise(F.array(here, beyond))
    unit = Window.partitionBy(*key, "__block").orderBy("__p")
    repeated = F.raise_error(
        F.concat(
            F.lit("repeated panel key: "),
            label({**{k: F.col(k) for k in key}, p: period}),
        )
    )
    linked = (
        sampled.where(~unlinkable)
        .select("*", F.inline(places))
        .select(
            "__p",
            "__state",
            "__w",
            "__arrives",
            "__leaves",
            F.when(F.lag("__p").over(unit) == period, repeated)
            .otherwise(F.lag("__p").over(unit) == period - 1)
            .alias("__seen_before"),
            F.lag("__state").over(unit).alias("__before"),
            F.lag("__w").over(unit).alias("__w_before"),
            (F.lead("__p").over(unit) == period + 1).alias("__seen_after"),
        )
    )
    unlinked = sampled.where(unlinkable).select(
        "__p",
        "__state",
        "__w",
        F.lit(True).alias("__arrives"),
        F.lit(True).alias("__leaves"),
        F.lit(False).alias("__seen_before"),
        F.lit(None).cast(df.schema[state].dataType).alias("__before"),
        F.lit(None).cast(df.schema[w].dataType).alias("__w_before"),
        F.lit(False).alias("__seen_after"),
    )

    def flow(kind, arrival, before, after, flow_weight):
        return F.struct(
            arrival.alias(p),
            F.lit(kind).alias("kind"),
            before.alias("from_state"),
            after.alias("to_state"),
            flow_weight.alias("__flow"),
        )

    here_state = F.col("__state")
    nothing = F.lit(None).cast(df.schema[state].dataType)
    seen_before = F.coalesce("__seen_before", F.lit(False))
    seen_after = F.coalesce("__seen_after", F.lit(False))
    stay = flow("stay", period, F.col("__before"), here_state, F.col("__w_before"))
    entry = flow("entry", period, nothing, here_state, F.col("__w"))
    leave = flow("exit", period + 1, here_state, nothing, F.col("__w"))
    flows = F.array_compact(
        F.array(
            F.when(F.col("__arrives"), F.when(seen_before, stay).otherwise(entry)),
            F.when(F.col("__leaves") & ~seen_after, leave),
        )
    )
    return (
        linked.unionByName(unlinked)
        .select(F.inline(flows))
        .groupBy(p, "kind", "from_state", "to_state")
        .agg(F.count("*").alias("n"), F.sum("__flow").alias("n_hat"))
    )
