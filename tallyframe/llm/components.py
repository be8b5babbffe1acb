"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def _mark(links: DataFrame) -> tuple[int, int]:
    count, total = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return count, int(total or 0)


def _pointed(links: DataFrame, larger_only: bool) -> DataFrame:
    """Connect the neighbours of each node to the smallest of them and the node.

    ``links`` has both nodes as (a, b); all neighbours of a count for its smallest one, and
    with ``larger_only`` those larger than a are connected, else all and a itself.
    """
    least = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = links.join(least, "a")
    if larger_only:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))
    )


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): each linked node with the smallest node that it is connected to.

    ``links`` has columns a and b of integers. Large-star and small-star steps alternate
    until nothing changes; a node's links never meet in one list, and each round is written
    to the shared folder. A node without links has no row.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    now = written(ordered.distinct(), "links")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _pointed(both, True).where("a > b").distinct()
        small = _pointed(large, False).where("a > b").distinct()
        before, now = now, written(small, "links")
        dropped(before)
        was, mark = mark, _mark(now)
        if was == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
