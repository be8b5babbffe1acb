import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe import weighted_quantile
from tallyframe.operators import quantile
from tallyframe.sources import scratch
from tests.conftest import keyed

PROBS = [0, 0.07, 0.25, 0.5, 0.9, 1]


def brute_force(pairs, p):
    """Walk up the sorted values until the share is reached."""
    pairs = sorted((y, w) for y, w in pairs if y is not None and w)
    total, cum = sum(w for _, w in pairs), 0
    for y, w in pairs:
        cum += w
        if cum >= Decimal(str(p)) * total:
            return y
    return None


def answers(df):
    return {k: v["quantile"] for k, v in keyed(df, "g", "prob").items()}


def test_tie_on_the_boundary_takes_the_lower_value(rows):
    df = rows("g string, w int, y double", ("a", 1, 10.0), ("a", 1, 20.0))
    assert answers(weighted_quantile(df, "w", "y", [0.5], "g")) == {("a", 0.5): 10.0}


def test_decimal_weights_keep_ties_exact(rows):
    df = rows(
        "g string, w decimal(6,2), y int",
        *[("a", Decimal("0.10"), i) for i in range(1, 101)],
    )
    found = answers(weighted_quantile(df, "w", "y", [0.07, 0.29, 0.57], "g"))
    assert found == {("a", 0.07): 7, ("a", 0.29): 29, ("a", 0.57): 57}


def test_groups_without_usable_rows_are_kept(rows):
    df = rows(
        "g string, w int, y double",
        ("a", 1, 10.0), ("b", 0, 5.0), ("c", 2, None), (None, 4, 7.0), (None, None, 1.0),
    )
    found = answers(weighted_quantile(df, "w", "y", [0.5], "g"))
    assert found == {
        ("a", 0.5): 10.0, ("b", 0.5): None, ("c", 0.5): None, (None, 0.5): 7.0,
    }


def test_no_groups_at_all(rows):
    df = rows("w int, y double", (1, 3.0), (1, 1.0), (2, 2.0))
    found = weighted_quantile(df, "w", "y", [0, 0.5, 1]).collect()
    assert sorted((r.prob, r.quantile) for r in found) == [(0, 1.0), (0.5, 2.0), (1, 3.0)]


def test_bad_probability():
    with pytest.raises(ValueError):
        weighted_quantile(None, "w", "y", [1.5])


@pytest.fixture
def many_ranges(spark):
    """Many small ranges, so that one group and its quantiles spread over several."""
    settings = {
        "spark.sql.shuffle.partitions": "23",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def hot_data(values):
    rng = random.Random(7)
    data = []
    for _ in range(6000):
        g = "hot" if rng.random() < 0.6 else rng.choice([None, "b", "c", "d"])
        y = values[0] if rng.random() < 0.4 else rng.choice(values)
        data.append((g, rng.choice([None, 0, 1, 2, 5]), y))
    return data + [("empty", 0, values[0]), ("empty", 1, None)]


def expected(data):
    groups = {g for g, _, _ in data}
    return {
        (g, float(p)): brute_force([(y, w) for k, w, y in data if k == g], p)
        for g in groups
        for p in PROBS
    }


@pytest.mark.parametrize("kind", ["int", "decimal(9,2)", "double"])
@pytest.mark.parametrize("path", ["slots", "ranges within slots", "ranges"])
def test_equals_brute_force_with_a_hot_group_and_a_hot_value(
    spark, many_ranges, monkeypatch, kind, path
):
    if path == "ranges within slots":
        monkeypatch.setattr(quantile, "RANGE_ROWS", 700)
        monkeypatch.setattr(quantile, "SLOTS_PER_LOG_UNIT", 1)
    if path == "ranges":
        monkeypatch.setattr(scratch, "BROADCAST_LIMIT_BYTES", 0)
    data = hot_data([50.0, None, *[i / 4 - 60 for i in range(900)]])
    df = spark.createDataFrame(data, "g string, w int, y double")
    df = df.withColumn("w", F.col("w").cast(kind))
    assert answers(weighted_quantile(df, "w", "y", PROBS, "g")) == expected(data)


def test_values_that_are_not_numbers(spark, many_ranges):
    data = hot_data([date(2024, 1, 1), None, *[date(2000 + i, 1, 1) for i in range(60)]])
    df = spark.createDataFrame(data, "g string, w int, y date")
    assert answers(weighted_quantile(df, "w", "y", PROBS, "g")) == expected(data)


@pytest.mark.parametrize("path", ["slots", "ranges within slots"])
def test_uneven_double_weights(spark, many_ranges, monkeypatch, path):
    if path == "ranges within slots":
        monkeypatch.setattr(quantile, "RANGE_ROWS", 700)
        monkeypatch.setattr(quantile, "SLOTS_PER_LOG_UNIT", 1)
    rng = random.Random(5)
    data = [("a", rng.random() / 3, rng.lognormvariate(3, 2)) for _ in range(5000)]
    df = spark.createDataFrame(data, "g string, w double, y double")
    found = answers(weighted_quantile(df, "w", "y", [0.013, 0.5, 1], "g"))
    pairs = sorted((y, w) for _, w, y in data)
    total = sum(w for _, w in pairs)
    for p in (0.013, 0.5, 1):
        cum = 0
        for y, w in pairs:
            cum += w
            if cum >= p * total * (1 - 1e-12):
                break
        assert found["a", p] == y


def test_extreme_values_are_in_order(rows):
    inf, nan = float("inf"), float("nan")
    values = [-inf, -1e308, -5.0, -0.0, 1e-300, 7.0, 1e308, inf, nan]
    df = rows("w int, y double", *[(1, y) for y in reversed(values)])
    probs = [(i + 1) / len(values) for i in range(len(values) - 1)]
    probs = [round(p - 0.01, 4) for p in probs]
    found = {r.prob: r.quantile for r in weighted_quantile(df, "w", "y", probs).collect()}
    assert [found[p] for p in probs] == values[:-1]


def test_without_broadcast_the_answers_are_the_same(spark, rows, monkeypatch):
    df = rows("g string, w int, y int", *[("ab"[i % 2], 1 + i % 3, i) for i in range(200)])
    small = answers(weighted_quantile(df, "w", "y", PROBS, "g"))
    monkeypatch.setattr(scratch, "BROADCAST_LIMIT_BYTES", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert answers(weighted_quantile(df, "w", "y", PROBS, "g")) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("times", [1, 40, 900])
def test_double_weights_tie_alike_at_every_size(spark, monkeypatch, times):
    """Tenths are not exact as doubles; their sums must still meet half the total."""
    monkeypatch.setattr(quantile, "RANGE_ROWS", 1000)
    data = [(0.1, y) for y in (1, 2)] * times + [(0.3, 3), (0.3, 4)] * times
    df = spark.createDataFrame(data, "w double, y int").withColumn("w", F.col("w") * 1e-6)
    found = {r.prob: r.quantile for r in weighted_quantile(df, "w", "y", [0.125, 0.25, 0.625]).collect()}
    assert found == {0.125: 1, 0.25: 2, 0.625: 3}


def test_times_are_searched_by_day(spark):
    df = spark.sql("SELECT 1 AS w, timestamp_ntz'2024-01-01' + make_dt_interval(0, id) AS y FROM range(2000)")
    found = weighted_quantile(df, "w", "y", [0.5])
    first = df.orderBy("y").collect()[999]
    assert found.first()["quantile"] == first["y"]
