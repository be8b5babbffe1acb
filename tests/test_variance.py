import math
import random
from itertools import product

import pytest

from tallyframe import design_variance, ratio_variance, replicate_variance
from tests.conftest import keyed

SCHEMA = "h string, c int, d string, w double, y double, x double"


def variance_of(units, lonely):
    """Stratified variance of a total from {stratum: [PSU totals, zeros included]}."""
    everything = [z for zs in units.values() for z in zs]
    center = sum(everything) / len(everything)
    v = 0.0
    for zs in units.values():
        n = len(zs)
        if n > 1:
            mean = sum(zs) / n
            v += n / (n - 1) * sum((z - mean) ** 2 for z in zs)
        elif lonely == "center":
            v += (zs[0] - center) ** 2
    return v


def brute_force(data, domain, value, lonely="zero"):
    frame = {(h, c) for h, c, _, w, _, _ in data if w}
    totals = {unit: 0.0 for unit in frame}
    for row in data:
        h, c, d, w, _, _ = row
        if w and (domain is None or d == domain) and value(row) is not None:
            totals[h, c] += w * value(row)
    units = {}
    for (h, c), z in totals.items():
        units.setdefault(h, []).append(z)
    return variance_of(units, lonely)


def sample(seed, lonely=False):
    rng = random.Random(seed)
    data = []
    for h, c in product("pqrs", range(6)):
        for _ in range(rng.randrange(1, 9)):
            d = rng.choice("AAAAB") if c % 3 else "A"
            data.append(
                (h, c, d, rng.choice([None, 0.0, 1.0, 2.5]), rng.choice([None, rng.gauss(100, 9)]),
                 rng.choice([None, rng.gauss(50, 5)]))
            )
        data.append((h, c, "A", 1.0, 100.0 + c, 50.0))
    if lonely:
        data.append(("solo1", 1, "A", 2.0, 30.0, 10.0))
        data.append(("solo2", 1, "B", 3.0, 40.0, 10.0))
    return data


def test_psu_without_a_case_counts_as_zero(rows):
    df = rows(SCHEMA, ("h", 1, "A", 1.0, 10.0, 1.0), ("h", 2, "B", 1.0, 4.0, 1.0))
    found = keyed(design_variance(df, "w", "y", "h", "c", "d"), "d")
    # PSU totals 10 and 0: 2 * var(10, 0) = 2 * 50.
    assert found["A"]["variance"] == pytest.approx(100.0)
    assert found["B"]["variance"] == pytest.approx(16.0)


@pytest.mark.parametrize("lonely", ["zero", "center"])
@pytest.mark.parametrize("seed", [1, 2])
def test_total_equals_brute_force(rows, lonely, seed):
    data = sample(seed, lonely=True)
    df = rows(SCHEMA, *data)
    found = keyed(design_variance(df, "w", "y", "h", "c", "d", lonely_psu=lonely), "d")
    for d in "AB":
        assert found[d]["variance"] == pytest.approx(
            brute_force(data, d, lambda r: r[4], lonely), rel=1e-10
        )
    overall = design_variance(df, "w", "y", "h", "c", lonely_psu=lonely).first()
    assert overall.variance == pytest.approx(
        brute_force(data, None, lambda r: r[4], lonely), rel=1e-10
    )
    assert overall.se == pytest.approx(math.sqrt(overall.variance))
    assert overall.cv == pytest.approx(overall.se / overall.y_hat)


@pytest.mark.parametrize("lonely", ["zero", "center"])
def test_ratio_equals_variance_of_linearized_total(rows, lonely):
    data = sample(3, lonely=True)
    found = keyed(
        ratio_variance(rows(SCHEMA, *data), "w", "y", "x", "h", "c", "d", lonely), "d"
    )
    for d in "AB":
        used = [r for r in data if r[2] == d and r[3] and None not in (r[4], r[5])]
        den = sum(r[3] * r[5] for r in used)
        ratio = sum(r[3] * r[4] for r in used) / den

        def residual(r):
            return None if None in (r[4], r[5]) else (r[4] - ratio * r[5]) / den

        assert found[d]["ratio_hat"] == pytest.approx(ratio)
        assert found[d]["variance"] == pytest.approx(
            brute_force(data, d, residual, lonely), rel=1e-8
        )


def test_constant_ratio_has_no_variance(rows):
    df = rows(SCHEMA, *[("h", c, "A", 1.0 + c, 0.3 * c, 0.1 * c) for c in range(1, 9)])
    found = ratio_variance(df, "w", "y", "x", "h", "c").first()
    assert found.ratio_hat == pytest.approx(3.0)
    assert found.se == pytest.approx(0.0, abs=1e-7)


def test_single_psu_fails_by_default_and_is_named(rows):
    df = rows(SCHEMA, *sample(1, lonely=True))
    with pytest.raises(Exception, match="stratum with a single PSU: h=solo"):
        design_variance(df, "w", "y", "h", "c", "d").collect()


def test_weightless_rows_do_not_put_a_psu_in_the_sample(rows):
    df = rows(
        SCHEMA,
        ("h", 1, "A", 1.0, 10.0, 1.0),
        ("h", 2, "A", 1.0, 20.0, 1.0),
        ("h", 3, "A", 0.0, 99.0, 1.0),
        ("h", None, "A", None, 99.0, 1.0),
    )
    found = design_variance(df, "w", "y", "h", "c", "d").first()
    assert found.variance == pytest.approx(2 * 50.0)


def test_stratum_without_sample_adds_nothing(rows):
    df = rows(
        SCHEMA,
        ("h", 1, "A", 1.0, 10.0, 1.0),
        ("h", 2, "A", 1.0, 20.0, 2.0),
        ("k", 1, "A", 0.0, 99.0, 1.0),
        ("k", 2, "A", None, 99.0, 1.0),
    )
    assert design_variance(df, "w", "y", "h", "c", "d").first().variance == pytest.approx(100.0)
    found = ratio_variance(df, "w", "y", "x", "h", "c", lonely_psu="center").first()
    assert found.variance == pytest.approx(0.0, abs=1e-12)


def test_group_may_be_the_stratum(rows):
    df = rows(SCHEMA, ("h", 1, "A", 1.0, 10.0, 1.0), ("h", 2, "A", 1.0, 20.0, 2.0))
    found = keyed(design_variance(df, "w", "y", "h", "c", "h"), "h")
    assert found["h"]["variance"] == pytest.approx(100.0)


def test_missing_measure_keeps_the_psu(rows):
    df = rows(
        SCHEMA,
        ("h", 1, "A", 1.0, 10.0, 1.0),
        ("h", 2, "A", 1.0, 20.0, 1.0),
        ("h", 3, "A", 1.0, None, 1.0),
    )
    found = design_variance(df, "w", "y", "h", "c", "d").first()
    assert found.variance == pytest.approx(variance_of({"h": [10.0, 20.0, 0.0]}, "zero"))


def test_missing_design_column_is_an_error(rows):
    df = rows(SCHEMA, ("h", 1, "A", 1.0, 1.0, 1.0), (None, 2, "A", 1.0, 1.0, 1.0))
    with pytest.raises(Exception, match="design column h is NULL"):
        design_variance(df, "w", "y", "h", "c", "d").collect()


def test_group_without_weight_is_null_and_kept(rows):
    df = rows(
        SCHEMA,
        ("h", 1, "A", 1.0, 10.0, 1.0),
        ("h", 2, "A", 1.0, 20.0, 1.0),
        ("h", 2, "Z", 0.0, 20.0, 1.0),
    )
    found = keyed(design_variance(df, "w", "y", "h", "c", "d"), "d")
    assert set(found["Z"].values()) == {None}


def test_unknown_lonely_psu(rows):
    with pytest.raises(ValueError, match="lonely_psu"):
        design_variance(rows(SCHEMA), "w", "y", "h", "c", lonely_psu="ignore")


def test_replicates(rows):
    df = rows(
        "d string, w double, r1 double, r2 double, y double",
        ("A", 1.0, 2.0, 0.0, 10.0),
        ("A", 1.0, 0.0, 2.0, 14.0),
        ("A", 1.0, 1.0, 1.0, None),
        ("B", 1.0, 0.0, None, 5.0),
    )
    found = keyed(replicate_variance(df, "w", "y", ["r1", "r2"], "d", 0.5), "d")
    assert found["A"]["y_hat"] == 24.0
    assert found["A"]["variance"] == pytest.approx(0.5 * (4.0**2 + 4.0**2))
    # Neither replicate has weight in B: both estimate zero.
    assert found["B"]["variance"] == pytest.approx(0.5 * 2 * 5.0**2)


def test_many_replicates(spark):
    from pyspark.sql import functions as F

    count = 200
    names = [f"r{i}" for i in range(count)]
    df = spark.range(1000).withColumns(
        {"w": F.lit(1.0), "y": F.col("id").cast("double")}
    ).withColumns({n: F.lit(1.0 + (i % 2) / 10) for i, n in enumerate(names)})
    found = replicate_variance(df, "w", "y", names, scale=1 / count).first()
    assert found.y_hat == 499500.0
    assert found.variance == pytest.approx(0.5 * 49950.0**2)


def test_rows_without_weight_add_no_replicate(rows):
    df = rows(
        "w double, y double, r0 double, r1 double",
        (1.0, 10.0, 1.0, 1.0), (None, 5.0, 7.0, 7.0), (0.0, 9.0, 8.0, 3.0),
    )
    assert replicate_variance(df, "w", "y", ["r0", "r1"]).first().variance == 0


def test_replicates_in_batches_equal_one_pass(spark, monkeypatch):
    from tallyframe.operators import variance

    df = spark.range(500).selectExpr("id % 3 AS g", "1.0D AS w", "CAST(id AS DOUBLE) AS y",
                                     *[f"IF(id % 50 = {r}, 0D, 1.1D) AS r{r}" for r in range(50)])
    names = [f"r{r}" for r in range(50)]
    batched = {r.g: r.variance for r in replicate_variance(df, "w", "y", names, "g").collect()}
    monkeypatch.setattr(variance, "REPLICATES_PER_BATCH", 100)
    whole = {r.g: r.variance for r in replicate_variance(df, "w", "y", names, "g").collect()}
    assert batched == pytest.approx(whole, rel=1e-12)


def test_a_replicate_weight_of_nan_is_an_error(rows):
    df = rows("w double, y double, r0 double", (1.0, 1.0, float("nan")))
    with pytest.raises(Exception, match="r0 holds NaN"):
        replicate_variance(df, "w", "y", ["r0"]).collect()


def test_nearly_proportional_ratio_keeps_its_digits(spark):
    """Residuals of 1e-7 of the values, against the direct form."""
    data = [(1.0, 1e6 * i + (-1) ** i * 0.05 * i, 1e6 * i, i % 2, i) for i in range(1, 41)]
    df = spark.createDataFrame(data, "w double, a double, b double, s int, p int")
    found = ratio_variance(df, "w", "a", "b", "s", "p").first()
    total_a, total_b = sum(r[1] for r in data), sum(r[2] for r in data)
    direct = 0.0
    for s in (0, 1):
        e = [a - total_a / total_b * b for _, a, b, k, _ in data if k == s]
        mean = sum(e) / len(e)
        direct += len(e) / (len(e) - 1) * sum((x - mean) ** 2 for x in e)
    assert found.variance == pytest.approx(direct / total_b**2, rel=1e-6)


def test_unstratified_design_has_no_window(spark):
    df = spark.range(3000).selectExpr("1.0D AS w", "CAST(id AS DOUBLE) AS y", "id % 700 AS p", "id % 90 AS g")
    found = design_variance(df, "w", "y", [], "p", "g")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 90
