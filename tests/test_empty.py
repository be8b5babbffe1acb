"""Every operator on a table without rows."""

import pytest

from tallyframe import (
    design_variance,
    panel_flows,
    period_change,
    poststratify,
    rake,
    ratio_variance,
    replicate_variance,
    weighted_crosstab,
    weighted_estimates,
    weighted_quantile,
    weighted_ratio,
)
from tallyframe.sources.scratch import written_and_measured

SCHEMA = "g string, h int, c int, p int, w double, y double, x double"


def filtered(spark):
    """Rows that only turn out to be none when the query runs."""
    df = spark.range(100).selectExpr(
        "'a' as g", "1 as h", "int(id) as c", "1 as p", "1.0D as w", "2.0D as y", "3.0D as x"
    )
    return df.where("c * 2 < c - 1000")


@pytest.fixture(params=["known", "at run time"])
def nothing(request, spark, rows):
    return rows(SCHEMA) if request.param == "known" else filtered(spark)


def test_grouped_results_have_no_rows(nothing):
    results = [
        weighted_estimates(nothing, "w", "y", "g"),
        weighted_ratio(nothing, "w", "y", "x", "g"),
        weighted_quantile(nothing, "w", "y", [0.5], "g"),
        design_variance(nothing, "w", "y", "h", "c", "g", "center"),
        ratio_variance(nothing, "w", "y", "x", "h", "c", "g"),
        replicate_variance(nothing, "w", "y", ["w"], "g"),
        period_change(nothing, "y", "p", "g"),
        panel_flows(nothing, "c", "p", "g", "w"),
    ]
    assert [df.count() for df in results] == [0] * len(results)


def test_overall_results_are_null(nothing):
    for df in (
        weighted_estimates(nothing, "w", "y"),
        weighted_ratio(nothing, "w", "y", "x"),
        design_variance(nothing, "w", "y", "h", "c"),
        ratio_variance(nothing, "w", "y", "x", "h", "c", lonely_psu="center"),
        replicate_variance(nothing, "w", "y", ["w"]),
    ):
        (row,) = df.collect()
        assert set(row) == {None}
    assert weighted_crosstab(nothing, "w", ["g"]).where("gid = 1 and n_hat > 0").count() == 0


def test_calibration(nothing, rows):
    none = rows("g string, control double")
    assert poststratify(nothing, "w", "g", none).count() == 0
    assert rake(nothing, "w", [none]).count() == 0
    some = rows("g string, control double", ("a", 1.0))
    with pytest.raises(Exception, match="control without sample: g=a"):
        rake(nothing, "w", [some])


def test_measured_size(nothing):
    table, small = written_and_measured(nothing)
    assert small
    assert table.count() == 0
