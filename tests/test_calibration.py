import pytest
from pyspark.sql import functions as F

from tallyframe import RakingNotConverged, poststratify, rake
from tests.conftest import keyed

SCHEMA = "id int, a string, b string, w double"
DATA = [
    (1, "x", "p", 1.0),
    (2, "x", "q", 2.0),
    (3, "y", "p", 3.0),
    (4, "y", "q", 4.0),
    (5, "y", None, 2.0),
]


@pytest.fixture
def df(rows):
    return rows(SCHEMA, *DATA)


def test_cells_meet_their_controls(df, rows):
    controls = rows("a string, control double", ("x", 30.0), ("y", 18.0))
    found = keyed(poststratify(df, "w", "a", controls).select("id", "w_post"), "id")
    assert {k: v["w_post"] for k, v in found.items()} == {
        1: 10.0, 2: 20.0, 3: 6.0, 4: 8.0, 5: 4.0,
    }


def test_null_cell_has_its_control(df, rows):
    controls = rows("b string, control int", ("p", 8), ("q", 6), (None, 5))
    found = keyed(poststratify(df, "w", "b", controls).select("id", "w_post"), "id")
    assert found[5]["w_post"] == 5.0
    assert found[1]["w_post"] == 2.0


def test_weightless_rows_stay_without_weight(rows):
    df = rows(SCHEMA, (1, "x", "p", 2.0), (2, "x", "p", 0.0), (3, "z", "p", None))
    controls = rows("a string, control double", ("x", 6.0))
    found = keyed(poststratify(df, "w", "a", controls).select("id", "w_post"), "id")
    assert [found[i]["w_post"] for i in (1, 2, 3)] == [6.0, None, None]


@pytest.mark.parametrize(
    "controls, message",
    [
        ([("x", 1.0), ("y", 1.0), ("z", 1.0)], "control without sample: a=z"),
        ([("x", 1.0)], "sampled cell without a control: a=y"),
        ([("x", 1.0), ("y", 1.0), ("y", 2.0)], "repeated control: a=y"),
        ([("x", 1.0), ("y", -1.0)], "unusable control: a=y"),
        ([("x", 1.0), ("y", None)], "unusable control: a=y"),
    ],
)
def test_controls_that_do_not_fit(df, rows, controls, message):
    table = rows("a string, control double", *controls)
    with pytest.raises(Exception, match=message):
        poststratify(df, "w", "a", table).select("w_post").collect()


def test_join_is_the_same_when_controls_are_not_small(df, rows, monkeypatch):
    from tallyframe.sources import scratch

    controls = rows(
        "a string, b string, control double",
        ("x", "p", 5.0), ("x", "q", 6.0), ("y", "p", 7.0), ("y", "q", 8.0), ("y", None, 9.0),
    )
    small = poststratify(df, "w", ["a", "b"], controls).collect()
    monkeypatch.setattr(scratch, "BROADCAST_LIMIT_BYTES", 0)
    large = poststratify(df, "w", ["a", "b"], controls).collect()
    assert sorted(small) == sorted(large)


def test_raked_margins_meet_their_controls(df, rows):
    margins = [
        rows("a string, control double", ("x", 20.0), ("y", 40.0)),
        rows("control double, b string", (25.0, "p"), (30.0, "q"), (5.0, None)),
    ]
    fitted = rake(df, "w", margins, tol=1e-9).cache()
    for column, expected in (
        ("a", {"x": 20.0, "y": 40.0}), ("b", {"p": 25.0, "q": 30.0, None: 5.0}),
    ):
        found = keyed(fitted.groupBy(column).agg(F.sum("w_raked").alias("t")), column)
        assert {k: v["t"] for k, v in found.items()} == pytest.approx(expected)
    # Raking keeps the odds ratio of the starting weights.
    w = {r.id: r.w_raked for r in fitted.collect()}
    assert w[1] * w[4] / (w[2] * w[3]) == pytest.approx(1.0 * 4.0 / (2.0 * 3.0))


def test_raking_is_the_same_when_margins_are_not_small(spark, df, rows, monkeypatch):
    from tallyframe.sources import scratch

    margins = [
        rows("a string, control double", ("x", 20.0), ("y", 40.0)),
        rows("b string, control double", ("p", 25.0), ("q", 30.0), (None, 5.0)),
    ]
    small = keyed(rake(df, "w", margins).select("id", "w_raked"), "id")
    monkeypatch.setattr(scratch, "BROADCAST_LIMIT_BYTES", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = keyed(rake(df, "w", margins).select("id", "w_raked"), "id")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for i, row in small.items():
        assert large[i]["w_raked"] == pytest.approx(row["w_raked"], rel=1e-12)


def test_cells_above_the_size_for_one_task_stay_distributed(df, rows, monkeypatch):
    from tallyframe.operators import calibration

    margins = [
        rows("a string, control double", ("x", 20.0), ("y", 40.0)),
        rows("b string, control double", ("p", 25.0), ("q", 30.0), (None, 5.0)),
    ]
    together = keyed(rake(df, "w", margins).select("id", "w_raked"), "id")
    monkeypatch.setattr(calibration, "_raked_in_memory", None)
    apart = keyed(rake(df, "w", margins, one_task_bytes=0).select("id", "w_raked"), "id")
    for i, row in together.items():
        assert apart[i]["w_raked"] == pytest.approx(row["w_raked"], rel=1e-12)


def test_margins_on_several_columns_and_more_margins_than_one_job_fits(spark, rows):
    df = spark.range(4000).select(
        *[((F.hash("id", F.lit(i)) % 3 + 3) % 3).alias(f"m{i}") for i in range(5)],
        (1 + F.col("id") % 4).cast("double").alias("w"),
    )
    margins = [df.groupBy(f"m{i}").agg(F.count("*").alias("control")) for i in range(4)]
    margins.append(df.groupBy("m3", "m4").agg(F.count("*").alias("control")))
    fitted = rake(df, "w", margins, tol=1e-8)
    for margin in margins:
        cols = [c for c in margin.columns if c != "control"]
        totals = fitted.groupBy(*cols).agg(F.sum("w_raked").alias("t"))
        gap = totals.join(margin, cols).agg(F.max(F.abs(F.col("t") / F.col("control") - 1)))
        assert gap.first()[0] < 1e-7


def test_inconsistent_margins_report_the_gap(df, rows):
    margins = [
        rows("a string, control double", ("x", 20.0), ("y", 40.0)),
        rows("b string, control double", ("p", 50.0), ("q", 60.0), (None, 10.0)),
    ]
    with pytest.raises(RakingNotConverged, match="margin a is off its control by a relative 1"):
        rake(df, "w", margins, max_iter=3)


@pytest.mark.parametrize(
    "controls, message",
    [
        ([("x", 1.0), ("y", 1.0), ("z", 1.0)], "control without sample: a=z"),
        ([("x", 1.0)], "sampled cell without a control: a=y"),
    ],
)
def test_margins_that_do_not_fit(df, rows, controls, message):
    with pytest.raises(Exception, match=message):
        rake(df, "w", [rows("a string, control double", *controls)])


@pytest.mark.parametrize("one_task", [True, False])
def test_a_total_that_falls_to_zero_is_an_error_on_both_paths(rows, one_task, monkeypatch):
    from tallyframe.sources import scratch

    if not one_task:
        monkeypatch.setattr(scratch, "BROADCAST_LIMIT_BYTES", 0)
    df = rows("a string, b string, w double", ("x", "p", 1.0), ("y", "p", 1.0), ("y", "q", 1.0))
    margins = [
        rows("a string, control double", ("x", 10.0), ("y", 40.0)),
        rows("b string, control double", ("p", 0.0), ("q", 50.0)),
    ]
    with pytest.raises(Exception, match="control without sample: a=x"):
        rake(df, "w", margins)


def test_zero_control_empties_its_category(df, rows):
    margins = [
        rows("a string, control double", ("x", 0.0), ("y", 40.0)),
        rows("b string, control double", ("p", 20.0), ("q", 15.0), (None, 5.0)),
    ]
    found = keyed(rake(df, "w", margins).select("id", "w_raked"), "id")
    weights = {k: v["w_raked"] for k, v in found.items()}
    assert weights == pytest.approx({1: 0.0, 2: 0.0, 3: 20.0, 4: 15.0, 5: 5.0})


def test_margins_without_columns(df, rows):
    with pytest.raises(ValueError, match="margins"):
        rake(df, "w", [rows("control double", (3.0,))])
    with pytest.raises(ValueError, match="cell column"):
        poststratify(df, "w", [], rows("control double", (3.0,)))
