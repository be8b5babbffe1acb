"""What the plans look like: scans pruned, shuffles reused, no all-pairs joins."""

import pytest

import __spark_entry__ as contract
from tallyframe import (
    design_variance,
    panel_flows,
    poststratify,
    rake,
    weighted_estimates,
)
from tallyframe.sources import scratch
from tallyframe.sources.tables import table
from tallyframe.plans.queries import QUERIES
from tests.compare import TESTDATA

FOLDER = str(TESTDATA / "sf0.001")


def executed(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_join_of_all_pairs_and_no_python(spark, name):
    plan = contract.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
    for step in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert step not in plan


def test_overall_totals_reuse_the_shuffle(spark):
    df = table(spark, FOLDER, "orders").selectExpr("1.0D as w", "o_totalprice", "o_orderpriority")
    plan = weighted_estimates(df, "w", "o_totalprice", "o_orderpriority")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text[: text.rindex("== Initial Plan ==")]
    assert "ReusedExchange" in final
    assert final.count("ReusedSubquery") >= 1


def test_variance_reads_the_rows_once(spark):
    df = table(spark, FOLDER, "lineitem").selectExpr(
        "1.0D as w", "l_quantity", "l_suppkey", "l_orderkey", "l_returnflag"
    )
    plan = executed(
        design_variance(df, "w", "l_quantity", "l_suppkey", "l_orderkey", "l_returnflag")
    )
    assert plan.count("FileScan") == 1
    columns = "l_orderkey:bigint,l_suppkey:bigint,l_quantity:double,l_returnflag:string"
    assert f"ReadSchema: struct<{columns}>" in plan


def test_small_controls_leave_the_rows_where_they_are(spark):
    df = table(spark, FOLDER, "customer").selectExpr("c_custkey", "c_mktsegment", "1.0D as w")
    controls = df.groupBy("c_mktsegment").count().withColumnRenamed("count", "control")
    for fitted in (
        poststratify(df, "w", "c_mktsegment", controls),
        rake(df, "w", [controls]),
    ):
        plan = fitted.select("c_custkey", fitted.columns[-1])
        assert "SortMergeJoin LeftOuter" not in executed(plan)


def test_filters_reach_the_scan(spark):
    df = table(spark, FOLDER, "lineitem").selectExpr("1.0D as w", "l_quantity", "l_returnflag")
    est = weighted_estimates(df, "w", "l_quantity", "l_returnflag").where("l_returnflag = 'A'")
    plan = est._jdf.queryExecution().executedPlan().toString()
    # The overall total is of all groups, so only the main scan is filtered.
    assert plan.count("EqualTo(l_returnflag,A)") == 1
    share = est.first().share_n
    assert 0 < share < 1


def test_sizes_are_measured(spark, rows, monkeypatch):
    df = rows("a string, b int", ("x" * 100, 1), (None, 2))
    table, small = scratch.written_and_measured(df)
    assert small
    assert set(table.collect()) == set(df.collect())
    monkeypatch.setattr(scratch, "BROADCAST_LIMIT_BYTES", 100)
    assert not scratch.written_and_measured(df)[1]


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf(dict):
        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session)
    Session.conf[scratch.SETTING] = "hdfs://x/shared/"
    assert scratch.shared_folder(Session) == "hdfs://x/shared"


def test_records_without_a_key_are_found_by_the_scan(spark):
    df = table(spark, FOLDER, "events").selectExpr(
        "user_id", "event_id as p", "event_type as s", "1.0D as w"
    )
    plan = panel_flows(df, "user_id", "p", "s", "w")._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [IsNull(user_id)]" in plan.toString()


def test_raking_reuses_its_tables_and_leaves_the_setting(spark, tmp_path):
    before = spark.conf.get(scratch.SETTING, None)
    rows = table(spark, FOLDER, "customer").selectExpr("c_custkey", "c_mktsegment", "c_nationkey", "1.0D + c_custkey % 3 as w")
    margins = [rows.groupBy(c).count().withColumnRenamed("count", "control") for c in ("c_mktsegment", "c_nationkey")]
    made = len(scratch._made)
    fitted = rake(rows, "w", margins, tol=1e-10)
    assert len(scratch._made) - made <= 7  # names, of which those in use hold a table
    assert fitted.count() == 150
    assert spark.conf.get(scratch.SETTING, None) == before
    assert scratch.release(spark) > 0
    assert scratch._made == []


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    class Session:
        conf = {"spark.master": "yarn", scratch.SETTING: "file:/tmp/x"}

    with pytest.raises(RuntimeError, match="one machine"):
        scratch.shared_folder(Session)


def test_joins_grow_with_the_margins(spark, monkeypatch):
    """Large cells: one margin to a job, with a join for each margin."""
    from tallyframe.operators import calibration

    seen = []
    monkeypatch.setattr(scratch, "BROADCAST_LIMIT_BYTES", 0)
    real = calibration.written
    monkeypatch.setattr(calibration, "written", lambda df, path=None: (seen.append(df), real(df, path))[1])
    df = spark.range(300).selectExpr("1.0D AS w", *[f"id % {k + 2} AS m{k}" for k in range(4)])
    margins = [df.groupBy(f"m{k}").count().withColumnRenamed("count", "control") for k in range(4)]
    rake(df, "w", margins, max_iter=3, tol=1.0)
    joins = {d._jdf.queryExecution().optimizedPlan().toString().count("Join ") for d in seen}
    assert max(joins) == 4
