"""Registered queries: each operator over whole tables.

The tables carry no survey weights, so a weight is made from the customer or
order key. Doubles are rounded at the end, because the last digits of a
distributed sum depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.calibration import poststratify, rake
from tallyframe.operators.estimates import (
    weighted_crosstab,
    weighted_estimates,
    weighted_ratio,
)
from tallyframe.operators.panel import panel_flows, period_change
from tallyframe.operators.quantile import weighted_quantile
from tallyframe.operators.variance import (
    design_variance,
    ratio_variance,
    replicate_variance,
)
from tallyframe.sources.fixed_width import Field, malformed_counts, read_fixed_width
from tallyframe.sources.scratch import new_path
from tallyframe.sources.tables import table

REPLICATES = 20
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
ORDER_LAYOUT = (
    Field("order_key", 1, 12, "bigint"),
    Field("customer_key", 13, 12, "bigint"),
    Field("status", 25, 1),
    Field("total_price", 26, 14, "decimal(12,2)"),
    Field("order_date", 40, 10, "date"),
    Field("priority", 50, 15),
)


def _weight(key: str):
    return (1 + F.col(key) % 3).cast("double")


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").withColumn("w", _weight("o_custkey"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumn("w", _weight("l_orderkey"))


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").withColumn("w", _weight("c_custkey"))


def _customer_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = _orders(spark, folder)
    customers = table(spark, folder, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey)


def _quarter(date: str):
    return F.year(date) * 4 + F.quarter(date)


def weighted_estimates_orders(spark: SparkSession, folder: str) -> DataFrame:
    est = weighted_estimates(_orders(spark, folder), "w", "o_totalprice", "o_orderpriority")
    return _rounded(est, y_hat=2, mean_hat=6, share_n=10, share_y=10)


def weighted_estimates_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Decimal inputs, so that sums are exact and the result needs no rounding."""
    lines = _lines(spark, folder).withColumns(
        {
            "w": F.col("w").cast("decimal(4,0)"),
            "l_extendedprice": F.col("l_extendedprice").cast("decimal(12,2)"),
        }
    )
    est = weighted_estimates(lines, "w", "l_extendedprice", "l_partkey")
    return est.withColumns({c: F.col(c).cast("double") for c in ("n_hat", "y_hat")})


def weighted_estimates_overall(spark: SparkSession, folder: str) -> DataFrame:
    est = weighted_estimates(_lines(spark, folder), "w", "l_quantity")
    return _rounded(est, y_hat=2, mean_hat=6, share_n=10, share_y=10)


def weighted_ratio_discount(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder).withColumn(
        "discount", F.col("l_extendedprice") * F.col("l_discount")
    )
    by = ["l_returnflag", "l_linestatus"]
    est = weighted_ratio(lines, "w", "discount", "l_extendedprice", by)
    return _rounded(est, num_hat=4, den_hat=2, ratio_hat=8)


def weighted_crosstab_orders(spark: SparkSession, folder: str) -> DataFrame:
    dims = ["c_mktsegment", "o_orderpriority", "o_orderstatus"]
    return weighted_crosstab(_customer_orders(spark, folder), "w", dims)


def weighted_quantile_price(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder).withColumn("w", 1 + F.col("l_orderkey") % 3)
    return weighted_quantile(lines, "w", "l_extendedprice", QUANTILES, "l_returnflag")


def weighted_quantile_quantity(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder).withColumn("w", 1 + F.col("l_orderkey") % 3)
    return weighted_quantile(lines, "w", "l_quantity", QUANTILES, "l_suppkey")


def weighted_quantile_dates(spark: SparkSession, folder: str) -> DataFrame:
    orders = _orders(spark, folder).withColumn("w", 1 + F.col("o_custkey") % 3)
    found = weighted_quantile(orders, "w", "o_orderdate", QUANTILES, "o_orderpriority")
    return found.withColumn("quantile", F.date_format("quantile", "yyyy-MM-dd"))


def design_variance_orders(spark: SparkSession, folder: str) -> DataFrame:
    est = design_variance(
        _customer_orders(spark, folder),
        "w",
        "o_totalprice",
        "c_nationkey",
        "c_custkey",
        "o_orderpriority",
    )
    return _rounded(est, y_hat=2, se=3, cv=8).drop("variance")


def _with_certainty_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the largest balances form strata of their own."""
    certain = F.col("c_acctbal") > 9950
    stratum = F.when(certain, -1 - F.col("c_custkey")).otherwise(F.col("c_nationkey"))
    return _customer_orders(spark, folder).withColumn("stratum", stratum)


def design_variance_certainty(spark: SparkSession, folder: str) -> DataFrame:
    est = design_variance(
        _with_certainty_customers(spark, folder),
        "w",
        "o_totalprice",
        "stratum",
        "c_custkey",
        "o_orderstatus",
        lonely_psu="zero",
    )
    return _rounded(est, y_hat=2, se=3, cv=8).drop("variance")


def design_variance_centered(spark: SparkSession, folder: str) -> DataFrame:
    est = design_variance(
        _with_certainty_customers(spark, folder),
        "w",
        "o_totalprice",
        "stratum",
        "c_custkey",
        "o_orderpriority",
        lonely_psu="center",
    )
    return _rounded(est, y_hat=2, se=3, cv=8).drop("variance")


def ratio_variance_discount(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder).withColumn(
        "discount", F.col("l_extendedprice") * F.col("l_discount")
    )
    est = ratio_variance(
        lines,
        "w",
        "discount",
        "l_extendedprice",
        "l_suppkey",
        "l_orderkey",
        ["l_returnflag", "l_linestatus"],
    )
    return _rounded(est, ratio_hat=8, se=9, cv=7).drop("variance")


def replicate_variance_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Delete-a-group jackknife: replicate r leaves out one group of customers."""
    orders = _orders(spark, folder)
    group = F.col("o_custkey") % REPLICATES
    inflated = F.col("w") * REPLICATES / (REPLICATES - 1)
    replicates = [f"w{r}" for r in range(REPLICATES)]
    orders = orders.withColumns(
        {
            name: F.when(group == r, 0.0).otherwise(inflated)
            for r, name in enumerate(replicates)
        }
    )
    est = replicate_variance(
        orders,
        "w",
        "o_totalprice",
        replicates,
        "o_orderpriority",
        scale=(REPLICATES - 1) / REPLICATES,
    )
    return _rounded(est, y_hat=2, se=3, cv=8).drop("variance")


def poststratify_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Weights that reproduce the number of customers per segment and nation."""
    cells = ["c_mktsegment", "c_nationkey"]
    customers = _customers(spark, folder)
    controls = customers.groupBy(*cells).agg(F.count("*").alias("control"))
    fitted = poststratify(customers, "w", cells, controls)
    return _rounded(fitted.select("c_custkey", *cells, "w", "w_post"), w_post=8)


def rake_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Weights that reproduce the customers per segment and those per nation."""
    customers = _customers(spark, folder)
    margins = [
        customers.groupBy(c).agg(F.count("*").alias("control"))
        for c in ("c_mktsegment", "c_nationkey")
    ]
    fitted = rake(customers, "w", margins, tol=1e-10)
    return _rounded(fitted.select("c_custkey", "w", "w_raked"), w_raked=5)


def rake_distributed(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`rake_customers`, with cells that stay distributed however few they are."""
    customers = _customers(spark, folder)
    margins = [
        customers.groupBy(c).agg(F.count("*").alias("control"))
        for c in ("c_mktsegment", "c_nationkey")
    ]
    fitted = rake(customers, "w", margins, tol=1e-10, one_task_bytes=0)
    return _rounded(fitted.select("c_custkey", "w", "w_raked"), w_raked=5)


def weighted_estimates_int(spark: SparkSession, folder: str) -> DataFrame:
    """Whole numbers whose product does not fit the type of either."""
    lines = _lines(spark, folder).select(
        "l_returnflag",
        (F.lit(50_000) + F.col("l_orderkey") % 1000).cast("int").alias("w"),
        (F.lit(100_000) + F.col("l_partkey")).cast("int").alias("y"),
    )
    est = weighted_estimates(lines, "w", "y", "l_returnflag")
    est = est.withColumns({c: F.col(c).cast("double") for c in ("n_hat", "y_hat")})
    return _rounded(est, mean_hat=6, share_n=10, share_y=10)


def design_variance_unstratified(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as PSUs of one sample without strata, and parts as groups."""
    est = design_variance(_lines(spark, folder), "w", "l_quantity", [], "l_suppkey", "l_partkey")
    return _rounded(est, y_hat=2, se=3, cv=7).drop("variance")


def replicate_variance_200(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`replicate_variance_orders`, with the usual number of replicates."""
    count = 200
    orders = _orders(spark, folder)
    group = F.col("o_custkey") % count
    inflated = F.col("w") * count / (count - 1)
    names = [f"w{r}" for r in range(count)]
    orders = orders.withColumns({n: F.when(group == r, 0.0).otherwise(inflated) for r, n in enumerate(names)})
    est = replicate_variance(orders, "w", "o_totalprice", names, "o_orderpriority", scale=(count - 1) / count)
    return _rounded(est, y_hat=2, se=3, cv=8).drop("variance")


def rake_four_margins(spark: SparkSession, folder: str) -> DataFrame:
    """Weights that reproduce the customers per segment, nation, balance band and key class."""
    customers = _customers(spark, folder).withColumns(
        {"band": F.floor(F.col("c_acctbal") / 2500), "class": F.col("c_custkey") % 3}
    )
    dims = ("c_mktsegment", "c_nationkey", "band", "class")
    margins = [customers.groupBy(c).agg(F.count("*").alias("control")) for c in dims]
    fitted = rake(customers, "w", margins, tol=1e-10)
    return _rounded(fitted.select("c_custkey", "w", "w_raked"), w_raked=5)


def period_change_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = _orders(spark, folder).withColumn("p", _quarter("o_orderdate"))
    est = weighted_estimates(orders, "w", "o_totalprice", ["o_orderpriority", "p"])
    changes = period_change(est, "y_hat", "p", "o_orderpriority")
    return _rounded(
        changes, y_hat=2, change_prev=2, rel_prev=8, change_year=2, rel_year=8
    )


def panel_flows_customers(spark: SparkSession, folder: str) -> DataFrame:
    panel = (
        _orders(spark, folder)
        .groupBy("o_custkey", _quarter("o_orderdate").alias("p"))
        .agg(F.max("o_orderstatus").alias("status"), F.max("w").alias("w"))
    )
    return panel_flows(panel, "o_custkey", "p", "status", "w")


def panel_flows_users(spark: SparkSession, folder: str) -> DataFrame:
    panel = (
        table(spark, folder, "events")
        .groupBy("user_id", F.unix_date(F.to_date("ts")).alias("p"))
        .agg(F.min("event_type").alias("first_type"), F.count("*").cast("double").alias("w"))
    )
    return panel_flows(panel, "user_id", "p", "first_type", "w")


def _order_lines(spark: SparkSession, folder: str) -> str:
    """Write the orders as fixed-width text and return the folder.

    As in keyed-in data, some fields are blank and some hold text for a number.
    """
    def padded(value: Column, width: int, fill: str, name: str) -> Column:
        """Padded on the left; a value that is null or too long is an error, never cut."""
        message = F.concat(F.lit(f"{name} does not fit its field: "), F.coalesce(value, F.lit("NULL")))
        fits = value.isNotNull() & (F.length(value) <= width)
        return F.when(fits, F.lpad(value, width, fill)).otherwise(F.raise_error(message))

    price = F.format_string("%.2f", "o_totalprice")
    price = F.when(F.col("o_orderpriority") == "5-LOW", "REFUSED").otherwise(price)
    status = F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus"))
    line = F.concat(
        padded(F.col("o_orderkey").cast("string"), 12, " ", "o_orderkey"),
        padded(F.col("o_custkey").cast("string"), 12, "0", "o_custkey"),
        padded(status, 1, " ", "o_orderstatus"),
        padded(price, 14, " ", "o_totalprice"),
        padded(F.date_format("o_orderdate", "yyyy-MM-dd"), 10, " ", "o_orderdate"),
        # The last field keeps its length, because a line may end with its text.
        F.when(F.length("o_orderpriority") <= 15, F.col("o_orderpriority")).otherwise(
            F.raise_error(F.lit("o_orderpriority does not fit its field"))
        ),
    )
    path = new_path(spark)
    table(spark, folder, "orders").select(line.alias("value")).write.text(path)
    return path


def read_fixed_width_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_fixed_width(spark, _order_lines(spark, folder), ORDER_LAYOUT)
    return orders.withColumns(
        {
            "total_price": F.col("total_price").cast("double"),
            "order_date": F.date_format("order_date", "yyyy-MM-dd"),
            "malformed": F.concat_ws(",", "malformed"),
        }
    )


def malformed_counts_orders(spark: SparkSession, folder: str) -> DataFrame:
    return malformed_counts(
        read_fixed_width(spark, _order_lines(spark, folder), ORDER_LAYOUT)
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "svy_weighted_estimates": weighted_estimates_orders,
    "svy_weighted_estimates_parts": weighted_estimates_parts,
    "svy_weighted_estimates_overall": weighted_estimates_overall,
    "svy_weighted_ratio": weighted_ratio_discount,
    "svy_weighted_crosstab": weighted_crosstab_orders,
    "svy_weighted_quantile": weighted_quantile_price,
    "svy_weighted_quantile_quantity": weighted_quantile_quantity,
    "svy_weighted_quantile_dates": weighted_quantile_dates,
    "svy_design_variance": design_variance_orders,
    "svy_design_variance_zero": design_variance_certainty,
    "svy_design_variance_center": design_variance_centered,
    "svy_ratio_variance": ratio_variance_discount,
    "svy_replicate_variance": replicate_variance_orders,
    "svy_poststratify": poststratify_customers,
    "svy_rake": rake_customers,
    "svy_weighted_estimates_int": weighted_estimates_int,
    "svy_design_variance_unstratified": design_variance_unstratified,
    "svy_replicate_variance_200": replicate_variance_200,
    "svy_rake_four_margins": rake_four_margins,
    "svy_rake_distributed": rake_distributed,
    "svy_period_change": period_change_orders,
    "svy_panel_flows": panel_flows_customers,
    "svy_panel_flows_users": panel_flows_users,
    "svy_read_fixed_width": read_fixed_width_orders,
    "svy_malformed_counts": malformed_counts_orders,
}
