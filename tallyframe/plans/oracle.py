"""SQL that gives the same results as the registered queries.

Each statement takes the direct route, not the one the operator takes: quantiles
by one running sum, variances over a frame with every absent PSU written as zero.
"""

from __future__ import annotations

from tallyframe.plans.queries import QUANTILES, REPLICATES

RAKE_ROUNDS = 14

_ORDERS = "(SELECT o.*, CAST(1 + o_custkey % 3 AS DOUBLE) AS w FROM orders o)"
_LINES = "(SELECT l.*, CAST(1 + l_orderkey % 3 AS DOUBLE) AS w FROM lineitem l)"
_CUSTOMER_ORDERS = (
    "(SELECT *, CAST(1 + o_custkey % 3 AS DOUBLE) AS w "
    "FROM orders JOIN customer ON o_custkey = c_custkey)"
)
_CERTAINTY = (
    "(SELECT *, CAST(1 + o_custkey % 3 AS DOUBLE) AS w, "
    "CASE WHEN c_acctbal > 9950 THEN -1 - c_custkey ELSE c_nationkey END AS stratum "
    "FROM orders JOIN customer ON o_custkey = c_custkey)"
)
_QUARTER = "CAST(year(o_orderdate) * 4 + quarter(o_orderdate) AS INTEGER)"


def _estimates(source: str, y: str, by: str | None) -> str:
    keys, grouping = (f"{by},", f"GROUP BY {by}") if by else ("", "")
    return f"""
WITH g AS (
  SELECT {keys} SUM(w) AS n, SUM(w * {y}) AS y FROM {source} {grouping}
)
SELECT {keys} n AS n_hat, round(y, 2) AS y_hat, round(y / NULLIF(n, 0), 6) AS mean_hat,
       round(n / NULLIF((SELECT SUM(n) FROM g), 0), 10) AS share_n,
       round(y / NULLIF((SELECT SUM(y) FROM g), 0), 10) AS share_y
FROM g
"""


def _quantiles(table: str, key: str, y: str, by: str, shown: str = "MIN(y)") -> str:
    probs = ", ".join(f"({p})" for p in QUANTILES)
    return f"""
WITH r AS (
  SELECT {by}, {y} AS y,
         SUM(1 + {key} % 3) OVER (PARTITION BY {by} ORDER BY {y}) AS cum,
         SUM(1 + {key} % 3) OVER (PARTITION BY {by}) AS total
  FROM {table}
)
SELECT {by}, CAST(p AS DOUBLE) AS prob, {shown} AS quantile
FROM r CROSS JOIN (VALUES {probs}) AS v(p)
WHERE cum >= p * total
GROUP BY {by}, p
"""


def _design(source: str, stratum: str, by: str, lonely: str) -> str:
    """The frame holds every PSU for every group, with zero where it has no case."""
    return f"""
WITH psu AS (SELECT DISTINCT {stratum} AS h, c_custkey AS c FROM {source}),
grp AS (SELECT DISTINCT {by} FROM {source}),
z AS (
  SELECT {stratum} AS h, c_custkey AS c, {by}, SUM(w * o_totalprice) AS z
  FROM {source} GROUP BY ALL
),
full_z AS (
  SELECT psu.h, psu.c, grp.{by}, COALESCE(z.z, 0) AS z
  FROM psu CROSS JOIN grp
  LEFT JOIN z ON z.h = psu.h AND z.c = psu.c AND z.{by} = grp.{by}
),
grand AS (SELECT {by}, AVG(z) AS zbar FROM full_z GROUP BY {by}),
per_stratum AS (
  SELECT f.h, f.{by}, COUNT(*) AS n, SUM(z) AS total,
         CASE WHEN COUNT(*) > 1 THEN COUNT(*) * VAR_SAMP(z) ELSE {lonely} END AS v
  FROM full_z f JOIN grand ON grand.{by} = f.{by}
  GROUP BY f.h, f.{by}
)
SELECT {by}, round(SUM(total), 2) AS y_hat, round(sqrt(SUM(v)), 3) AS se,
       round(sqrt(SUM(v)) / abs(SUM(total)), 8) AS cv
FROM per_stratum GROUP BY {by}
"""


def _ratio_variance() -> str:
    by = "l_returnflag, l_linestatus"
    return f"""
WITH x AS (
  SELECT l.*, CAST(1 + l_orderkey % 3 AS DOUBLE) AS w,
         l_extendedprice * l_discount AS num, l_extendedprice AS den
  FROM lineitem l
),
r AS (
  SELECT {by}, SUM(w * num) / SUM(w * den) AS r, SUM(w * den) AS d FROM x GROUP BY {by}
),
psu AS (SELECT DISTINCT l_suppkey AS h, l_orderkey AS c FROM x),
u AS (
  SELECT l_suppkey AS h, l_orderkey AS c, {by}, SUM(w * (num - r * den) / d) AS u
  FROM x JOIN r USING ({by})
  GROUP BY ALL
),
full_u AS (
  SELECT psu.h, psu.c, r.l_returnflag, r.l_linestatus, COALESCE(u.u, 0) AS u
  FROM psu CROSS JOIN r
  LEFT JOIN u ON u.h = psu.h AND u.c = psu.c
   AND u.l_returnflag = r.l_returnflag AND u.l_linestatus = r.l_linestatus
),
v AS (
  SELECT {by}, SUM(v) AS v FROM (
    SELECT h, {by}, COUNT(*) * VAR_SAMP(u) AS v FROM full_u GROUP BY h, {by}
  ) GROUP BY {by}
)
SELECT {by}, round(r, 8) AS ratio_hat, round(sqrt(v), 9) AS se,
       round(sqrt(v) / abs(r), 7) AS cv
FROM r JOIN v USING ({by})
"""


def _replicates(count: int) -> str:
    factor = f"{count} / {count - 1}"
    sums = ", ".join(
        f"SUM(CASE WHEN o_custkey % {count} = {r} THEN 0 "
        f"ELSE w * {factor} * o_totalprice END) AS t{r}"
        for r in range(count)
    )
    gaps = " + ".join(f"pow(t{r} - t, 2)" for r in range(count))
    return f"""
WITH s AS (
  SELECT o_orderpriority, SUM(w * o_totalprice) AS t, {sums}
  FROM {_ORDERS} GROUP BY o_orderpriority
),
v AS (
  SELECT o_orderpriority, t, ({gaps}) * {count - 1} / {count} AS v FROM s
)
SELECT o_orderpriority, round(t, 2) AS y_hat, round(sqrt(v), 3) AS se,
       round(sqrt(v) / abs(t), 8) AS cv
FROM v
"""


def _rake(*margins: str) -> str:
    """A fixed number of rounds, written out; enough to settle all digits shown."""
    names = [f"m{i}" for i in range(len(margins))]
    cells = ", ".join(names)
    source = ", ".join(f"{m} AS {n}" for m, n in zip(margins, names))
    steps = [
        f"customers AS (SELECT c_custkey, {source} FROM customer)",
        f"c0 AS (SELECT {cells}, CAST(SUM(1 + c_custkey % 3) AS DOUBLE) AS base, "
        "CAST(SUM(1 + c_custkey % 3) AS DOUBLE) AS w, COUNT(*) AS n FROM customers GROUP BY ALL)",
    ]
    rounds = len(margins) * RAKE_ROUNDS
    for i in range(rounds):
        margin = names[i % len(names)]
        steps.append(
            f"c{i + 1} AS MATERIALIZED (SELECT {cells}, base, n, "
            f"w * SUM(n) OVER (PARTITION BY {margin}) / SUM(w) OVER (PARTITION BY {margin})"
            f" AS w FROM c{i})"
        )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT c_custkey, CAST(1 + c_custkey % 3 AS DOUBLE) AS w,
       round((1 + c_custkey % 3) * f.w / f.base, 5) AS w_raked
FROM customers JOIN c{rounds} f USING ({cells})
"""
    )


_ESTIMATES_INT = """
WITH g AS (
  SELECT l_returnflag, SUM(w) AS n, SUM(w * y) AS y
  FROM (SELECT l_returnflag, CAST(50000 + l_orderkey % 1000 AS HUGEINT) AS w,
               CAST(100000 + l_partkey AS HUGEINT) AS y FROM lineitem)
  GROUP BY l_returnflag
)
SELECT l_returnflag, CAST(n AS DOUBLE) AS n_hat, CAST(y AS DOUBLE) AS y_hat,
       round(CAST(y AS DOUBLE) / CAST(n AS DOUBLE), 6) AS mean_hat,
       round(CAST(n AS DOUBLE) / (SELECT CAST(SUM(n) AS DOUBLE) FROM g), 10) AS share_n,
       round(CAST(y AS DOUBLE) / (SELECT CAST(SUM(y) AS DOUBLE) FROM g), 10) AS share_y
FROM g
"""

_UNSTRATIFIED = f"""
WITH psu AS (SELECT l_partkey, l_suppkey, SUM(w * l_quantity) AS z FROM {_LINES} GROUP BY ALL),
size AS (SELECT CAST(COUNT(DISTINCT l_suppkey) AS DOUBLE) AS n FROM lineitem),
v AS (
  SELECT l_partkey, SUM(z) AS t, n / (n - 1) * (SUM(z * z) - SUM(z) * SUM(z) / n) AS v
  FROM psu CROSS JOIN size GROUP BY l_partkey, n
)
SELECT l_partkey, round(t, 2) AS y_hat, round(sqrt(v), 3) AS se, round(sqrt(v) / abs(t), 7) AS cv
FROM v
"""


def _flows(panel: str, key: str, state: str) -> str:
    return f"""
WITH panel AS ({panel}),
flows AS (
  SELECT COALESCE(b.p, a.p + 1) AS p,
         CASE WHEN a.p IS NULL THEN 'entry' WHEN b.p IS NULL THEN 'exit' ELSE 'stay' END
           AS kind,
         a.{state} AS from_state, b.{state} AS to_state, COALESCE(a.w, b.w) AS w
  FROM panel a FULL JOIN panel b ON a.{key} = b.{key} AND a.p + 1 = b.p
)
SELECT CAST(p AS BIGINT) AS p, kind, from_state, to_state, COUNT(*) AS n, SUM(w) AS n_hat
FROM flows GROUP BY ALL
"""


_FIXED_WIDTH = """
SELECT o_orderkey AS order_key, o_custkey AS customer_key,
       CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status,
       CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS total_price,
       strftime(o_orderdate, '%Y-%m-%d') AS order_date,
       o_orderpriority AS priority,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'total_price' ELSE '' END AS malformed
FROM orders
"""

ORACLE_SQL: dict[str, str] = {
    "svy_weighted_estimates": _estimates(_ORDERS, "o_totalprice", "o_orderpriority"),
    "svy_weighted_estimates_parts": """
WITH g AS (
  SELECT l_partkey, SUM(1 + l_orderkey % 3) AS n,
         SUM((1 + l_orderkey % 3) * CAST(l_extendedprice AS DECIMAL(12,2))) AS y
  FROM lineitem GROUP BY l_partkey
),
d AS (SELECT l_partkey, CAST(n AS DOUBLE) AS n, CAST(y AS DOUBLE) AS y FROM g),
t AS (SELECT CAST(SUM(n) AS DOUBLE) AS n, CAST(SUM(y) AS DOUBLE) AS y FROM g)
SELECT l_partkey, d.n AS n_hat, d.y AS y_hat, d.y / NULLIF(d.n, 0) AS mean_hat,
       d.n / NULLIF(t.n, 0) AS share_n, d.y / NULLIF(t.y, 0) AS share_y
FROM d, t
""",
    "svy_weighted_estimates_overall": _estimates(_LINES, "l_quantity", None),
    "svy_weighted_ratio": f"""
WITH g AS (
  SELECT l_returnflag, l_linestatus, SUM(w * l_extendedprice * l_discount) AS num,
         SUM(w * l_extendedprice) AS den
  FROM {_LINES} GROUP BY l_returnflag, l_linestatus
)
SELECT l_returnflag, l_linestatus, round(num, 4) AS num_hat, round(den, 2) AS den_hat,
       round(num / NULLIF(den, 0), 8) AS ratio_hat
FROM g
""",
    "svy_weighted_crosstab": f"""
SELECT c_mktsegment, o_orderpriority, o_orderstatus,
       CAST(GROUPING(c_mktsegment, o_orderpriority, o_orderstatus) AS INTEGER) AS gid,
       SUM(w) AS n_hat
FROM {_CUSTOMER_ORDERS}
GROUP BY CUBE (c_mktsegment, o_orderpriority, o_orderstatus)
""",
    "svy_weighted_quantile": _quantiles(
        "lineitem", "l_orderkey", "l_extendedprice", "l_returnflag"
    ),
    "svy_weighted_quantile_quantity": _quantiles(
        "lineitem", "l_orderkey", "l_quantity", "l_suppkey"
    ),
    "svy_weighted_quantile_dates": _quantiles(
        "orders",
        "o_custkey",
        "o_orderdate",
        "o_orderpriority",
        "strftime(MIN(y), '%Y-%m-%d')",
    ),
    "svy_design_variance": _design(
        _CUSTOMER_ORDERS, "c_nationkey", "o_orderpriority", "error('single PSU')"
    ),
    "svy_design_variance_zero": _design(_CERTAINTY, "stratum", "o_orderstatus", "0"),
    "svy_design_variance_center": _design(
        _CERTAINTY, "stratum", "o_orderpriority", "SUM(pow(z - zbar, 2))"
    ),
    "svy_ratio_variance": _ratio_variance(),
    "svy_replicate_variance": _replicates(REPLICATES),
    "svy_replicate_variance_200": _replicates(200),
    "svy_poststratify": """
WITH c AS (
  SELECT c_mktsegment, c_nationkey, COUNT(*) AS n,
         CAST(SUM(1 + c_custkey % 3) AS DOUBLE) AS w
  FROM customer GROUP BY c_mktsegment, c_nationkey
)
SELECT c_custkey, c_mktsegment, c_nationkey, CAST(1 + c_custkey % 3 AS DOUBLE) AS w,
       round((1 + c_custkey % 3) * c.n / c.w, 8) AS w_post
FROM customer JOIN c USING (c_mktsegment, c_nationkey)
""",
    "svy_rake": _rake("c_mktsegment", "c_nationkey"),
    "svy_rake_distributed": _rake("c_mktsegment", "c_nationkey"),
    "svy_rake_four_margins": _rake("c_mktsegment", "c_nationkey", "floor(c_acctbal / 2500)", "c_custkey % 3"),
    "svy_weighted_estimates_int": _ESTIMATES_INT,
    "svy_design_variance_unstratified": _UNSTRATIFIED,
    "svy_period_change": f"""
WITH e AS (
  SELECT o_orderpriority, {_QUARTER} AS p, SUM(w * o_totalprice) AS y
  FROM {_ORDERS} GROUP BY ALL
)
SELECT a.o_orderpriority, a.p, round(a.y, 2) AS y_hat,
       round(a.y - b.y, 2) AS change_prev, round((a.y - b.y) / b.y, 8) AS rel_prev,
       round(a.y - c.y, 2) AS change_year, round((a.y - c.y) / c.y, 8) AS rel_year
FROM e a
LEFT JOIN e b ON b.o_orderpriority = a.o_orderpriority AND b.p = a.p - 1
LEFT JOIN e c ON c.o_orderpriority = a.o_orderpriority AND c.p = a.p - 4
""",
    "svy_panel_flows": _flows(
        f"SELECT o_custkey, {_QUARTER} AS p, MAX(o_orderstatus) AS status, MAX(w) AS w "
        f"FROM {_ORDERS} GROUP BY ALL",
        "o_custkey",
        "status",
    ),
    "svy_panel_flows_users": _flows(
        "SELECT user_id, CAST(ts AS DATE) - DATE '1970-01-01' AS p, "
        "MIN(event_type) AS first_type, CAST(COUNT(*) AS DOUBLE) AS w FROM events GROUP BY ALL",
        "user_id",
        "first_type",
    ),
    "svy_read_fixed_width": _FIXED_WIDTH,
    "svy_malformed_counts": """
SELECT 'total_price' AS field, COUNT(*) AS n_malformed
FROM orders WHERE o_orderpriority = '5-LOW' HAVING COUNT(*) > 0
""",
}
