"""Compare the registered queries with their SQL in DuckDB.

``python -m tests.compare [folder] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TESTDATA = Path("/root/testdata")


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyframe")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return db


def normalized(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = df.map(lambda v: None if pd.isna(v) else float(v) if isinstance(v, float) else v)
    order = df.astype(str).apply("\x1f".join, axis=1).argsort()
    return df.iloc[order].reset_index(drop=True)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """What differs between two results, or None. Values must be equal."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} and {sorted(right.columns)}"
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows"
    left, right = normalized(left), normalized(right)
    for column in left.columns:
        kinds = {type(v).__name__ for s in (left, right) for v in s[column].dropna()}
        if len(kinds) > 1:
            return f"types {kinds} in {column}"
        unequal = ~((left[column] == right[column]) | (left[column].isna() & right[column].isna()))
        if unequal.any():
            row = unequal.idxmax()
            return (
                f"{unequal.sum()} values of {column}, first "
                f"{left[column][row]!r} and {right[column][row]!r}"
            )
    return None


def main(folder: str, chosen: list[str]) -> int:
    import __spark_entry__ as contract

    spark, db, sql = session(), database(folder), contract.oracle_sql()
    failed = 0
    for name, query in contract.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            found = query(spark, folder).toPandas()
            took = time.time() - start
            wrong = difference(found, db.sql(sql[name]).df()) if name in sql else None
        except Exception as error:
            found, took, wrong = [], time.time() - start, str(error)[:600]
        failed += wrong is not None
        print(f"{name:34} {len(found):7} rows {took:6.2f} s  {wrong or 'equal'}", flush=True)
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(main(args[0] if args else str(TESTDATA / "sf0.01"), args[1:]))
