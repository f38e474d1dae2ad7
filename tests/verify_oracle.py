"""Run every registered query and its SQL in DuckDB and compare the rows.

Usage: python tests/verify_oracle.py [table folder] [name part ...]
"""

from __future__ import annotations

import pathlib
import os
import sys
import time

import duckdb
import pyarrow as pa

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import __spark_entry__ as registered  # noqa: E402
from rackpulse.session import build_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in pathlib.Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def comparable(table: pa.Table) -> list[tuple]:
    """Rows as sortable texts, columns by name."""
    names = sorted(table.column_names)
    rows = zip(*(table.column(name).to_pylist() for name in names))
    return sorted(tuple(repr(cell) for cell in row) for row in rows)


def check(spark, con, sf_dir: str, name: str) -> str:
    """'' if both agree, else what differs."""
    mine = registered.queries()[name](spark, sf_dir).toArrow()
    sql = registered.oracle_sql().get(name)
    if sql is None:
        return "" if mine.num_rows else "no rows"
    theirs = con.sql(sql).to_arrow_table()
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(mine.column_names)} != {sorted(theirs.column_names)}"
    if mine.num_rows != theirs.num_rows:
        return f"rows {mine.num_rows} != {theirs.num_rows}"
    if not mine.num_rows:
        return "both empty"
    for left, right in zip(comparable(mine), comparable(theirs)):
        if left != right:
            return f"{left} != {right}"
    types = {n: (str(mine.schema.field(n).type), str(theirs.schema.field(n).type)) for n in mine.column_names}
    odd = {n: pair for n, pair in types.items() if pair[0] != pair[1]}
    return f"types {odd}" if odd else ""


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("verify", f"local[{os.environ.get("VERIFY_CPUS", "8")}]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in registered.queries():
        if wanted and not any(part in name for part in wanted):
            continue
        start = time.time()
        try:
            problem = check(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
