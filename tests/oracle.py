"""Runs queries and their SQL side by side and compares their rows: python tests/oracle.py FOLDER [QUERY ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{source}'")
    return con


def canonical(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, bool) or x is None or isinstance(x, (str, bytes)):
            return repr(x)
        if isinstance(x, (int, float)):
            return "nan" if isinstance(x, float) and math.isnan(x) else f"{float(x):.6f}".replace("-0.000000", "0.000000")
        if isinstance(x, (list, tuple)):
            return "[" + ",".join(map(value, x)) + "]"
        return str(x)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, folder: str) -> str:
    """Empty where both agree, else what differs."""
    df = query(spark, folder)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = canonical(rel.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return ""
    only = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
    return f"rows {len(got)} and {len(want)}; only Spark {only[0]}; only SQL {only[1]}"


if __name__ == "__main__":
    import __spark_entry__ as e

    from domainloom.session import get_session

    spark = get_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = e.queries(), e.oracle_sql()
    con = connect(sys.argv[1])
    for name in sys.argv[2:] or queries:
        t = time.time()
        if name in sqls:
            said = compare(spark, con, queries[name], sqls[name], sys.argv[1]) or "agrees"
        else:
            said = f"{queries[name](spark, sys.argv[1]).count()} rows, no SQL"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
