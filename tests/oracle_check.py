"""Run registered queries against their SQL on DuckDB: ``python tests/oracle_check.py <sf dir> [names]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT else v
    return sorted((tuple(clean(v) for v in row) for row in frame.itertuples(index=False, name=None)), key=repr)


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> list[str]:
    """Differences in columns, column types, row count and values (exact)."""
    out = []
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return [f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"]
    for c in spark_frame.columns:
        a, b = str(spark_frame[c].dtype), str(sql_frame[c].dtype)
        if a.replace("str", "object") != b.replace("str", "object"):
            out.append(f"type of {c}: {a} / {b}")
    if len(spark_frame) != len(sql_frame):
        return [*out, f"rows {len(spark_frame)} / {len(sql_frame)}"]
    bad = [(x, y) for x, y in zip(_rows(spark_frame), _rows(sql_frame)) if x != y]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[:2]}")
    return out


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from brookmill.session import local_session

    spark = local_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or list(queries):
        began = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            spent = time.time() - began
            if name in oracles:
                again = time.time()
                problems = compare(got, con.sql(oracles[name]).df())
                print(f"{'ok ' if not problems else 'BAD'} {name} rows={len(got)} {spent:.1f}s sql {time.time() - again:.1f}s {problems or ''}", flush=True)
                failed += bool(problems)
            else:
                print(f"--- {name} rows={len(got)} {spent:.1f}s\n{got.head(4).to_string()}", flush=True)
        except Exception as error:
            failed += 1
            print(f"ERR {name}: {str(error)[:1500]}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 100))
