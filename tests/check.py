"""Compare registered queries with their SQL on DuckDB: python tests/check.py SF_DIR [name ...]."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    return (1, repr(float(value))) if isinstance(value, int | float) else (2, str(value))


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, query, sql, sf):
    """(ok, message) for one query."""
    frame = query(spark, sf)
    left = rows_by_name(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return True, f"{len(left)} rows (no SQL)"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    right = rows_by_name(names, cursor.fetchall())
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} vs {sorted(names)}"
    if left == right:
        return True, f"{len(left)} rows"
    a, b = set(left), set(right)
    return False, (f"{len(left)} vs {len(right)} rows; only spark {sorted(a - b)[:2]}; "
                   f"only sql {sorted(b - a)[:2]}")


def main():
    import __spark_entry__ as entry
    from homespell.session import build_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf), []
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            ok, message = compare(spark, con, queries[name], sql.get(name), sf)
        except Exception as error:
            ok, message = False, f"{type(error).__name__}: {str(error)[:600]}"
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {message}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
