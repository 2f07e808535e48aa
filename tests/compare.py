"""Run registered queries next to their SQL in DuckDB and compare rows exactly."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """A form in which equal values of both engines look alike, type included."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return ("f", "nan") if value != value else ("f", value + 0.0)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, datetime.datetime):
        return ("t", value.isoformat())
    if isinstance(value, datetime.date):
        return ("d", value.isoformat())
    if isinstance(value, decimal.Decimal):
        return ("n", str(value))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (bytes, bytearray)):
        return ("b", bytes(value))
    return str(value)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = run(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if mine == theirs:
        return None
    only_mine, only_theirs = mine - theirs, theirs - mine
    return (
        f"rows {sum(mine.values())} against {sum(theirs.values())}; "
        f"only here {list(only_mine)[:2]}; only there {list(only_theirs)[:2]}"
    )


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from lakeloom.plans import ORACLE, QUERIES
    from lakeloom.plans.registry import MODULE_OF
    from lakeloom.session import build_session

    sf_dir, names = sys.argv[1], []
    for word in sys.argv[2:]:  # query names, or @module for all of a module
        names += [n for n in QUERIES if word in (n, f"@{MODULE_OF[n]}")]
    spark = build_session(
        **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            if name in ORACLE:
                problem = compare(spark, con, QUERIES[name], ORACLE[name], sf_dir)
                note = "rows-equal"
            else:
                problem, note = None, f"{QUERIES[name](spark, sf_dir).count()} rows, no SQL"
        except Exception as e:  # keep going, report at the end
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:24s} {time.time() - start:6.2f}s {problem or note}", flush=True)
    print(f"{bad} failures")


if __name__ == "__main__":
    main()
