"""Run registered queries and their SQL side by side: ``python tests/compare.py <folder> [names...]``."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    return value


def order(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def difference(df, con, sql: str) -> str | None:
    """First difference between a Spark result and a SQL result, None when they are equal."""
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=order)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    theirs = sorted(
        (tuple(plain(dict(zip(columns, r))[n]) for n in names) for r in found.fetchall()), key=order
    )
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{dict(zip(names, a))}\n     against {dict(zip(names, b))}"
    return None if mine else "no rows"


def main() -> int:
    import __spark_entry__ as entry
    from shardscope.session import get_session

    spark = get_session(
        "compare",
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder, wanted = sys.argv[1], sys.argv[2:]
    con, sqls, bad = connect(folder), entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            df = run(spark, folder)
            note = difference(df, con, sqls[name]) if name in sqls else f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            note = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        failed = note is not None and not note.startswith("rows only")
        bad += [name] if failed else []
        print(f"{'BAD' if failed else 'ok '} {time.time() - began:6.2f}s {name} {note or ''}", flush=True)
    print(f"bad: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
