"""Side-by-side comparison of the registered queries with their SQL in DuckDB.

    python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return v
    if hasattr(v, "item"):
        return _plain(v.item())
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, con) -> list[str]:
    """Differences as texts; empty when names, types, counts and values agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    ours = df.collect()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    a, b = _sorted_rows(df.columns, ours), _sorted_rows(names, theirs)
    if len(a) != len(b):
        return [f"rows {len(a)} != {len(b)}"]
    bad = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    if bad:
        return [f"{len(bad)} of {len(a)} rows differ, columns {sorted(names)}"] + [f"  ours   {x}\n  oracle {y}" for x, y in bad[:3]]
    return []


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from tallyscope import get_session
    from tallyscope.session import clear_scratch

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = get_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g",
                        spark__ui__enabled="false", spark__sql__ansi__enabled="true")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    sqls, failed, n = oracle_sql(), [], 0
    for name, run in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.monotonic()
        try:
            df = run(spark, sf_dir)
            if name in sqls:
                problems = compare(df, sqls[name], con)
                note = "sql"
            else:
                note, problems = f"{df.count()} rows", []
        except Exception as e:  # report and go on with the next query
            problems, note = [f"{type(e).__name__}: {str(e)[:1200]}"], "error"
        n += 1
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.monotonic() - start:.1f}s {note}", flush=True)
        for p in problems:
            print("   ", p, flush=True)
        if problems:
            failed.append(name)
    clear_scratch(spark)
    print(f"{n - len(failed)} of {n} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
