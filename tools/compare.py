"""Run the named queries on Spark and their SQL twins on DuckDB, and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None where both sides agree, else what differs."""
    names, ours = bag(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs_names, theirs = bag([d[0] for d in cursor.description], cursor.fetchall())
    if names != theirs_names:
        return f"columns {names} != {theirs_names}"
    if ours != theirs:
        return (f"{sum(ours.values())} rows != {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:2]}; "
                f"only theirs {list((theirs - ours).items())[:2]}")
    return None


def main(argv):
    from faultline.plans import QUERIES, SQL
    from faultline.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(cores="8"), duck(folder)
    wanted = [n for n in QUERIES if not argv or any(a in n for a in argv)]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in SQL:
                issue = compare(df, con, SQL[name])
                note = "equal" if issue is None else f"DIFFERS {issue}"
            else:
                issue, note = None, f"{df.count()} rows, no SQL"
        except Exception as exc:  # the run goes on and reports every query
            issue = note = f"FAILED {type(exc).__name__} {str(exc)[:600]}"
        bad += issue is not None
        print(f"{name}: {note} ({time.time() - start:.1f}s)", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
