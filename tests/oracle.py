"""Compare registered queries with their SQL, as order-free multisets of rows."""

from __future__ import annotations

import datetime
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return repr(v + 0.0) if v == v else "nan"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def compare(df, con, sql: str) -> str | None:
    """None if both agree, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in order]).collect()]
    pos = [names.index(c) for c in order]
    a = Counter(tuple((type(x).__name__, norm(x)) for x in r) for r in got)
    b = Counter(tuple((type(r[i]).__name__, norm(r[i])) for i in pos) for r in want)
    if a != b:
        only = list((a - b).items())[:2], list((b - a).items())[:2]
        return f"rows {len(got)} vs {len(want)}, differing {sum((a - b).values())}/{sum((b - a).values())}: spark {only[0]} sql {only[1]}"
    return None


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tests.conftest import session

    sf = sys.argv[1]
    names = sys.argv[2:]
    spark, con = session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                result = compare(df, con, oracles[name]) or "ok"
            else:
                result = f"ok (no sql, {len(df.collect())} rows)"
        except Exception as e:
            result = f"{type(e).__name__} {str(e)[:700]}"
        if not result.startswith("ok"):
            bad.append(name)
        print(f"{name:28s} {time.time() - start:6.2f}s {result}", flush=True)
    print("FAILED:", bad, "of", len(names or queries))


if __name__ == "__main__":
    main()
