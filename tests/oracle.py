"""Run named queries beside their SQL: python -m tests.oracle [sf] [name prefix ...]"""

import math
import sys
import time

import duckdb

sys.path.insert(0, ".")


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            v = float(v)
            return "nan" if math.isnan(v) else f"{round(v, 6) + 0.0:.6g}"
        if isinstance(v, (list, tuple)):
            return "[" + ",".join(norm(x) for x in v) + "]"
        return str(v)

    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, con, name, query, sql, d):
    t = time.time()
    df = query(spark, d)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return f"rows {len(got)} only", took
    cur = con.execute(sql)
    cols = [x[0] for x in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS differ {sorted(df.columns)} {sorted(cols)}", took
    a, b = rows(df.columns, got), rows(cols, want)
    if a == b:
        return f"ok {len(a)}", took
    from collections import Counter

    ca, cb = Counter(a), Counter(b)
    return f"DIFF {len(a)} {len(b)}; only spark {list((ca - cb))[:3]} only sql {list((cb - ca))[:3]}", took


def views(d):
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(d).iterdir():
        at = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"create view {p.stem} as select * from '{at}'")
    return con


if __name__ == "__main__":
    import __spark_entry__ as e
    from strandline.session import build_session

    sf, *want = sys.argv[1:] or ["sf0.01"]
    d = f"/root/testdata/{sf}"
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = views(d)
    sqls = e.oracle_sql()
    for n, q in e.queries().items():
        if want and not any(n.startswith(w) for w in want):
            continue
        try:
            said, took = compare(spark, con, n, q, sqls.get(n), d)
        except Exception as x:
            said, took = f"ERROR {str(x)[:1500]}", 0
        print(f"{n}: {said} ({took:.1f} s)", flush=True)
