"""Run registered queries beside their SQL and compare rows: python tests/check_oracles.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            if math.isnan(v):
                return "nan"
            return repr(v + 0.0)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def kinds(rows, names):
    out = {}
    for i, n in enumerate(names):
        out[n] = {type(r[i]).__name__ for r in rows if r[i] is not None}
    return out


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    names = df.columns
    took = time.time() - t0
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    t1 = time.time()
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - t1
    if sorted(names) != sorted(want_names):
        return False, f"columns {sorted(set(names) ^ set(want_names))}"
    a, b = canonical(got, names), canonical(want, want_names)
    ka, kb = kinds(got, names), kinds(want, want_names)
    bad_types = {n: (ka[n], kb[n]) for n in ka if ka[n] != kb[n] and ka[n] and kb[n]}
    if a != b:
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        return False, f"{len(a)} vs {len(b)} rows; cols {sorted(names)}\n   spark {only_a}\n   sql   {only_b}"
    if bad_types:
        return False, f"types {bad_types}"
    if not a:
        return False, "no rows at all"
    return True, f"{len(a)} rows, spark {took:.1f}s, sql {sql_took:.1f}s"


def main():
    import __spark_entry__ as entry
    from jobsight.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as e:  # show and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
