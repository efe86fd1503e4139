"""Runs queries against their SQL twins: python tests/check.py [sf dir] [names...]"""

import pathlib
import sys
import time

sys.path[:0] = [str(pathlib.Path(__file__).resolve().parents[1]), str(pathlib.Path(__file__).parent)]

from oracle import connect, difference
from session import spark_session

import __spark_entry__ as entry

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = spark_session()
con = connect(sf)
sqls = entry.oracle_sql()
bad = []
for name, query in entry.queries().items():
    if names and name not in names:
        continue
    start = time.time()
    try:
        df = query(spark, sf)
        if name in sqls:
            problem = difference(df, con, sqls[name])
            note = f"{len(con.sql(sqls[name]).fetchall())} rows"
        else:
            problem, note = None, f"{df.count()} rows, no SQL"
    except Exception as e:
        problem, note = f"{type(e).__name__}: {str(e)[:1200]}", ""
    if problem:
        bad.append(name)
    print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {note} {problem or ''}", flush=True)
print("failed:", bad)
