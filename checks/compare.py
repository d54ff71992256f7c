"""Compare registered queries with their oracle SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import collections
import sys
import time

import duckdb

from barweave.session import local_session
from checks.catalog import QUERIES
from checks.oracle_queries import ORACLES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def cell(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return repr(v)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(t: str) -> str:
    t = t.lower()
    if t in ("bigint", "integer", "int", "hugeint"):
        return "int" if t in ("bigint",) else t
    return {"varchar": "string", "str": "string", "string": "string"}.get(t, t)


def check(spark, con, sf_dir: str, name: str) -> str:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    left = collections.Counter(tuple(cell(row[c]) for c in cols) for row in df.collect())
    took = time.time() - start
    if name not in ORACLES:
        return f"ROWS {name} {sum(left.values())} ({took:.1f}s)"
    cur = con.execute(ORACLES[name])
    got = [d[0] for d in cur.description]
    types = {d[0]: kind(str(d[1])) for d in cur.description}
    if sorted(got) != cols:
        return f"FAIL {name} columns {sorted(set(got) ^ set(cols))}"
    wrong = [(c, kind(t), types[c]) for c, t in df.dtypes if kind(t) != types[c]]
    index = [got.index(c) for c in cols]
    right = collections.Counter(tuple(cell(row[i]) for i in index) for row in cur.fetchall())
    if left == right and not wrong:
        return f"OK {name} {sum(left.values())} ({took:.1f}s)"
    only_l, only_r = list((left - right).items()), list((right - left).items())
    text = f"FAIL {name} rows {sum(left.values())}/{sum(right.values())} differ {len(only_l)}/{len(only_r)} types {wrong}"
    if only_l and only_r:
        a = sorted(only_l, key=str)[0][0]
        b = max((x[0] for x in only_r), key=lambda x: sum(p == q for p, q in zip(a, x)))
        text += " first: " + str([(c, p, q) for c, p, q in zip(cols, a, b) if p != q][:6])
    elif only_l or only_r:
        text += f" only: {(only_l or only_r)[0]}"
    return text


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = local_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        try:
            line = check(spark, con, sf_dir, name)
        except Exception as e:  # report and go on
            line = f"FAIL {name} {str(e)[:400]!r}"
        bad += line.startswith("FAIL")
        print(line, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
