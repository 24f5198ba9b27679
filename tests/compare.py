"""Runs registered queries against their SQL twins; also usable as a script.

python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT", "binary": "BLOB",
}

# joins that compare all pairs of rows
BANNED = ("CartesianProduct", "NestedLoopJoin")


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    rows = sorted("|".join(canon(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    return cols, {f.name: f.dataType.simpleString() for f in df.schema}, rows


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted("|".join(canon(r[i]) for i in order) for r in cur.fetchall())
    return sorted(names), types, rows


def check(spark, con, folder, name, fn, sql):
    """Returns a list of complaints, empty when both sides agree."""
    df = fn(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    banned = [kind for kind in BANNED if kind in plan]
    if banned:
        return [f"plan has {banned}"]
    cols, kinds, rows = spark_rows(df)
    if not rows:
        return ["no rows"]
    if sql is None:
        return []
    dcols, dkinds, drows = duck_rows(con, sql)
    out = []
    if cols != dcols:
        return [f"columns {cols} != {dcols}"]
    for c in cols:
        want = KINDS.get(kinds[c])
        if want and want != dkinds[c]:
            out.append(f"type of {c}: spark {kinds[c]}, duckdb {dkinds[c]}")
    if len(rows) != len(drows):
        out.append(f"{len(rows)} rows != {len(drows)}")
    if rows != drows:
        only = sorted(set(rows) - set(drows))[:3]
        other = sorted(set(drows) - set(rows))[:3]
        out.append(f"values differ: spark {only} duckdb {other}")
    return out


def main(argv):
    from loomlab.session import build_session
    from __spark_entry__ import oracle_sql, queries

    folder = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        folder, argv = argv[1], argv[2:]
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sqls, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if argv and not any(a == name or (a.endswith("*") and name.startswith(a[:-1])) for a in argv):
            continue
        t = time.time()
        try:
            complaints = check(spark, con, folder, name, fn, sqls.get(name))
        except Exception as e:  # report and go on with the next query
            text = str(e)
            cause = text.find("Caused by")
            complaints = [f"{type(e).__name__}: {text[:300]} {text[cause:cause + 1500] if cause > 0 else ''}"]
        bad += bool(complaints)
        kind = "S" if name in sqls else "R"
        print(f"{'FAIL' if complaints else 'ok':4} {kind} {time.time() - t:6.2f}s {name}", *complaints, sep="  ", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
