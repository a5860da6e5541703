"""Compare a query's rows with its SQL on the same files."""

import glob
import os

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return [plain(x) for x in v]
    return v


def check(spark, con, query, sql):
    df = query(spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = con.execute(sql)
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert mine == sorted(str([plain(r[i]) for i in at]) for r in cursor.fetchall())
