"""A query's rows against those of its SQL over the same files."""

import glob
import os
from collections import Counter

import duckdb

import __spark_entry__ as entry
from annotary.runtime import release

DATA = "/root/testdata/sf0.001"


def differences(spark, name):
    """How many rows only the query has, and only the SQL."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, DATA)
    # moments as text: the two engines' Python types differ
    times = [c for c, t in df.dtypes if t.startswith("timestamp")]
    df = df.select(*[df[c].cast("bigint").alias(c) if c in times else df[c] for c in df.columns])
    picked = ", ".join(f'CAST(floor(epoch("{c}")) AS BIGINT)' if c in times else f'"{c}"' for c in df.columns)
    want = Counter(map(repr, con.execute(f"SELECT {picked} FROM ({entry.oracle_sql()[name]})").fetchall()))
    got = Counter(repr(tuple(r)) for r in df.collect())
    release(spark)
    return (got - want).total(), (want - got).total()
