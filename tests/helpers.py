"""Facts for tests, and a plain model of them."""

import glob
import hashlib
import os

import duckdb

from factloom.types import DATOM_SCHEMA, LONG, big_bytes, lane, node_id

SF = "/root/testdata/sf0.001"


def eid(name: str) -> bytes:
    return hashlib.sha256(name.encode()).digest()


def fact(e, a, value, phys, log=0, node=0, op=0, tag=LONG, epoch=None):
    held = {"v_str": None, "v_long": None, "v_dbl": None, "v_bin": None}
    held[lane(tag)] = big_bytes(value) if lane(tag) == "v_bin" and isinstance(value, int) else value
    return (eid(e), a, tag, held["v_str"], held["v_long"], held["v_dbl"], held["v_bin"], phys, log, node_id(node), op, epoch)


def frame(spark, rows):
    return spark.createDataFrame(rows, DATOM_SCHEMA)


def live_model(rows):
    """{(e, a, v)} by the definition: the latest event of each value is an assertion, which wins ties."""
    latest = {}
    for r in rows:
        key, when = (r[0], r[1], r[2:7]), (r[7], r[8], r[9], 1 - r[10])
        if key not in latest or when > latest[key]:
            latest[key] = when
    return {k: w for k, w in latest.items() if w[3] == 1}


def duck(sf=SF):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def rows_of(pdf):
    cols = sorted(pdf.columns)

    def text(x):
        return "NULL" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)

    return cols, sorted(tuple(text(x) for x in r) for r in pdf[cols].itertuples(index=False))
