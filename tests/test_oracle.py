"""Every registered query of the core against its SQL, and a smoke run of those without."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as registered
from codelens.plans import queries as core

SF = "/root/testdata/sf0.001"


def rows(names, data):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        if isinstance(v, int) and not isinstance(v, bool):
            return float(v)
        return v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([cell(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, name):
    got = core.QUERIES[name](spark, SF)
    if name not in core.SQL:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(core.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, cur.fetchall())


def test_entry(spark):
    assert registered.entry(spark).count() > 0
    assert set(registered.oracle_sql()) <= set(registered.queries())
