"""Every registered query of this library against its DuckDB SQL at the smallest scale factor."""

import math
import os

import duckdb
import pytest

from tallyworks.registry import ORACLE, QUERIES
from tallyworks import queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted(([show(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    out = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in out.collect()]
    if name in ORACLE:
        cursor = duck.execute(ORACLE[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(out.columns)
        assert plain(rows, out.columns) == plain(cursor.fetchall(), columns)
    else:
        assert out.columns
