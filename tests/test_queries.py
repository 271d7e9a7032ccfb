"""Every query of the library against its SQL twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

from gridloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def canonical(rows, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    cursor = duck.execute(catalog.ORACLES[name])
    heads = [d[0] for d in cursor.description]
    assert sorted(heads) == columns
    expected = [dict(zip(heads, r)) for r in cursor.fetchall()]
    assert canonical(found.collect(), columns) == canonical(expected, columns)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
