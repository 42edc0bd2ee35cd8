"""Every registered core query against its SQL, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from basaltic.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = Counter(tuple(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in columns) for r in got.collect())
    if name in registry.oracle_sql():
        want = duck.execute(registry.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        assert rows == Counter(tuple(r[names.index(c)] for c in columns) for r in want.fetchall())
    else:
        assert rows
