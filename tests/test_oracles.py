"""Each query of the package against its SQL twin, on the smallest tables; the others must run."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from boutline.plans import ORACLE_SQL, QUERIES

SF = os.environ.get("BOUTLINE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    return None if value is None or value != value else f"{value:.6g}" if isinstance(value, float) else [plain(v) for v in value] if isinstance(value, (list, tuple)) else int(value) if isinstance(value, bool) else value


def counted(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(str([plain(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        assert counted(got.columns, rows) == counted(names, want.fetchall())
