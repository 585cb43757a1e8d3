"""Every query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from chronoflux.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def shown(v):
        if isinstance(v, float):
            return "null" if math.isnan(v) else f"{v:.5f}"
        return "null" if v is None else f"{v:.5f}" if isinstance(v, int) and not isinstance(v, bool) else str(v)

    return sorted([tuple(shown(r[k]) for k in order) for r in rows])


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, db, name):
    df, want = catalog.QUERIES[name](spark, str(DATA)), db.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(want.columns, want.fetchall())
