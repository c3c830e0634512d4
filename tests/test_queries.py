"""Every registered query against its SQL."""

import pytest
from compare import SMALL, duck, rows_of
from evenmark.plans import all as plans


@pytest.fixture(scope="module")
def db():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, SMALL)
    got = rows_of(df.columns, df.collect())
    if name in plans.SQL:
        r = db.execute(plans.SQL[name])
        assert sorted(df.columns) == sorted(d[0] for d in r.description)
        assert got == rows_of([d[0] for d in r.description], r.fetchall())
    else:
        assert got
