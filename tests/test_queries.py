"""Every query with SQL gives the same rows as that SQL; every other one gives rows."""

import pandas as pd
import pytest

from intervale.plans import catalog

SMALL = "/root/testdata/sf0.001"


def plain(df):
    def value(v):
        if pd.isna(v):
            return "~"
        return f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)

    return sorted(tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, duck):
    got = catalog.queries()[name](spark, SMALL).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) or name == "fn_repetition"
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(catalog.queries()) >= 95
