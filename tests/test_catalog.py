"""Every query over the derived relations gives the rows of its DuckDB twin."""

import pytest

from skein.plans.catalog import ORACLE_SQL, QUERIES

KEY = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if name in ORACLE_SQL:
        q = duck.sql(ORACLE_SQL[name])
        assert sorted(q.columns) == cols
        want = q.select(",".join(f'"{c}"' for c in cols)).fetchall()
        assert sorted(rows, key=KEY) == sorted(want, key=KEY)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_point_lookup_plan_has_an_equality(spark, sf):
    plan = QUERIES["j2_occurrence_at"](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
