"""Every registered query runs; where there is SQL, DuckDB gives the same rows."""

import pytest

from webloom.queries import ORACLES, QUERIES


def canon(rows):
    return sorted(tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(r.values()) for r in df.select(columns).toArrow().to_pylist()]
    if name in ORACLES:
        quoted = ", ".join(f'"{c}"' for c in columns)
        relation = duck.sql(ORACLES[name])
        assert sorted(relation.columns) == columns
        assert canon(rows) == canon(duck.sql(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall())
    else:
        assert rows


def test_entry(spark, sf):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert sum(r["pages"] for r in rows) == 50
    assert set(e.oracle_sql()) <= set(e.queries())
