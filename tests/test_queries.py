"""Every registered survey query equals its SQL in DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from tripmill.jobs import cleaning, contracts, evaluation, fits, issues, ledger, model_chains, model_tables, persons, queries, records, survey, units  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="tables are missing")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and abs(float(a) - float(b)) <= 1e-6 * max(1, abs(float(a)))
    return a == b


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    rows = [[dict(zip(theirs, r))[c] for c in columns] for r in cursor.fetchall()]
    key = lambda r: [(x is None, str(type(x).__name__ != "str"), str(round(float(x), 3)) if isinstance(x, (int, float)) else str(x)) for x in r]
    mine = sorted(([r[c] for c in columns] for r in df.collect()), key=key)
    rows = sorted(rows, key=key)
    assert len(mine) == len(rows)
    wrong = [(a, b) for a, b in zip(mine, rows) if not all(map(same, a, b))]
    assert not wrong, wrong[:3]


def test_companions_have_ids_of_their_own(spark):
    """Persons of 1000 and more, as the larger tables have them, must not be taken for a companion."""
    for made in (persons._party, issues._coded):
        for folder in (FOLDER, "/root/testdata/sf0.1"):
            if Path(folder).is_dir():
                assert made(spark, folder).groupBy("hh", "day", "person", "trip").count().where("count > 1").count() == 0
