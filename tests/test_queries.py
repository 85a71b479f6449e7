"""Every query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tessella import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    if name not in queries.ORACLE_SQL:
        assert got
        return
    rel = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == names
    want = sorted((tuple(r[columns.index(n)] for n in names) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["q24_retention_by_class", "q55_unprefixed_join_filter", "q54_detected_keys", "q68_recursive_descent", "q69_average_level", "q56_relationship_order", "q61_schema_merge", "q25_progression", "q67_schema_summary"])
def test_query_over_cut_documents(spark, duck, name, monkeypatch):
    """The same over documents that are cut into parts of 256 KB."""
    from tessella import fixtures
    from tessella.sources import json_split

    monkeypatch.setattr(json_split, "SPLIT_BYTES", 256 << 10)
    assert json_split.elements(spark, f"{fixtures.game_files(spark, SF)}/chars.json", "entities") is not None
    test_query(spark, duck, name)
