import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry
from arborspark import catalog, catalog_built

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", ["q_links_relational", "q_has", "q_navigation", "q_node_sets"])
def test_relational_queries_parse_once(spark, name):
    """Every scan of the nodes reads what one parse has kept."""
    df = entry.queries()[name](spark, SF)
    optimized = df._jdf.queryExecution().optimizedPlan()
    kept = df._jdf.queryExecution().withCachedData().toString()
    assert kept.count("InMemoryRelation") > 1 and "MapInArrow" not in kept.split("InMemoryRelation")[0]
    assert optimized.toString().count("MapInArrow") <= kept.count("InMemoryRelation")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog_built.QUERIES is catalog.QUERIES and set(catalog.QUERIES) == set(catalog.ORACLES)
