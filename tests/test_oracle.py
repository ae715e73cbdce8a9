"""All registered queries against SQL on the generating columns."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, _rows
from mdlake.plans import registry
from oracle.sql import ORACLE

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.QUERIES, ORACLE


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


#: queries whose rows come in an order, and the columns that tell it
ORDERED = {
    "recent_changes": (lambda r: [-int(r.date.replace("-", "")), r.line_no, r.part]),
    "edge_list": (lambda r: [r.src, r.dst]),
    "order_by_path": (lambda r: r.path.split("/")),
    "risks_sorted": (lambda r: [r.likelihood, r.risk]),
    "pages_by_category": (lambda r: [r.category]),
    "category_tree": (lambda r: [r.category]),
    "entity_mentions": (lambda r: [-r.mentions]),
}


@pytest.mark.parametrize("name", list(ORDERED))
def test_order(spark, name):
    keys = [ORDERED[name](r) for r in QUERIES[name](spark, SF_DIR).collect()]
    assert keys == sorted(keys) and len(keys) > 1


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    got = _rows(df.columns, df.collect())
    rel = con.execute(SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == _rows(columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
